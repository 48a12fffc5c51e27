"""SimHash fingerprints, and groups of texts whose fingerprints lie within a radius.

near_duplicates() takes 64 bits and a small radius, and finds every link. similar_groups() takes wide
fingerprints and random keys for candidates, and compares the candidates' shingle sets themselves.

Candidates: a fingerprint's bits are cut into blocks; two fingerprints within radius r agree on at least
blocks - r of them, so they meet under the key of some such choice of blocks. Equal fingerprints are one
row. Within a task the rows are sorted by key and their fingerprints held as bit planes (plane k: bit k of
every row, 64 rows to a word). Row i is compared with row i + d for every row at once: each plane is XORed
with itself moved by d, and the differing bits are counted by carry-save adders over the planes. Words
whose rows all exceed the radius are abandoned on the way.

Links become stars (row -> smallest id of its part of the bucket), and stars become groups by alternating
large-star and small-star steps over a table in the shared folder.

No key gathers all its rows in one task: a key with very many rows is dealt as a grid of cells, in which every
two of its parts meet; and joins split off the keys that very many rows have (split_join()).
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm import common as C

BITS = 64
#: A key with over 1/SPLIT of all rows (and over LEAST_SPLIT) is split off in joins, so at most SPLIT keys are broadcast.
SPLIT, LEAST_SPLIT = 1_000_000, 64
#: Rows of a key that are compared in one task; beyond, its rows are dealt as a grid. Slots count rows of keys.
GRID_ROWS, SLOTS = 20_000, 1 << 18
#: Rows of keys that a task holds, and characters whose shingle sets it holds: an exchange gets as many partitions as that takes.
TASK_ROWS, TASK_CHARS = 400_000, 32_000_000
#: Texts whose shingle sets are compared in one task: their characters, and their number as long as that takes GRID_PARTS parts at most.
GRID_CHARS, GRID_TEXTS, GRID_PARTS = 16_000_000, 500, 16
#: Rows of a random key in the mean, at most; and keys whose rows are dealt and compared at a time, which bounds an exchange.
KEY_ROWS, ROUND = 64, 26
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes; the bytes of white space stand in no other character."""
    edge = np.diff(np.concatenate(([True], _IS_SPACE[raw], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def shingles(text: str, words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by spaces, and the starts and ends of its shingles (fewer words: the whole sequence)."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    space = _IS_SPACE[raw]
    raw[space] = 0x20
    raw = raw[~(space & np.concatenate(([True], space[:-1])))]  # of white space the first stays, but none at the start
    starts, ends = _words(raw)
    k = min(words, len(starts))
    return raw.tobytes(), starts[: len(starts) - k + 1 if k else 0], ends[max(0, k - 1) :]


def _bit_totals(rows: np.ndarray, order: str) -> np.ndarray:
    """How many rows have each bit; rows of bytes."""
    totals = np.zeros(8 * rows.shape[1], np.int64)
    for at in range(0, len(rows), 8160):
        bits = np.unpackbits(rows[at : at + 8160], axis=1, bitorder=order)
        for k in range(0, len(bits), 255):  # as many as a byte can count
            totals += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return totals


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """A bit is set where over half of the shingles' hashes have it."""
    data, starts, ends = shingles(text, words)
    if not len(starts):
        return 0
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(data[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    totals = _bit_totals(np.frombuffer(raw, np.uint8).reshape(-1, 8), "big")
    return int.from_bytes(np.packbits(2 * totals > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for frame in batches:
            values = [fingerprint(x, words) for x in C.texts(frame["text"])]
            yield pd.DataFrame({"doc_id": C.id_or_null(frame["doc_id"]), "fp": np.array(values, np.uint64).view(np.int64)})

    return docs.select(C.id_column(), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, fp long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """A mask for each choice of blocks - radius blocks."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(x) for x in combinations(own, blocks - radius)]


def blocks_for(rows: int, radius: int) -> int:
    """Blocks at which a key's expected rows stay few: more rows, longer keys. Every choice finds every link."""
    blocks = radius + 1
    while blocks < BITS and rows > 16 * 2.0 ** (BITS * (blocks - radius) / blocks) and blocks < radius + 5:
        blocks += 1
    return max(blocks, radius + 2)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """A row of words for each bit of the values (n, or n x words): bit i of word j in plane k is bit k of value 64 j + i."""
    values = values.reshape(len(values), -1)
    n = -(-len(values) // 64) * 64
    padded = np.zeros((n, values.shape[1]), np.uint64)
    padded[: len(values)] = values
    out = np.empty((64 * values.shape[1], n // 64), np.uint64)
    for k in range(values.shape[1]):  # a word at a time, for memory
        bits = np.unpackbits(np.ascontiguousarray(padded[:, k]).view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")  # word, row, bit
        out[64 * k : 64 * k + 64] = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64).reshape(64, -1)
    return out


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three bits, for every bit of the words."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Flags where the number whose bit planes are `counter`, lowest first, is over the radius."""
    greater, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            greater |= equal & counter[k]
            equal &= ~counter[k]
    return greater


def close_pairs(planes: np.ndarray, wanted: np.ndarray, by: int, radius: int) -> np.ndarray:
    """Words of flags: rows i that are `wanted` and within `radius` of row i + by.

    Eight planes at a time go through carry-save adders into the planes of a counter.
    """
    alive = np.flatnonzero(wanted)
    result = np.zeros(len(wanted), np.uint64)
    width = max(4, len(planes).bit_length())
    counter = [np.zeros(len(alive), np.uint64) for _ in range(width)]
    # Words that are alive, and those that hold the rows they are compared with.
    words, bit = divmod(by, 64)
    right, left = np.uint64(bit), np.uint64(64 - bit)
    last = planes.shape[1] - 1
    one, two = np.minimum(alive + words, last), np.minimum(alive + words + 1, last)
    for k in range(0, len(planes), 8):
        x = []
        for plane in planes[k : k + 8]:
            moved = plane[one] >> right
            if bit:
                moved |= plane[two] << left
            x.append(plane[alive] ^ moved)
        ones, twos_a = _add(counter[0], x[0], x[1])
        ones, twos_b = _add(ones, x[2], x[3])
        twos, fours_a = _add(counter[1], twos_a, twos_b)
        ones, twos_a = _add(ones, x[4], x[5])
        ones, twos_b = _add(ones, x[6], x[7])
        twos, fours_b = _add(twos, twos_a, twos_b)
        fours, carry = _add(counter[2], fours_a, fours_b)
        counter[:3] = [ones, twos, fours]
        for j in range(3, width):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        if radius < 8 or k % 32 == 24:
            left_over = (wanted[alive] & ~_above(counter, radius)) != 0
            if not left_over.all():
                alive, one, two = alive[left_over], one[left_over], two[left_over]
                counter = [c[left_over] for c in counter]
                if not len(alive):
                    return result
    result[alive] = wanted[alive] & ~_above(counter, radius)
    return result


def _flag_words(flags: np.ndarray) -> np.ndarray:
    n = -(-len(flags) // 64) * 64
    padded = np.zeros(n, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def links_of_buckets(keys: np.ndarray, values: np.ndarray, radius: int, alike=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows with equal keys (sorted) whose values lie within the radius, as stars of each bucket's groups.

    With `alike`, a function of two rows, a pair links only if that holds too; pairs that are in one group already are not asked.
    """
    parent = np.arange(len(keys))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    s, e = C.runs(keys)
    size = np.repeat(e - s, e - s)
    rows, by = np.flatnonzero(size > 1), 1
    touched = []
    while len(rows):
        k = keys[rows]
        planes = bit_planes(values[rows].view(np.uint64))
        # The rows stay as they are until buckets of half the size are done with.
        until = by * 2
        while by < until:
            same = np.zeros(len(k), bool)
            if by < len(k):
                same[:-by] = k[by:] == k[:-by]
            if not same.any():
                break
            found = close_pairs(planes, _flag_words(same), by, radius)
            hit = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: len(k)])
            for i in hit.tolist():
                a, b = root(int(rows[i])), root(int(rows[i + by]))
                if a != b and (alike is None or alike(int(rows[i]), int(rows[i + by]))):
                    parent[max(a, b)] = min(a, b)
            touched.append(rows[hit])
            touched.append(rows[hit + by])
            by += 1
        else:
            rows = rows[size[rows] > by]
            continue
        break
    members = np.unique(np.concatenate(touched)) if touched else np.zeros(0, np.int64)
    roots = np.array([root(int(i)) for i in members], np.int64)
    keep = members != roots
    return members[keep], roots[keep]


def split_join(rows: DataFrame, side: DataFrame, on: str, total: int) -> DataFrame:
    """rows joined with side, which has a row for each value of `on`, and in `n` how many of the rows have it; n goes.

    Values that very many rows have are joined by broadcast, so no task gets all rows of one. They are SPLIT at most:
    more than total / SPLIT of `total` rows have each.
    """
    many = max(LEAST_SPLIT, total // SPLIT)
    added = [c for c in side.columns if c not in (on, "n")]
    hot = side.where(F.col("n") > many).select(on, *added, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), on, "left")
    few = marked.where("_hot is null").drop("_hot", *added).join(side.where(F.col("n") <= many).drop("n"), on)
    return marked.where("_hot").drop("_hot").unionByName(few)


def grid(rows: DataFrame, key: str, member: str, parts: DataFrame, on) -> DataFrame:
    """rows with `cell`, a hash of `key`, and for keys of several parts also of two parts: a row goes to every cell of its own part.

    parts: (slot, parts), few enough to be broadcast; `on` is the slot of a row. Any two rows of a key share a cell.
    """
    rows = rows.withColumn("_slot", on).join(F.broadcast(parts.withColumnRenamed("slot", "_slot")), "_slot", "left")
    own = F.pmod(F.xxhash64(member, F.lit(3)), F.col("parts"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.xxhash64(F.col(key), F.least(own, q), F.greatest(own, q)))
    return rows.withColumn("cell", F.explode(F.when(F.col("parts") > 1, cells).otherwise(F.array(F.xxhash64(key))))).drop("_slot", "parts")


def _grid_by_rows(rows: DataFrame, key: str, member: str, total: int, keys: DataFrame | None = None) -> DataFrame:
    """grid() of keys whose slot (a hash of the key) counts over GRID_ROWS rows, or twice the mean of all slots; `keys` are the keys of the rows."""
    limit = max(GRID_ROWS, 2 * total // SLOTS)
    slot = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(SLOTS))
    counts = (rows if keys is None else keys).groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return grid(rows, key, member, counts.select("slot", F.ceil(F.col("n") / limit).alias("parts")), slot)


def links(codes: DataFrame, radius: int, rows: int) -> DataFrame:
    """Links (a, b), a > b, between the ids of codes (id, fp; one row per fingerprint): every row within the radius of another is joined to it through links."""
    masks = [np.uint64(m).astype(np.int64).item() if m < 2**63 else m - 2**64 for m in block_masks(radius, blocks_for(rows, radius))]
    choice = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)]))
    n = max(C.partitions(codes.sparkSession), rows * len(masks) // TASK_ROWS)
    keyed = codes.select("id", "fp", choice.alias("c")).select("id", "fp", F.xxhash64("c.t", "c.key").alias("key"))
    dealt = _grid_by_rows(keyed, "key", "id", rows * len(masks)).select("id", "fp", "cell").repartition(n, "cell")

    def run(batches):
        frame = C.whole(batches)
        if frame is None or not len(frame):
            return
        key, ident, fp = (frame[c].to_numpy() for c in ("cell", "id", "fp"))
        order = np.lexsort((ident, key))
        key, ident, fp = key[order], ident[order], fp[order]
        a, b = links_of_buckets(key, fp, radius)
        found = pd.DataFrame({"a": ident[a], "b": ident[b]})
        yield found[found.a != found.b].drop_duplicates()

    return dealt.mapInPandas(run, "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in pairs (a, b), by alternating star steps.

    Each step's table is written to the shared folder. A node's neighbours are never gathered: both steps use minima
    by node, combined before the exchange, and joins that split off the nodes with very many links.
    """
    edges = C.materialise(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = _sums(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = split_join(both.where("b > a"), least, "a", 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = C.materialise(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = split_join(large, least, "a", 2 * state[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = C.materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        C.discard(large, edges)
        edges, before, state = after, state, _sums(after)
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _sums(edges: DataFrame):
    """The number of edges, and two sums that tell sets of edges apart."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()


_STEP = 0x9E3779B97F4A7C15
#: A random odd number for each byte, and powers of _STEP and of its inverse, modulo 2^64.
_OF_BYTE = np.random.default_rng(11).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PIECE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    while len(_POWERS[0]) < n:
        for k, base in enumerate((_STEP, pow(_STEP, -1, 2**64))):
            held = _POWERS[k]
            _POWERS[k] = np.concatenate((held, held * np.uint64(pow(base, len(held), 2**64))))
    return _POWERS


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, from differences of one running sum over the text's bytes; long texts go piece by piece, cut between words."""
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    found, at = [], 0
    while at < len(raw):
        stop = len(raw)
        if stop - at > _PIECE:
            space = np.flatnonzero(_IS_SPACE[raw[at + _PIECE :]][: 1 << 16])
            if not len(space):  # a very long word
                space = np.flatnonzero(_IS_SPACE[raw[at + _PIECE :]])
            stop = at + _PIECE + int(space[0]) if len(space) else stop
        part = raw[at:stop]
        starts, ends = _words(part)
        up, down = _powers(len(part))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[part] * up[: len(part)], dtype=np.uint64)))
        found.append(_mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = stop
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    own = word_hashes(text)
    k = min(words, len(own))
    h = np.zeros(len(own) - k + 1 if k else 0, np.uint64)
    for j in range(k):
        h = _mix(h + own[j : j + len(h)]) * np.uint64(_STEP)
    return np.unique(h)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def wide_fingerprint(text: str, words: int, size: int) -> np.ndarray:
    """A fingerprint of size x 64 bits over the distinct shingles, each of whose words has hashes of its own."""
    h = shingle_set(text, words)
    if not len(h):
        return np.zeros(size, np.uint64)
    steps = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_STEP)
    totals = np.zeros(64 * size, np.int64)
    for at in range(0, len(h), 8160):
        totals += _bit_totals(_mix(h[at : at + 8160, None] + steps).view(np.uint8), "little")
    return np.packbits(2 * totals > len(h), bitorder="little").view(np.uint64)


def agreement(similarity: float) -> float:
    """Expected share of equal bits of two texts whose shingle sets have this Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def bands(rows: int, similarity: float, missed: float = 0.004) -> tuple[int, int]:
    """Bits of a key and number of keys, so that a pair of that similarity shares no key with probability `missed` at most.

    A key has KEY_ROWS rows in the mean at most, so comparisons grow in proportion to rows and keys."""
    bits = max(10, math.ceil(math.log2(max(2, rows) / KEY_ROWS)))
    return bits, math.ceil(math.log(missed) / math.log(1 - agreement(similarity) ** bits))


def text_hash(of: str = "text"):
    """Tells texts of one id apart; null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(of).cast("string"), F.lit("")))


def lots(ends: np.ndarray, rows: int = 60_000) -> np.ndarray:
    """Places among buckets' ends that cut them into lots of whole buckets, of about so many rows; the last place is after all."""
    last = int(ends[-1]) if len(ends) else 0
    return np.r_[np.searchsorted(ends, np.arange(0, last, rows), side="left"), len(ends)]


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, size: int = 8) -> DataFrame:
    """doc_id, text_hash, component_id, component_text for every row of docs (doc_id, text): groups of texts whose shingle sets are alike.

    Texts link if the Jaccard similarity of their shingle sets (by 64-bit hashes) is `similarity` at least. They are
    compared if their fingerprints, `size` words wide, have the share of equal bits that this similarity gives, or up
    to three standard deviations less, and share a key: so many of the fingerprint's bits, drawn without regard to
    words, that a pair that similar meets under one of the keys with probability 0.996. Texts of equal fingerprints
    are one. A group is named by its row with the smallest id (null: C.NULL_ID, below all others) and that text's
    hash. Rows are grouped by their texts only: repeated or null ids tie nothing together.
    """
    spark = docs.sparkSession

    def run(batches):
        for frame in batches:
            fp = [wide_fingerprint(x, words, size).tobytes() for x in C.texts(frame["text"])]
            yield pd.DataFrame({"doc_id": C.ids(frame["doc_id"]), "text_hash": frame["text_hash"], "chars": [len(x) for x in C.texts(frame["text"])], "fp": fp})

    texts = docs.select(C.id_column(), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    own = C.materialise(texts.mapInPandas(run, "doc_id long, text_hash long, chars long, fp binary"), "fingerprints")
    # Numbers in the order of the smallest ids tell codes apart even where an id repeats.
    first = own.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash", "chars")).alias("r"), F.count("*").alias("n")).select("fp", "n", "r.*")
    codes = C.materialise(first.orderBy("doc_id", "text_hash", "fp").withColumn("id", F.monotonically_increasing_id()), "codes")
    n, least = 64 * size, C.partitions(spark)
    rows = codes.count()
    bits, tables = bands(rows, similarity)
    p = agreement(similarity)
    radius = math.floor(n * (1 - p) + 3 * math.sqrt(n * p * (1 - p)))
    rng = np.random.default_rng(5)
    drawn = np.stack([rng.choice(n, bits, replace=False) for _ in range(tables)])

    weight = (np.uint64(1) << np.arange(bits, dtype=np.uint64)).astype(np.int64)

    def keys_of(fps, own: np.ndarray) -> np.ndarray:
        flags = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
        return ((flags[:, drawn[own]].astype(np.int64) * weight).sum(2) + (own << 32)).ravel()

    def keyed(own: np.ndarray):
        def run(batches):
            for frame in batches:
                for at in range(0, len(frame), 512):
                    few = frame.iloc[at : at + 512]
                    yield pd.DataFrame({"key": keys_of(few["fp"], own), "id": np.repeat(few["id"].to_numpy(), len(own)), "fp": np.repeat(few["fp"].to_numpy(), len(own))})

        return run

    def only_keys(own: np.ndarray):
        def run(batches):
            for frame in batches:
                for at in range(0, len(frame), 512):
                    yield pd.DataFrame({"key": keys_of(frame["fp"].iloc[at : at + 512], own)})

        return run

    def compare(batches):
        frame = C.whole(batches)
        if frame is None or not len(frame):
            return
        key, ident = frame["cell"].to_numpy(), frame["id"].to_numpy()
        fp = np.frombuffer(b"".join(frame["fp"]), np.uint64).reshape(len(frame), -1)
        del frame
        order = np.lexsort((ident, key))
        key, ident = key[order], ident[order]
        s, e = C.runs(key)
        # A lot of whole buckets at a time bounds the planes' memory.
        cuts = lots(e)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if i == j:
                continue
            part = slice(s[i], e[j - 1])
            a, b = links_of_buckets(key[part], fp[order[part]], radius)
            found = pd.DataFrame({"a": ident[part][a], "b": ident[part][b]})
            yield found[found.a != found.b].drop_duplicates()
        C.release()

    def verify(batches):
        seen: dict[int, tuple] = {}
        at: list[tuple[int, int]] = []
        for frame in batches:
            for c, i, fp, text in zip(frame["cell"].tolist(), frame["id"].tolist(), frame["fp"], C.texts(frame["text"]), strict=True):
                at.append((c, i))
                if i not in seen:  # rows may repeat, and stand in several cells
                    seen[i] = (fp, shingle_set(text, words))
        if not seen:
            return
        order = sorted(set(at))
        key, ident = (np.array(x, np.int64) for x in zip(*order, strict=True))
        fp = np.frombuffer(b"".join(seen[i][0] for _, i in order), np.uint64).reshape(len(order), -1)
        sets = [seen[i][1] for _, i in order]
        a, b = links_of_buckets(key, fp, radius, lambda i, j: jaccard(sets[i], sets[j]) >= similarity - 1e-9)
        yield pd.DataFrame({"id": ident[a], "to": ident[b]})
        C.release()

    found = []
    for part in np.array_split(np.arange(tables, dtype=np.int64), math.ceil(tables / ROUND)):
        to = max(least, rows * len(part) // TASK_ROWS)
        every = codes.select("id", "fp").mapInPandas(keyed(part), "key long, id long, fp binary")
        dealt = _grid_by_rows(every, "key", "id", rows * len(part), codes.select("fp").mapInPandas(only_keys(part), "key long"))
        found.append(C.materialise(dealt.select("cell", "id", "fp").repartition(to, "cell").mapInPandas(compare, "a long, b long").distinct(), "pairs"))
    near = components(reduce(DataFrame.unionByName, found))
    C.discard(*found)
    near = near.unionByName(near.select(F.col("component").alias("id"), "component").distinct())
    # Large groups are dealt as a grid of parts: at most SPLIT of them by characters, and a GRID_TEXTS-th of the texts.
    held = C.materialise(near.join(codes.drop("n"), "id"), "candidates")
    chars = held.agg(F.sum("chars")).first()[0] or 0
    limit = max(GRID_CHARS, chars // SPLIT)
    parts = F.greatest(F.ceil(F.sum("chars") / limit), F.least(F.ceil(F.count("*") / GRID_TEXTS), F.lit(GRID_PARTS)))
    large = held.groupBy(F.col("component").alias("slot")).agg(parts.alias("parts")).where("parts > 1")
    gridded = grid(held, "component", "id", large, F.col("component")).select("cell", "id", "fp", "doc_id", "text_hash")
    # A text that stands under one id more than once goes to the join once.
    repeated = not own.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    once = texts.groupBy("doc_id", "text_hash").agg(F.min("text").alias("text")) if repeated else texts
    found = gridded.join(once, ["doc_id", "text_hash"]).select("cell", "id", "fp", "text").repartition(max(least, chars // TASK_CHARS), "cell").mapInPandas(verify, "id long, to long")
    found = C.materialise(found, "groups")
    if not large.isEmpty():  # links of several cells, not groups yet
        found = components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("component", "to")
    names = codes.select(F.col("id").alias("to"), F.col("doc_id").alias("component_id"), F.col("text_hash").alias("component_text"))
    moved = codes.join(found, "id", "left").select("fp", "n", F.coalesce("to", "id").alias("to"))
    sizes = moved.groupBy("to").agg(F.count("*").alias("n"))
    moved = split_join(moved.withColumnRenamed("n", "rows"), names.join(sizes, "to"), "to", rows).withColumnRenamed("rows", "n")
    return split_join(own, moved.select("fp", "n", "component_id", "component_text"), "fp", own.count()).select("doc_id", "text_hash", "component_id", "component_text")


def _groups(own: DataFrame, codes: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """doc_id, fp, component_id of own (doc_id, fp; `rows` of them), given codes (fp, smallest id, n) and links of their ids; null ids are C.NULL_ID."""
    # An id with several texts ties their fingerprints together.
    texts = own.distinct()
    repeated = texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    ties = split_join(split_join(texts, repeated, "doc_id", rows), codes.withColumnsRenamed({"id": "b"}), "fp", rows).select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    found = components(pairs.unionByName(ties))
    moved = codes.join(found, "id", "left").select("fp", "n", F.coalesce("component", "id").alias("component_id"))
    return split_join(own, moved, "fp", rows).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text).

    Null text is empty; a text without words has fingerprint zero, which links like any other. A null
    doc_id takes part like an id below all others: its group's component_id is null. Repeated ids are
    one id: all texts under it belong to one group. Other columns are ignored.
    """
    own = C.materialise(fingerprints(docs, words).select(F.coalesce("doc_id", F.lit(C.NULL_ID)).alias("doc_id"), "fp"), "fingerprints")
    codes = C.materialise(own.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "codes")
    return _groups(own, codes, links(codes, radius, codes.count()), own.count()).select(
        F.when(F.col("doc_id") != C.NULL_ID, F.col("doc_id")).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_id") != C.NULL_ID, F.col("component_id")).alias("component_id"),
    )
