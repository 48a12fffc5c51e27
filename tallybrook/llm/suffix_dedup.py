"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash is taken of every 32-byte string; the places where it is smallest within some 100-byte
window are triggers. They cut a text into phrases: the window starts that share a trigger, with the bytes
that those windows reach. Every window has exactly one trigger, fixed by its own bytes, so equal windows
lie at equal places of phrases with equal triggers.

* Dictionary: the distinct phrases, by a fingerprint. The parse is each document's sequence of them.
  A phrase that stands earlier in the parse has all its windows there: such windows are repeats at once.
* A phrase whose trigger no other distinct phrase has holds no repeat. Phrases that share a trigger (near
  copies, edges of shared passages) meet in the trigger's bucket with their bytes. Their suffixes are sorted
  there (the suffix array of the dictionary, to the depth of a window), ties by place in the parse: this
  combines both into corpus order, where equal windows stand side by side, the earliest first.
* A trigger that more than `frequent` distinct phrases have (the edges of a passage that a third of all
  documents hold) would make a hot bucket: its windows go, one by one, to buckets of their own fingerprints.

Texts are exchanged once, by document; all later exchanges carry packed places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybrook.llm import common as C

GRAM = 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_CHUNK = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bits of a trigger's hash that are told apart; a false match costs work, never a wrong result.
_TRIGGER = np.uint64((1 << 40) - 1)
#: A place: the document's id, its row (see _documents()), the first window's start, and how many windows follow it.
_PLACE = {"d": "<i8", "r": "<u8", "lo": "<u4", "n": "<u2"}
_COLUMNS = {"a": "V5", "u": "<u8"} | _PLACE
_SENT = "b int, kind string, a binary, u binary, d binary, r binary, lo binary, n binary"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        steps = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        for x in steps:
            x[0] = 1
        _POWERS[size] = tuple(np.multiply.accumulate(x) for x in steps)
    return _POWERS[size]


def gram_hashes(buf: np.ndarray, width: int = GRAM) -> np.ndarray:
    """The rolling hash of every string of `width` bytes, by prefix sums."""
    up, down = powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
        out = (sums[width:] - sums[:-width]) * down[: len(buf) - width + 1]
        out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
    return out


def phrases(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray, width: int):
    """(lo, hi, trigger hash) of the phrases of the texts buf[starts:ends]; lo and hi are its first and last window start."""
    none = np.zeros(0, np.int64)
    if len(buf) < width:
        return none, none, np.zeros(0, np.uint64)
    gram = min(GRAM, width)
    hashes = gram_hashes(buf, gram)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span, have = width - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = ends - starts >= width
    marks = np.zeros(len(at) + 1, np.int32)
    np.add.at(marks, starts[whole], 1)
    np.add.at(marks, ends[whole] - width + 1, -1)
    valid = np.cumsum(marks[:-1]) > 0
    first = np.r_[True, at[1:] != at[:-1]] | np.r_[True, ~valid[:-1]]
    begin = np.zeros(len(at), bool)
    begin[starts[whole]] = True
    lo = np.flatnonzero(valid & (first | begin))
    stop = np.r_[~valid[1:] | first[1:] | begin[1:], True]
    hi = np.flatnonzero(valid & stop)
    return lo, hi, hashes[at[lo]]


def _chunks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about _CHUNK bytes."""
    first, held = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if held and held + n > _CHUNK:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


_X = np.uint64(32)


def _documents(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Ids, rows, bytes and places in the frame, in order. A row is told by 32 bits of its text's hash (x), and by a
    number among the texts of one id that share them; equal rows share one row."""
    d, x, raw = C.ids(frame["doc_id"]), frame["x"].to_numpy().astype(np.uint64), C.texts(frame["text"])
    order = np.lexsort((x, d))
    d, x = d[order], x[order]
    s, e = C.runs(d)
    for i, j in zip(s.tolist(), e.tolist(), strict=True):
        if j - i > 1:
            order[i:j] = sorted(order[i:j].tolist(), key=lambda k: (frame["x"].iat[k], raw[k]))
    out = [raw[k].encode("utf-8", "surrogatepass") for k in order.tolist()]
    number = np.zeros(len(d), np.uint64)
    for k in np.flatnonzero((d[1:] == d[:-1]) & (x[1:] == x[:-1])).tolist():
        number[k + 1] = number[k] + np.uint64(out[k + 1] != out[k])
    return d, (x << _X) | number, out, order


def _earliest(keys: list[np.ndarray], d: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then place; for each element in that order whether it stands after its class's first place."""
    order = np.lexsort((lo, d, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for k in keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        new[1:] = ~same
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    d, lo = d[order], lo[order]
    late = (d != d[head]) | (lo != lo[head])
    return order, late


def _extract(width: int, to: C.Buckets):
    def run(batches):
        frame = C.whole(batches)
        if frame is None or not len(frame):
            return
        d, r, raw, _ = _documents(frame)
        del frame
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        parts: list[tuple] = []
        for i, j in _chunks(lengths):
            data = b"".join(raw[i:j])
            ends = np.cumsum(lengths[i:j])
            starts = ends - lengths[i:j]
            lo, hi, a = phrases(np.frombuffer(data, np.uint8), ends, starts, width)
            u = np.fromiter((xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(lo.tolist(), (hi + width).tolist(), strict=True)), np.uint64, len(lo))
            doc = np.searchsorted(ends, lo, side="right")
            parts.append((a & _TRIGGER, u, d[i:j][doc], r[i:j][doc], (lo - starts[doc]).astype(np.uint32), (hi - lo).astype(np.uint16)))
        a, u, d, r, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, late = _earliest([u, a], d, lo)
        cols = {"a": a, "u": u, "d": d, "r": r, "lo": lo, "n": n}
        pick = np.sort(order[~late])
        yield from _send({k: v[pick] for k, v in cols.items()}, to.of_hashes(u[pick]), "phrase")
        yield from _repeats(d, r, lo, n, order[late], to)
        C.release()

    return run


def _send(cols: dict[str, np.ndarray], to: np.ndarray, kind: str) -> Iterator[pd.DataFrame]:
    if "a" in cols:
        cols = cols | {"a": cols["a"] if kind == "window" else _narrow(cols["a"])}
    none = {k: None for k in _COLUMNS if k not in cols}
    if (out := C.split_packed(cols, to, kind=kind, **none)) is not None:
        yield out[["b", "kind", *_COLUMNS]]


def _narrow(a: np.ndarray) -> np.ndarray:
    """The five bytes of a trigger hash that travel."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).view("V5").ravel()


def _wide(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    if len(raw):
        out[:, :5] = np.ascontiguousarray(raw).view(np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _repeats(d, r, lo, n, pick: np.ndarray, to: C.Buckets) -> Iterator[pd.DataFrame]:
    """Repeated window ranges to their documents; ranges that follow one another are joined."""
    if not len(pick):
        return
    pick = pick[np.lexsort((lo[pick], r[pick], d[pick]))]
    d, r, lo, stop = d[pick], r[pick], lo[pick].astype(np.int64), lo[pick].astype(np.int64) + n[pick]
    new = np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (lo[1:] > stop[:-1] + 1)]
    # A joined range is cut where its length would not fit.
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    far = (lo - lo[first[group]]) // 60_000
    new |= np.r_[False, far[1:] != far[:-1]]
    first = np.flatnonzero(new)
    last = np.maximum.reduceat(stop, first)
    cols = {"d": d[first], "r": r[first], "lo": lo[first].astype(np.uint32), "n": (last - lo[first]).astype(np.uint16)}
    yield from _send(cols, _home(cols, to), "repeat")


def _home(cols: dict[str, np.ndarray], to: C.Buckets) -> np.ndarray:
    """The buckets of places' rows."""
    return to.of_ids(cols["d"], (cols["r"] >> _X).astype(np.int64))


def _kinds(batches) -> dict[str, list[pd.DataFrame]]:
    held: dict[str, list[pd.DataFrame]] = {}
    for frame in batches:
        for kind, rows in frame.groupby("kind", sort=False):
            held.setdefault(kind, []).append(rows)
    return held


def _read(held: dict, kind: str, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    types = _COLUMNS | ({"a": "<u8"} if kind == "window" else {})
    out = C.unpack(held.get(kind, []), {k: types[k] for k in columns})
    if "a" in out and kind != "window":
        out["a"] = _wide(out["a"])
    return out


def _phrase_table(to: C.Buckets):
    """Keeps the first place of each distinct phrase. One row per trigger goes to the trigger's bucket;
    the phrases of a trigger that several here share stay, until that bucket says whether it is frequent."""

    def run(batches):
        held = _kinds(batches)
        yield from held.get("repeat", [])
        x = _read(held, "phrase", ("a", "u", *_PLACE))
        order, late = _earliest([x["u"], x["a"]], x["d"], x["lo"])
        yield from _repeats(x["d"], x["r"], x["lo"], x["n"], order[late], to)
        x = {k: v[order[~late]] for k, v in x.items()}
        home = to.of_hashes(x["u"])
        by = np.lexsort((x["lo"], x["d"], home, x["a"]))
        key = np.r_[True, (x["a"][by][1:] != x["a"][by][:-1]) | (home[by][1:] != home[by][:-1])] if len(by) else np.zeros(0, bool)
        s = np.flatnonzero(key)
        size = np.diff(np.r_[s, len(by)])
        stay = by[np.repeat(size > 1, size)]
        yield from _send({k: x[k][stay] for k in ("a", *_PLACE)}, home[stay], "member")
        for many, kind in ((size > 1, "shared"), (size == 1, "single")):
            pick = by[s[many]]
            n = size[many]
            by_place = np.lexsort((x["lo"][pick], x["d"][pick]))
            pick, n = pick[by_place], n[by_place]
            cols = {k: x[k][pick] for k in ("a", *_PLACE)} if kind == "single" else {"a": x["a"][pick], "lo": n.astype(np.uint32), "u": home[pick].astype(np.uint64)}
            yield from _send(cols, to.of_hashes(x["a"][pick]), kind)

    return run


def _trigger_table(frequent: int, to: C.Buckets):
    """Triggers that more than one distinct phrase has: tells their buckets, with whether more than `frequent` have it."""

    def run(batches):
        held = _kinds(batches)
        for kind in ("repeat", "member"):
            yield from held.get(kind, [])
        x, y = _read(held, "single", ("a", *_PLACE)), _read(held, "shared", ("a", "lo", "u"))
        keys, back = np.unique(np.r_[x["a"], y["a"]], return_inverse=True)
        total = np.bincount(back, np.r_[np.ones(len(x["a"])), y["lo"]], len(keys)).astype(np.int64)
        of_single, of_shared = total[back[: len(x["a"])]], total[back[len(x["a"]) :]]
        for often, kind in ((False, "suspect"), (True, "frequent")):
            pick = np.flatnonzero((of_single > 1) & ((of_single > frequent) == often))
            yield from _send(cols := {k: x[k][pick] for k in ("a", *_PLACE)}, _home(cols, to), kind)
        pick = np.flatnonzero(of_shared > frequent)
        yield from _send({"a": y["a"][pick]}, y["u"][pick].astype(np.int64), "flag")

    return run


def _members(to: C.Buckets):
    def run(batches):
        held = _kinds(batches)
        for kind in ("repeat", "suspect", "frequent"):
            yield from held.get(kind, [])
        x = _read(held, "member", ("a", *_PLACE))
        often = np.isin(x["a"], _read(held, "flag", ("a",))["a"])
        for pick, kind in ((~often, "suspect"), (often, "frequent")):
            yield from _send(cols := {k: x[k][pick] for k in ("a", *_PLACE)}, _home(cols, to), kind)

    return run


def suffix_order(data: np.ndarray, starts: np.ndarray, width: int, d: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corpus order of the suffixes at `starts` to a depth of `width` bytes, ties by place; see _earliest()."""
    columns = []
    for k in range(0, width, 8):
        at = starts + min(k, width - 8) if width >= 8 else starts
        x = np.zeros(len(starts), np.uint64)
        for j in range(min(8, width)):
            x = (x << np.uint64(8)) | data[at + j]
        columns.append(x)
    return _earliest(columns, d, lo)


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of phrases: the phrase's number and the window's distance from its first."""
    count = n.astype(np.int64) + 1
    return np.repeat(np.arange(len(lo)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _texts_of_suspects(width: int, to: C.Buckets):
    """Sends a suspect's bytes to its trigger's bucket; of a frequent trigger, the fingerprint of each window to the window's own."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = _kinds([right])
        out = held.get("repeat", [])
        at, raw = None, []
        for kind in ("suspect", "frequent"):
            x = _read(held, kind, ("a", *_PLACE))
            if not len(x["d"]):
                continue
            if at is None:
                d, r, raw, _ = _documents(left)
                at = {(i, j): k for k, (i, j) in enumerate(zip(d.tolist(), r.tolist(), strict=True))}
            doc = [at[k] for k in zip(x["d"].tolist(), x["r"].tolist(), strict=True)]
            stop = x["lo"].astype(np.int64) + x["n"] + width
            parts = [raw[k][s:e] for k, s, e in zip(doc, x["lo"].tolist(), stop.tolist(), strict=True)]
            if kind == "suspect":
                goal = to.of_hashes(x["a"])
                order = np.argsort(goal, kind="stable")
                frame = next(_send({k: x[k][order] for k in _PLACE}, goal[order], "text"))
                bounds = C.runs(goal[order])
                frame["u"] = [b"".join(parts[k] for k in order[s:e].tolist()) for s, e in zip(*bounds, strict=True)]
                out.append(frame)
                continue
            for i in range(0, len(parts), 10_000):
                own = slice(i, i + 10_000)
                of, step = _expand(x["lo"][own], x["n"][own])
                d_, r_, lo = (x["d"][own][of], x["r"][own][of], x["lo"][own][of] + step)
                few = parts[own]
                hashed = b"".join(xxhash.xxh3_128_digest(few[k][s : s + width]) for k, s in zip(of.tolist(), step.tolist(), strict=True))
                key = np.frombuffer(hashed, "<u8").reshape(-1, 2)
                order, late = _earliest([key[:, 0], key[:, 1]], d_, lo)
                pick = np.sort(order[~late])
                cols = {"a": key[pick, 0].copy(), "u": key[pick, 1], "d": d_[pick], "r": r_[pick], "lo": lo[pick].astype(np.uint32)}
                out += _send(cols, to.of_hashes(key[pick, 0]), "window")
                out += _repeats(d_, r_, lo, np.zeros(len(lo), np.uint16), order[late], to)
        return pd.concat(out) if out else pd.DataFrame(columns=["b", "kind", *_COLUMNS])

    return run


def _window_table(width: int, to: C.Buckets):
    """Orders the windows of the dictionary's suspects, and finds the first of each class."""

    def run(batches):
        held = _kinds(batches)
        yield from held.get("repeat", [])
        x = _read(held, "window", ("a", "u", "d", "r", "lo"))
        order, late = _earliest([x["a"], x["u"]], x["d"], x["lo"])
        yield from _repeats(x["d"], x["r"], x["lo"], np.zeros(len(late), np.uint16), order[late], to)
        x = _read(held, "text", tuple(_PLACE))
        data = np.frombuffer(b"".join(t for f in held.get("text", []) for t in f["u"]), np.uint8)
        if not len(data):
            return
        size = x["n"].astype(np.int64) + width
        base = np.cumsum(size) - size
        of, step = _expand(x["lo"], x["n"])
        at = base[of] + step
        # Equal windows begin with equal bytes, so slices by their first eight can be ordered one by one.
        slices = max(1, -(-len(at) // 300_000))
        part = _first_bytes(data, at, width) % np.uint64(slices) if slices > 1 else np.zeros(len(at), np.uint64)
        found = []
        for own in np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part.astype(np.int64), minlength=slices))[:-1]):
            k = of[own]
            order, late = suffix_order(data, at[own], width, x["d"][k], x["lo"][k] + step[own])
            found.append(own[order[late]])
        found = np.concatenate(found)
        k = of[found]
        yield from _repeats(x["d"][k], x["r"][k], x["lo"][k] + step[found], np.zeros(len(k), np.uint16), np.arange(len(k)), to)

    return run


def _first_bytes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    x = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(16, width)):
            x = (x ^ data[at + j]) * _MIX
            x ^= x >> np.uint64(31)
    return x


def _removed(width: int, keep: str | None):
    """Per row of a bucket: its document, the removed mask's counts, the digest of the bytes that stay, and they or its own columns."""

    def run(left, right):
        import pyarrow as pa

        frame = left.select(["doc_id", "x", "text"]).to_pandas()
        d, r, raw, order = _documents(frame)
        where = {(i, j): k for k, (i, j) in enumerate(zip(d.tolist(), r.tolist(), strict=True))}
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        x = C.unpack([right.select(list(_PLACE)).to_pandas()], _PLACE)
        doc = np.fromiter((where[k] for k in zip(x["d"].tolist(), x["r"].tolist(), strict=True)), np.int64, len(x["d"]))
        by = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[by], np.arange(len(raw) + 1))
        lo, stop = x["lo"].astype(np.int64)[by], (x["lo"].astype(np.int64) + x["n"] + width)[by]
        rows = []
        for k, text in enumerate(raw):
            # Equal rows share the last one's place.
            twin = where[d[k], r[k]]
            if k and where[d[k - 1], r[k - 1]] == twin:
                rows.append(rows[-1])
                continue
            s, e = cuts[twin], cuts[twin + 1]
            marks = np.zeros(lengths[k] + 1, np.int32)
            np.add.at(marks, lo[s:e], 1)
            np.add.at(marks, stop[s:e], -1)
            gone = np.cumsum(marks)[:-1] > 0
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            own = np.frombuffer(text, np.uint8)
            if keep == "text":
                kept = own[~_whole_characters(own, gone)].tobytes() if spans else text
            else:
                kept = own[~gone].tobytes() if spans else text
            rows.append((int(lengths[k]), int(gone.sum()), spans, kept))
        out = {"doc_id": pa.array([None if i == C.NULL_ID else i for i in d.tolist()], pa.int64())}
        for name, values in zip(("n_bytes", "n_removed", "n_spans", "kept"), list(zip(*rows, strict=True)) or ((),) * 4, strict=True):
            out[name] = values
        kept = out.pop("kept")
        columns = [out["doc_id"], *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans"))]
        if keep == "text":
            columns += [pa.array([x.decode("utf-8", "surrogatepass") for x in kept], pa.string()), left.column("rest").take(pa.array(order)).combine_chunks()]
        else:
            columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
            if keep == "bytes":
                columns.append(pa.array(kept, pa.binary()))
        C.release()
        names = {"text": ["text", "rest"], "bytes": ["kept_sha256", "kept"]}.get(keep, ["kept_sha256"])
        return pa.table(dict(zip(["doc_id", "n_bytes", "n_removed", "n_spans", *names], columns, strict=True)))

    return run


def _whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The mask of removed bytes, widened to every character of UTF-8 text of which a byte goes."""
    first = np.flatnonzero((text & 0xC0) != 0x80)
    number = np.cumsum((text & 0xC0) != 0x80) - 1
    return np.logical_or.reduceat(gone, first)[number]


def _repeats_of(docs: DataFrame, width: int, keep: str | None, frequent: int, rest=None) -> DataFrame:
    if width < 8 or width > 60_000:
        raise ValueError("width must be from 8 to 60,000 bytes")
    to = C.Buckets(C.sized(docs))
    nb = to.n
    text = F.col("text").cast("string")
    x = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(0xFFFFFFFF)
    texts = docs.select(C.id_column(), x.alias("x"), text.alias("text"), *([rest.alias("rest")] if rest is not None else []))
    texts = texts.withColumn("b", to.column(salt=F.col("x"))).repartition(nb, "b")
    places = texts.mapInPandas(_extract(width, to), _SENT) if rest is None else texts.mapInArrow(_in_pandas(_extract(width, to)), _SENT)
    for step in (_phrase_table(to), _trigger_table(frequent, to), _members(to)):
        places = places.repartition(nb, "b").mapInPandas(step, _SENT)
    if rest is None:
        places = texts.groupBy("b").cogroup(places.groupBy("b")).applyInPandas(_texts_of_suspects(width, to), _SENT)
    else:
        places = texts.groupBy("b").cogroup(places.groupBy("b")).applyInArrow(_cogroup_in_pandas(_texts_of_suspects(width, to)), _SENT)
    places = places.repartition(nb, "b").mapInPandas(_window_table(width, to), _SENT)
    schema = StructType()
    for name in ("doc_id", "n_bytes", "n_removed", "n_spans"):
        schema.add(name, "long")
    if keep == "text":
        schema.add("text", "string").add(texts.schema["rest"])
    else:
        schema.add("kept_sha256", "string")
        if keep == "bytes":
            schema.add("kept", "binary")
    return texts.groupBy("b").cogroup(places.groupBy("b")).applyInArrow(_removed(width, keep), schema)


def _in_pandas(run):
    """A step over batches of which only id, text and its hash become pandas; other columns, of any type, stay in Arrow."""
    import pyarrow as pa

    def step(batches):
        frames = (x.select(["doc_id", "x", "text"]).to_pandas() for x in batches)
        for out in run(frames):
            yield pa.RecordBatch.from_pandas(out, _sent_schema(), preserve_index=False)

    return step


def _cogroup_in_pandas(run):
    import pyarrow as pa

    def step(left, right):
        out = run(left.select(["doc_id", "x", "text"]).to_pandas(), right.to_pandas())
        return pa.Table.from_pandas(out[["b", "kind", *_COLUMNS]], _sent_schema(), preserve_index=False)

    return step


def _sent_schema():
    import pyarrow as pa

    return pa.schema([("b", pa.int32()), ("kind", pa.string()), *((k, pa.binary()) for k in _COLUMNS)])


def dedup_substrings(docs: DataFrame, width: int = 100, keep: str | None = "bytes", frequent: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with keep) kept, the bytes that stay, for every row of docs.

    docs needs doc_id (long) and text (string); other columns are ignored. A byte goes if a string of `width`
    bytes that also starts at a smaller (doc_id, start) covers it. Null text is empty. A null doc_id is
    ordered first. Rows that repeat a doc_id hold one place: a string repeats only if it starts at a
    strictly smaller (doc_id, start), so equal rows get equal results. Texts under `width` bytes stay whole;
    texts of up to 4 GB are read whole. An empty table gives no rows. Rows are dealt by id and text, so rows
    without an id, or of one id, don't meet in one task.
    `frequent` only chooses a way of comparing; either finds every repeat.
    """
    return _repeats_of(docs, width, "bytes" if keep else None, frequent)


def without_repeats(docs: DataFrame, width: int = 100, into: str = "n_removed", frequent: int = 2000) -> DataFrame:
    """docs, its columns as they are, with the bytes that dedup_substrings() removes cut out of text, and their number in the
    column `into`, which docs must not have.

    Of a character of which a byte goes all bytes go. Rows and columns are carried along, not joined back: null and
    repeated ids, and equal rows, stay as many as they were. A null text stays null.
    """
    rest = [c for c in docs.columns if c != "text"]
    own = F.struct(F.col("text").isNull().alias("_null"), *[F.col(f"`{c}`") for c in rest])
    out = _repeats_of(docs, width, "text", frequent, own)
    text = F.when(~F.col("rest._null"), F.col("text")).alias("text")
    return out.select(*[text if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns], F.col("n_removed").alias(into))
