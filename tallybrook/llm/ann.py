"""Nearest neighbours by inner product, with randomly rotated one-bit codes.

Index: vectors are turned by a random rotation, and of each only the signs are kept (a bit per dimension),
with two scalars: its length, and how far the sign vector leans towards it. The rotated query is put on a
grid of 16 steps, so its inner product with a sign vector is a few popcounts. From that follow an estimate
of the true inner product, and a bound of its error that holds with high probability. Vectors are ranked
exactly, on the originals in double precision, while their upper bound reaches the 20th best found so far.

Rows are dealt into blocks of bounded size: coarse cells, by centres fitted on a bounded sample, and parts of those
cells that hold more rows. A query first searches one block of its nearest cell; its k-th best there is a floor. Then
it goes to the blocks of all cells that can hold better: those whose centre's inner product, plus the query's length
times the cell's radius, reaches the floor. That leaves out no neighbour; where the vectors are clustered it leaves
out most cells. A block's rows are held by one task, and the queries stream past them, so neither side's share of a
task grows with the tables. The best of all blocks are merged for each query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tallybrook.llm import common as C

#: A block: bytes of its vectors at most, and rows at least; between them a block for each quarter of a core.
MOST_BYTES, LEAST_ROWS = 64 << 20, 4096
#: Queries that are compared at a time, and their estimates, at most.
QUERY_LOT, ESTIMATES = 32, 2_000_000
#: The sample that centres are fitted on, and the number of cells of a vector length, at most.
SAMPLE, MOST_CELLS, ROUNDS = 16_384, 4096, 5
#: Standard deviations of the estimate's error that the bound allows.
EPSILON = 2.3
STEPS = 4  # bits of a query's grid


def rotation(dims: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def padded(dims: int) -> int:
    return -(-dims // 64) * 64


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (64 to a word), lengths, and <unit vector, unit sign vector> of each row."""
    length, lean, words = np.empty(len(x)), np.empty(len(x)), np.empty((len(x), turn.shape[0] // 8), np.uint8)
    for i in range(0, len(x), 8192):
        own, part = slice(i, i + 8192), x[i : i + 8192].astype(np.float64)
        length[own] = np.linalg.norm(part, axis=1)
        turned = (part / length[own, None]) @ turn.T
        lean[own] = np.abs(turned).sum(1) / math.sqrt(turn.shape[0])
        words[own] = np.packbits(turned > 0, axis=1, bitorder="little")
    return words.view(np.uint64), length, lean


class Block:
    """The codes of some vectors, and the search in them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        dims = vectors.shape[1]
        self.turn = rotation(padded(dims))[:, :dims]
        self.codes, self.length, self.lean = encode(self.vectors, self.turn)
        self.total = np.bitwise_count(self.codes).sum(1, dtype=np.int64)
        # Standard deviation of the part of the estimate that the codes don't show.
        self.error = np.sqrt(np.maximum(0.0, 1 - self.lean**2)) / self.lean / math.sqrt(max(1, padded(dims) - 1))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products of queries (a row each) with all vectors, and the allowed errors."""
        dims = self.turn.shape[0]
        size = np.linalg.norm(queries, axis=1, keepdims=True)
        turned = (queries / size) @ self.turn.T
        low = turned.min(1, keepdims=True)
        step = (turned.max(1, keepdims=True) - low) / (2**STEPS - 1)
        step[step == 0] = 1.0
        levels = np.rint((turned - low) / step).astype(np.uint8)
        off = np.linalg.norm(turned - (low + step * levels), axis=1, keepdims=True)  # the grid's part of the error, spread over the signs at random
        hits = np.zeros((len(queries), len(self.ids)), np.int32)
        for k in range(STEPS):
            planes = np.ascontiguousarray(np.packbits((levels >> k) & 1, axis=1, bitorder="little")).view(np.uint64)
            for w in range(planes.shape[1]):
                hits += np.bitwise_count(self.codes[:, w] & planes[:, w, None]).astype(np.int32) << k
        # <query on its grid, sign vector>, with signs as +-1 / sqrt(dims)
        inner = (2 * (step * hits + low * self.total) - (step * levels.sum(1, keepdims=True, dtype=np.int64) + low * dims)) / math.sqrt(dims)
        scale = self.length * size
        return scale * inner / self.lean, scale * EPSILON * np.sqrt(self.error**2 + (off / self.lean) ** 2 / dims)

    def nearest(self, query_ids: list[int], queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        """For each query the places and inner products of its k nearest rows, best first, ties to smaller ids; rows with the query's id
        stand out, and rows below its floor."""
        floors = np.full(len(query_ids), -np.inf) if floors is None else floors
        size = max(1, min(QUERY_LOT, ESTIMATES // len(self.ids)))
        for at in range(0, len(query_ids), size):
            lot, ids = queries[at : at + size], query_ids[at : at + size]
            estimates, errors = self.bounds(lot)
            own = [slice(*np.searchsorted(self.ids, [i, i + 1])) for i in ids]
            for e, o in zip(estimates, own, strict=True):
                e[o] = -np.inf
            most = min(k, len(self.ids))
            best = np.argpartition(-estimates, most - 1, axis=1)[:, :most]
            for query, e, error, o, top, floor in zip(lot, estimates, errors, own, best, floors[at : at + size].tolist(), strict=True):
                few = min(k, len(self.ids) - (o.stop - o.start))
                if not few:
                    yield np.zeros(0, np.int64), np.zeros(0)
                    continue
                top = top[e[top] > -np.inf]
                places = np.union1d(np.flatnonzero(e + error >= max(floor, self._exact(top, query).min())), top)
                score = self._exact(places, query)
                order = np.lexsort((self.ids[places], -score))[:few]
                order = order[score[order] >= floor]
                yield places[order], score[order]

    def _exact(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        return exact(self.vectors[at], query)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order whatever rows stand beside it."""
    return np.add.reduce(np.asarray(vectors, np.float64) * np.asarray(query, np.float64), axis=1)


class Cells:
    """Centres of the vectors of each length, numbered through, and what is known of their cells once the rows are counted."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres = centres
        ends = np.cumsum([0, *(len(c) for c in centres.values())])
        self.first = dict(zip(centres, ends.tolist(), strict=False))
        self.n = int(ends[-1])

    def nearest(self, vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector (the nearest centre; -1: a length without rows) and its distance from the centre."""
        cell, far = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
        lengths = np.array([len(v) for v in vectors])
        for dims, centres in self.centres.items():
            at = np.flatnonzero(lengths == dims)
            half = (centres**2).sum(1) / 2
            for i in range(0, len(at), 1024):
                few = at[i : i + 1024]
                x = np.stack([vectors[k] for k in few.tolist()]).astype(np.float64)
                best = np.argmax(x @ centres.T - half, axis=1)
                cell[few] = self.first[dims] + best
                far[few] = np.linalg.norm(x - centres[best], axis=1)
        return cell, far

    def count(self, found, block_rows: dict[int, int]) -> None:
        """found: (cell, rows, radius) of every cell with rows; block_rows by length."""
        self.parts, self.radius = np.zeros(self.n, np.int64), np.zeros(self.n)
        most = np.repeat([block_rows[dims] for dims in self.centres], [len(c) for c in self.centres.values()])
        for cell, rows, radius in found:
            self.parts[cell], self.radius[cell] = -(-rows // int(most[cell])), radius
        self.start = np.cumsum(self.parts) - self.parts
        self.blocks = int(self.parts.sum())

    def block(self, cell: np.ndarray, h: np.ndarray) -> np.ndarray:
        return self.start[cell] + h % self.parts[cell]

    def home(self, query: np.ndarray, h: int) -> int:
        """One block of the cell whose centre is nearest by inner product."""
        query = query.astype(np.float64)
        centres, first = self.centres[len(query)], self.first[len(query)]
        value = np.where(self.parts[first : first + len(centres)] > 0, centres @ query, -np.inf)
        return int(self.block(first + int(np.argmax(value)), h))

    def worth(self, query: np.ndarray, floor: float) -> np.ndarray:
        """The blocks of all cells that can hold a vector whose inner product reaches the floor."""
        query = query.astype(np.float64)
        centres, first = self.centres[len(query)], self.first[len(query)]
        own = slice(first, first + len(centres))
        size = float(np.linalg.norm(query))
        most = centres @ query + size * self.radius[own]
        slack = 1e-9 * size * (np.linalg.norm(centres, axis=1) + self.radius[own])
        cells = first + np.flatnonzero((most + slack >= floor) & (self.parts[own] > 0))
        return np.concatenate([np.arange(self.start[c], self.start[c] + self.parts[c]) for c in cells.tolist()] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of x by a few rounds from k of its rows."""
    centres = x[np.random.default_rng(4).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([np.argmax(p @ centres.T - (centres**2).sum(1) / 2, axis=1) for p in np.array_split(x, -(-len(x) // 2048))])
        order = np.argsort(own, kind="stable")
        s, _ = C.runs(own[order])
        sums = np.add.reduceat(x[order], s, axis=0)
        centres[own[order][s]] = sums / np.diff(np.r_[s, len(x)])[:, None]
    return centres


def _fit(rows: DataFrame, block_rows) -> tuple[Cells, dict[int, int]]:
    """Centres by a sample of SAMPLE rows, those with the smallest hashes, and the rows of a block by length. A length with no more
    rows than a block has one cell, around zero."""
    lengths = {x.dims: x.n for x in rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()}
    total = sum(lengths.values())
    most = {dims: block_rows(dims, total) for dims in sorted(lengths)}
    centres = {}
    for dims, n in sorted(lengths.items()):
        if n <= most[dims]:
            centres[dims] = np.zeros((1, dims))
            continue
        bound = max(256, min(SAMPLE, (128 << 20) // (8 * dims)))  # the driver holds so many
        sample = rows.where(F.size("v") == dims).orderBy(F.xxhash64("id", "v")).limit(bound).select("v").collect()
        centres[dims] = kmeans(np.array([x.v for x in sample], np.float64), min(MOST_CELLS, -(-n // most[dims])))
    return Cells(centres), most


_FOUND = "query_id long, vec_id long, score double"


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", column: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest among rows, nearest first, ties to smaller ids.

    Both have id_column (long) and column (array of numbers); others are ignored. Vectors that are null,
    empty, zero or hold null or non-finite numbers take no part; nor do rows without an id. A row is no
    candidate of a query with its id. Repeated rows are rows: an id can be returned as often as it stands
    in rows, and a repeated query is answered once. Vectors must be of one length; others than the
    query's take no part in its search. Vectors of any length are read whole, a few thousand at a time.
    Empty tables give no rows.
    """
    spark = rows.sparkSession

    def usable_rows(df: DataFrame) -> DataFrame:
        v = F.col(column)
        if df.select(column).schema[0].dataType != ArrayType(FloatType(), True):  # floats travel as they are
            v = v.cast("array<double>")
        own = df.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return own.where(fine)

    own, asked = usable_rows(rows), usable_rows(queries).dropDuplicates(["id"])
    kind = own.schema["v"].dataType.simpleString()
    cores = spark.sparkContext.defaultParallelism

    def most_rows(dims: int, count: int) -> int:
        return block_rows or max(LEAST_ROWS, min(MOST_BYTES // ((4 if kind == "array<float>" else 8) * dims), count // (4 * cores)))

    cells, most = _fit(own, most_rows)
    centres = spark.sparkContext.broadcast(cells)  # MOST_CELLS centres of a length at most

    @F.pandas_udf("cell int, far double")
    def place(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("cell", "far"), centres.value.nearest(list(v)), strict=True)))

    placed = own.withColumn("p", place("v"))
    cells.count(placed.groupBy("p.cell").agg(F.count("*"), F.max("p.far")).collect(), most)
    known = spark.sparkContext.broadcast(cells)
    keys = C.Buckets(max(1, cells.blocks))
    # Rows of one id would share a block by the id alone, so the vector counts too.
    h = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 31))

    @F.pandas_udf("int")
    def block(cell: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(keys.keys[known.value.block(cell.to_numpy(), h.to_numpy())].astype(np.int32))

    @F.pandas_udf("int")
    def home(v: pd.Series, h: pd.Series) -> pd.Series:
        tool = known.value
        return pd.Series([int(keys.keys[tool.home(q, i)]) if len(q) in tool.centres else None for q, i in zip(v, h.tolist(), strict=True)], dtype="Int32")

    @F.pandas_udf("array<int>")
    def worth(v: pd.Series, floor: pd.Series) -> pd.Series:
        return pd.Series([keys.keys[known.value.worth(q, t)].astype(np.int32) for q, t in zip(v, floor.tolist(), strict=True)])

    def visit(queries: DataFrame, run, schema: str) -> DataFrame:
        """run over each block: its rows first, then the queries that visit it."""
        held = placed.select(block("p.cell", h).alias("b"), F.lit(0).alias("asks"), "id", "v", F.lit(None).cast("double").alias("floor"))
        both = held.unionByName(queries.select("b", F.lit(1).alias("asks"), "id", "v", "floor"))
        return both.repartition(keys.n, "b").sortWithinPartitions("b", "asks").mapInPandas(lambda batches: _blocks(batches, run), schema)

    def floors(blocks: dict, ids: np.ndarray, vectors: list, _):
        found = _nearest(blocks, ids, vectors, np.full(len(ids), -np.inf), k)
        yield pd.DataFrame({"id": ids, "v": vectors, "floor": [float(score[-1]) if len(score) == k else -math.inf for _, score in found]})

    def answer(blocks: dict, ids: np.ndarray, vectors: list, floor: np.ndarray):
        found = _nearest(blocks, ids, vectors, floor, k)
        if found:
            yield pd.DataFrame({"query_id": np.repeat(ids, [len(x) for x, _ in found]), "vec_id": np.concatenate([x for x, _ in found]), "score": np.concatenate([x for _, x in found])})

    if not cells.blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = asked.select(home("v", h).alias("b"), "id", "v", F.lit(None).cast("double").alias("floor")).where("b is not null")
    known_floor = visit(first, floors, f"id long, v {kind}, floor double") if cells.blocks > 1 else first.select("id", "v", F.lit(-math.inf).alias("floor"))
    found = visit(known_floor.withColumn("b", F.explode(worth("v", "floor"))), answer, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(batches, run):
    """Rows sorted by block, a block's vectors before the queries: run(blocks by length, ids, vectors, floors) for each batch's queries of a block."""
    at, held, blocks = None, [], None
    for frame in batches:
        for b, own in frame.groupby("b", sort=False):
            if b != at:
                at, held, blocks = b, [], None
            asks = own["asks"].to_numpy() == 1
            if not asks.all():
                held.append(own[~asks])
            if asks.any():
                if blocks is None:
                    blocks, held = _ready(held), []
                wanted = own[asks]
                yield from run(blocks, wanted["id"].to_numpy(np.int64), list(wanted["v"]), wanted["floor"].to_numpy(np.float64))


def _ready(frames: list[pd.DataFrame]) -> dict[int, Block]:
    by_length: dict[int, tuple[list, list]] = {}
    for frame in frames:
        for i, v in zip(frame["id"].tolist(), frame["v"], strict=True):
            ids, vectors = by_length.setdefault(len(v), ([], []))
            ids.append(i)
            vectors.append(v)
    return {dims: Block(np.array(ids, np.int64), np.stack(vectors)) for dims, (ids, vectors) in by_length.items()}


def _nearest(blocks: dict[int, Block], ids: np.ndarray, vectors: list, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and inner products of each query's nearest in its length's block."""
    out = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
    lengths = np.array([len(v) for v in vectors])
    for dims, block in blocks.items():
        at = np.flatnonzero(lengths == dims)
        if len(at):
            found = block.nearest(ids[at].tolist(), np.stack([vectors[j] for j in at.tolist()]).astype(np.float64), k, floors[at])
            for j, (places, score) in zip(at.tolist(), found, strict=True):
                out[j] = (block.ids[places], score)
    return out
