"""Hard negatives by blocked dense matrix products.

Anchors go in blocks of bounded size, each broadcast to all tasks, against the blocks of rows that a task reads. A block's
scores are one matrix product in float64, exact as all of them stay below 2^53. First pass: for each anchor the best
rows of its own label. What a task found is merged with what others found, as a best-k of a union is that of the
parts' best k. Second pass: for each anchor and positive the best rows of other labels whose score lies in the window
that the positive's score sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybrook.llm import common as C

#: Anchors of a block, and bytes of their vectors (as float64), at most; rows and anchors of one matrix product.
ANCHORS, ANCHOR_BYTES = 32_768, 32 << 20
ROWS, COLUMNS = 1024, 1024
_EXACT = 2.0**53
_NONE = np.iinfo(np.int64).min


def quantised(vectors, dims: int, steps: int) -> np.ndarray:
    """floor(steps * x) of each component, as float64; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * steps)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a and b; those that a long can't hold are set to its ends."""
    width = min(a.shape[1], b.shape[1])  # what one has beyond the other meets zeros
    a, b = a[:, :width], b[:, :width]
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(whole, _NONE + 1, 2**63 - 1).astype(np.int64)


class Best:
    """The k best of each of n lists: scores descending, ties by ascending id; what has both alike counts once."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), _NONE), np.full((n, k), _NONE)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        n, k = self.score.shape
        touched = np.unique(lists)
        filled = self.score[touched] != _NONE
        where = np.r_[lists, np.repeat(touched, k)[filled.ravel()]]
        scores, ids = np.r_[scores, self.score[touched][filled]], np.r_[ids, self.id[touched][filled]]
        order = np.lexsort((ids, -scores, where))
        where, scores, ids = where[order], scores[order], ids[order]
        new = np.r_[True, (where[1:] != where[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])]
        where, scores, ids = where[new], scores[new], ids[new]
        starts, ends = C.runs(where)
        place = np.arange(len(where)) - np.repeat(starts, ends - starts)
        keep = place < k
        self.score[touched], self.id[touched] = _NONE, _NONE
        self.score[where[keep], place[keep]], self.id[where[keep], place[keep]] = scores[keep], ids[keep]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = np.nonzero(self.score != _NONE)
        return found[0], self.score[found], self.id[found]


@dataclass
class Anchors:
    """A block of anchors, small enough to be broadcast."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def tiles(self, batches, steps: int):
        """Anchors (a slice), and ids, labels and scores (anchors x rows) of a few rows at a time; the first ones are small, so that floors rise early."""
        size = 64
        for frame in batches:
            at = 0
            while at < len(frame):
                few = frame.iloc[at : at + size]
                at, size = at + size, min(ROWS, size * 2)
                values = few["vector"].tolist()
                own = quantised(values, max((len(v) for v in values), default=0), steps)
                ids, labels = few["vec_id"].to_numpy(np.int64), few["label"].to_numpy(np.int64)
                for start in range(0, len(self.ids), COLUMNS):
                    part = slice(start, min(start + COLUMNS, len(self.ids)))
                    yield part, ids, labels, products(self.vectors[part], own)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows that take part: a label, and a vector without null, NaN or infinite components."""
    vector = F.col("embedding").cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & rows["embedding"].isNotNull() & ~bad
    )


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of every task's best; what tasks found alike counts once."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).distinct()


def _block(spark: SparkSession, anchors: DataFrame, steps: int) -> Anchors:
    own = anchors.orderBy("vec_id", F.hash("vector")).toPandas()
    dims = max((len(v) for v in own["vector"]), default=0)
    return Anchors(own["vec_id"].to_numpy(np.int64), own["label"].to_numpy(np.int64), quantised(own["vector"].tolist(), dims, steps))


def _positives(rows: DataFrame, held, steps: int, k: int) -> DataFrame:
    def run(batches):
        anchors = held.value
        best = Best(len(anchors.ids), k)
        for part, ids, labels, score in anchors.tiles(batches, steps):
            score[(anchors.labels[part, None] != labels) | (anchors.ids[part, None] == ids)] = _NONE
            floor = best.floor()[part]
            if len(ids) > 4 * k and len(np.unique(ids)) == len(ids):  # the k-th best of these rows is a floor, too
                floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k])
            a, r = np.nonzero((score >= floor[:, None]) & (score != _NONE))
            best.add(a + part.start, score[a, r], ids[r])
        a, score, ids = best.entries()
        yield pd.DataFrame({"anchor": a, "score": score, "id": ids})

    return _merged(rows.mapInPandas(run, "anchor int, score long, id long"), ["anchor"], k)


def _negatives(rows: DataFrame, held, windows, steps: int, k: int) -> DataFrame:
    """windows: of each anchor and place of a positive, the least and the largest score (arrays: anchors x positives)."""

    def run(batches):
        anchors, (least, most) = held.value, windows.value
        best = [Best(len(anchors.ids), k) for _ in range(least.shape[1])]
        for part, ids, labels, score in anchors.tiles(batches, steps):
            other = anchors.labels[part, None] != labels
            for j, held_best in enumerate(best):
                low = np.maximum(least[part, j], held_best.floor()[part])
                a, r = np.nonzero(other & (score >= low[:, None]) & (score <= most[part, j, None]))
                held_best.add(a + part.start, score[a, r], ids[r])
        for j, held_best in enumerate(best):
            a, score, ids = held_best.entries()
            yield pd.DataFrame({"anchor": a, "place": np.full(len(a), j + 1), "score": score, "id": ids})

    return _merged(rows.mapInPandas(run, "anchor int, place int, score long, id long"), ["anchor", "place"], k)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), steps: int = 256) -> DataFrame:
    """Hard negatives of `anchors` in `rows` (vec_id, label, vector; see usable()): anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(steps * x), and a score is an integer inner product (at the ends of long if beyond). An anchor's positives are
    its best rows of the same label, its negatives under each of them the best rows of other labels whose score is from
    window[0] to window[1] hundredths of the positive's. Ties go to the smaller vec_id. Rows of the anchor's own id
    are not its positives; rows of one id and score count once, and so do repeated anchors. Vectors of different lengths end in zeros.
    An anchor without a positive, or a positive without a negative, has no rows; neither has an empty table.

    Every anchor meets every row, in blocks: one job for each block of anchors and pass.
    """
    spark = rows.sparkSession
    anchors = anchors.select("vec_id", "label", "vector").distinct()
    n, dims = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = max(1, min(ANCHORS, ANCHOR_BYTES // (8 * max(1, dims or 0))))
    blocks = max(1, -(-2 * n // most)) if n > most // 2 else 1
    if blocks > 1:
        anchors = C.materialise(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks))), "anchors")
    out = []
    for b in range(blocks):
        held = _block(spark, anchors if blocks == 1 else anchors.where(F.col("block") == b), steps)
        if not len(held.ids):
            continue
        shared = spark.sparkContext.broadcast(held)
        best = _positives(rows, shared, steps, positives).toPandas()
        a, place = best["anchor"].to_numpy(np.int64), best["rank"].to_numpy(np.int64) - 1
        ids, score = (np.full((len(held.ids), positives), _NONE) for _ in range(2))
        ids[a, place], score[a, place] = best["id"], best["score"]
        bounds = [[-(-window[0] * int(s) // 100) if s != _NONE else 1 for s in r] for r in score], [[window[1] * int(s) // 100 if s != _NONE else 0 for s in r] for r in score]
        windows = spark.sparkContext.broadcast(tuple(np.array(x, np.int64).reshape(score.shape) for x in bounds))
        found = _negatives(rows, shared, windows, steps, negatives)
        names = spark.createDataFrame(
            pd.DataFrame({"anchor": a.astype(np.int32), "place": (place + 1).astype(np.int32), "anchor_id": held.ids[a], "positive_id": ids[a, place], "positive_score": score[a, place]}),
            "anchor int, place int, anchor_id long, positive_id long, positive_score long",
        )
        found = found.join(F.broadcast(names), ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.append(C.materialise(found, "negatives") if blocks > 1 else found)
    if blocks > 1:
        C.discard(anchors)
    if not out:
        return spark.createDataFrame([], _RESULT)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


#: op13_hard_negatives in DuckDB's SQL, over `embeddings`.
ORACLE_SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from r as a, r where a.vec_id % 100 = 0
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same and vec_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10"""
