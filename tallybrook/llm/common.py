"""What the operators share: the shared folder, partition counts, null-safe columns and packed rows.

Rows of one task that go to one place travel as a few packed binary columns (a NumPy array each),
so a corpus-wide exchange costs bytes rather than rows.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are ordered: before every other id.
NULL_ID = -(2**63)


#: Tables that materialise() wrote and discard() has not deleted, with the file system of each.
_WRITTEN: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a local session (tests) gets a folder of its own; on a cluster that is an error, as the
    executors would not see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallybrook-"))
            at = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = at.get()
    return base.rstrip("/")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN[path] = (at, at.getFileSystem(spark._jsc.hadoopConfiguration()))
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tallybrook_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes what materialise() wrote for these frames, through Hadoop's file system."""
    for df in frames:
        at, files = _WRITTEN.pop(df._tallybrook_path)
        files.delete(at, True)


@atexit.register
def discard_all() -> None:
    """Deletes every table that is left: results that were returned read from them, so they last as long as the program, or until this is called."""
    while _WRITTEN:
        _, (at, files) = _WRITTEN.popitem()
        try:
            files.delete(at, True)
        except Exception:  # the JVM may be gone
            return


def partitions(spark: SparkSession) -> int:
    """Buckets of an exchange: the session's shuffle partitions, so they follow the cluster's sizing."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sized(df: DataFrame, mb: int = 8) -> int:
    """Buckets of about `mb` megabytes of what df's plan reads, however many that are.

    A small input gets two for each core at least, where the session has as many shuffle partitions; so does one whose
    size Spark doesn't know (rows of an RDD): that gets the shuffle partitions.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size >= 1 << 60:
        return partitions(spark)
    return max(1, -(-size // (mb << 20)), min(partitions(spark), 2 * spark.sparkContext.defaultParallelism))


def ids(column: pd.Series) -> np.ndarray:
    """Ids as int64; null is NULL_ID."""
    if column.dtype == np.int64:
        return column.to_numpy()
    return np.array([NULL_ID if gone else int(x) for x, gone in zip(column.astype(object), column.isna(), strict=True)], np.int64)


def id_or_null(values: np.ndarray | pd.Series) -> pd.Series:
    """The way back from ids() and id_column()."""
    values = np.asarray(values, np.int64)
    return pd.Series(values).astype("Int64").mask(values == NULL_ID)


def texts(column: pd.Series) -> list[str]:
    """Texts; null is the empty text."""
    return [x if isinstance(x, str) else "" for x in column]


def id_column(name: str = "doc_id"):
    """Ids for Python, where a null among them would turn all into floats: null is NULL_ID."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)).alias(name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.r_[starts[1:], len(keys)]


def split_packed(columns: dict[str, np.ndarray], to: np.ndarray, key: str = "b", **constant) -> pd.DataFrame | None:
    """A row for each value of `to`, holding its elements of every column as bytes; element order is kept within a row."""
    if not len(to):
        return None
    order = np.argsort(to, kind="stable")
    goal = to[order]
    starts, ends = runs(goal)
    out = {key: goal[starts].astype(np.int32)}
    for name, values in columns.items():
        values = np.ascontiguousarray(values[order])
        width = values.dtype.itemsize
        raw = values.tobytes()
        out[name] = [raw[s * width : e * width] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pd.DataFrame(out | constant)


def unpack(frames: Iterable[pd.DataFrame], dtypes: dict[str, str]) -> dict[str, np.ndarray]:
    """Joins the packed columns of many rows."""
    parts: dict[str, list[bytes]] = {k: [] for k in dtypes}
    for frame in frames:
        for k, held in parts.items():
            held.extend(frame[k])
    return {k: np.frombuffer(b"".join(v), dtypes[k]) for k, v in parts.items()}


def whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """All rows of a task as one frame; the caller's exchange bounds a task's share."""
    held = list(batches)
    if not held:
        return None
    return held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def release() -> None:
    """Gives back memory that a task no longer uses: Python workers live on, and share the executor with later stages."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def in_order(doc_ids: np.ndarray, values: list[str]) -> np.ndarray:
    """Row order by id, ties by text."""
    order = np.argsort(doc_ids, kind="stable")
    s, e = runs(doc_ids[order])
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        if b - a > 1:
            order[a:b] = sorted(order[a:b].tolist(), key=lambda k: values[k])
    return order


def xxh64_long(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of int64 values as Spark's xxhash64() computes it, signed."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    with np.errstate(over="ignore"):
        h = np.uint64(seed) + p5 + np.uint64(8)
        h = turn((turn(values.astype(np.uint64) * p2, 31) * p1) ^ h, 27) * p1 + p4
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _murmur3_int(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash() of int values, by which it deals rows out."""
    with np.errstate(over="ignore"):
        k = values.astype(np.uint32) * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h = np.uint32(seed) ^ k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h.view(np.int32)


def bucket_keys(n: int) -> np.ndarray:
    """One int key for each of n hash partitions, so that buckets fill partitions evenly."""
    keys, lot = np.full(n, -1, np.int64), np.arange(0)
    start = 0
    while (keys < 0).any():
        lot = np.arange(start, start + 8 * n + 64, dtype=np.int64)
        at = _murmur3_int(lot).astype(np.int64) % n
        free = keys[at] < 0
        keys[at[free][::-1]] = lot[free][::-1]
        start = lot[-1] + 1
    return keys


class _Numbers:
    """Each place is its own key; places count from either end, as in a list."""

    def __init__(self, n: int):
        self.n = n

    def __getitem__(self, place):
        return np.asarray(place, np.int64) % self.n


class Buckets:
    """n buckets with one key each; a place is the same in SQL and in NumPy.

    Up to EVEN buckets the keys fill the partitions of an exchange one each. Beyond, where keys are too many to be
    listed in a plan, a bucket's number is its key, and a partition gets a few buckets or none.
    """

    EVEN = 4096

    def __init__(self, n: int):
        self.n = n
        self.keys = bucket_keys(n) if n <= self.EVEN else _Numbers(n)

    def at(self, place):
        """The key of a column of places from 0 to n - 1."""
        return (F.element_at(F.lit([int(k) for k in self.keys]), (place + 1).cast("int")) if self.n <= self.EVEN else place).cast("int")

    def column(self, of: str = "doc_id", salt=None):
        h = F.xxhash64(F.coalesce(F.col(of).cast("long"), F.lit(NULL_ID)))
        return self.at(F.pmod(h if salt is None else h.bitwiseXOR(salt), F.lit(self.n)))

    def of_ids(self, values: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return self.keys[(xxh64_long(values) ^ salt) % self.n]

    def of_hashes(self, values: np.ndarray) -> np.ndarray:
        return self.keys[(values % np.uint64(self.n)).astype(np.int64)]
