"""Digests of files, for reports that name what they were made from."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.sources.paged import _at

#: Files up to this size are hashed as a column; longer ones are read in pieces.
WHOLE, PIECE = 64 << 20, 1 << 20


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, sha256 of every file below a path (or of the one file that it is). Empty files, which Spark doesn't read, are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)

    def pieces(batches):
        for frame in batches:
            out = []
            for name in frame["path"]:
                digest = hashlib.sha256()
                held, at = _at(name)
                with held.open_input_stream(at) as stream:
                    while piece := stream.read(PIECE):
                        digest.update(piece)
                out.append(digest.hexdigest())
            yield frame.assign(sha256=out)

    small = files.where(F.col("length") <= WHOLE).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > WHOLE).select("path", "length").mapInPandas(pieces, "path string, length long, sha256 string")
    return small.unionByName(large)


def sample_digests(spark: SparkSession, source: str, sampled: str, glob: str = "*") -> DataFrame:
    """role (input, output), name (below its path), length, sha256: with a sample's report, so that it can be drawn again."""
    out = None
    for role, path in (("input", source), ("output", sampled)):
        one = file_digests(spark, path, glob).select(F.lit(role).alias("role"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256")
        out = one if out is None else out.unionByName(one)
    return out
