"""JSON lines parsed once: good rows on one side, the others with a reason each on the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook.sources.shared import discard, materialise

#: Types that a variant may have where a field of this kind is wanted.
_FITS = {
    "string": ("STRING",), "int": ("BIGINT",), "bigint": ("BIGINT",), "double": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",),
}


def _reason(v: Column, schema: T.StructType, required: tuple[tuple[str, ...], ...]) -> Column:
    """Why a parsed line is bad, or null: not JSON, not an object, none of a required field's names, or a field of another type."""

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    reason = F.when(v.isNull(), "not JSON").when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not an object")
    for names in required:
        given = [F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) != "" for n in names]
        some = given[0]
        for g in given[1:]:
            some = some | g
        reason = reason.when(~some, f"no {names[0]}")
    for field in schema.fields:
        own = kind(f"$.{field.name}")
        fits = _FITS.get(field.dataType.simpleString())
        right = F.regexp_extract(own, "^[A-Z]+", 0).isin(*fits, "VOID") if fits else F.startswith(own, F.lit("OBJECT")) | F.startswith(own, F.lit("ARRAY")) | (own == "VOID")
        reason = reason.when(~F.coalesce(right, F.lit(True)), f"{field.name} is of another type")
    return reason


def judged_lines(lines: DataFrame, schema: T.StructType, required: tuple[tuple[str, ...], ...] = (("review_id",),), column: str = "value") -> DataFrame:
    """lines with `row` (of schema; null for a bad line) and `reason` (null for a good one). Blank lines are no lines.

    required: for each field that must be there the names that it may have; an empty text is none.
    """
    parsed = lines.where(F.trim(column) != "").withColumn("_v", F.try_parse_json(column))
    judged = parsed.withColumn("reason", _reason(F.col("_v"), schema, required)).drop("_v")
    return judged.withColumn("row", F.when(F.col("reason").isNull(), F.from_json(column, schema)))


def split_lines(lines: DataFrame, schema: T.StructType, good: str, bad: str, required: tuple[tuple[str, ...], ...] = (("review_id",),), column: str = "value") -> dict[str, int]:
    """Writes good rows (Parquet) and bad lines with their reason (Parquet), from one parse; returns lines, good and bad."""
    seen = Observation()
    judged = judged_lines(lines, schema, required, column)
    held = materialise(judged.observe(seen, F.count("*").alias("lines"), F.count("reason").alias("bad")), "lines")
    held.where("reason is null").select("row.*", *[c for c in lines.columns if c != column]).write.mode("overwrite").parquet(good)
    held.where("reason is not null").drop("row").write.mode("overwrite").parquet(bad)
    discard(held)
    found = dict(seen.get)
    return found | {"good": found["lines"] - found["bad"]}
