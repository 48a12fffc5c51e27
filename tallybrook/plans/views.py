"""The engine in SQL: views over corpus, items and judgements, and functions over these views, for the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.functions import stats as S
from tallybrook.functions import text as X
from tallybrook.operators import facets, scoring

#: name, parameters, result and body of scalar functions; all of them are plain SQL, so the optimizer sees through them.
_SCALARS = (
    ("share_pct", "hits BIGINT, total BIGINT", "DOUBLE", "CASE WHEN total = 0 THEN NULL ELSE bround(100D * hits / total, 1) END"),
    (
        "wilson_low", "hits BIGINT, total BIGINT", "DOUBLE",
        "CASE WHEN total = 0 THEN 0D ELSE bround(100 * greatest(0D, ((hits / total + {zz}D / (2D * total)) / (1 + {zz}D / total)) - {z}D * sqrt(hits / total * (1 - hits / total) / total + {zz}D / (4D * total * total)) / (1 + {zz}D / total)), 1) END",
    ),
    (
        "wilson_high", "hits BIGINT, total BIGINT", "DOUBLE",
        "CASE WHEN total = 0 THEN 0D ELSE bround(100 * least(1D, ((hits / total + {zz}D / (2D * total)) / (1 + {zz}D / total)) + {z}D * sqrt(hits / total * (1 - hits / total) / total + {zz}D / (4D * total * total)) / (1 + {zz}D / total)), 1) END",
    ),
)

_TABLES = (
    (
        "review_report", "of_product STRING, of_language STRING", "section STRING, key STRING, total BIGINT, bad BIGINT, bad_pct DOUBLE, low DOUBLE, high DOUBLE",
        """SELECT section, key, total, bad, share_pct(bad, total), wilson_low(bad, total), wilson_high(bad, total)
FROM (SELECT CASE WHEN grouping(product) = 0 THEN 'product' WHEN grouping(language) = 0 THEN 'language' WHEN grouping(version) = 0 THEN 'release' WHEN grouping(month) = 0 THEN 'month' ELSE 'all' END AS section,
        coalesce(product, language, version, month) AS key, count(*) AS total, count_if(is_bad) AS bad
      FROM review_facts WHERE (of_product IS NULL OR product = of_product) AND (of_language IS NULL OR language = of_language)
      GROUP BY GROUPING SETS ((product), (language), (version), (month), ()))""",
    ),
    (
        "score", "by STRING", "section STRING, model STRING, grp STRING, hits BIGINT, total BIGINT, rate DOUBLE, low DOUBLE, high DOUBLE",
        """SELECT section, model, grp, hits, total, share_pct(hits, total), wilson_low(hits, total), wilson_high(hits, total)
FROM (SELECT CASE WHEN grouping(grp) = 0 THEN 'group' ELSE 'model' END AS section, model, grp, count_if(correct) AS hits, count(*) AS total
      FROM (SELECT model, correct, coalesce(try_element_at(meta, by), 'None') AS grp FROM scored_answers) GROUP BY GROUPING SETS ((model), (model, grp)))
WHERE section = 'model' OR by IS NOT NULL""",
    ),
)


def register(spark: SparkSession, reviews: DataFrame | None = None, items: DataFrame | None = None, judgements: DataFrame | None = None, z: float = S.Z) -> list[str]:
    """Views and functions of what is given; returns their names. Those of the same names in the session are replaced.

    reviews (see facets.review_view): `reviews`, `review_facts` and review_report(product, language), null for all. items and judgements:
    `items`, `judgements`, `scored_answers` (a row for each answer of a model to an item that a person judged) and score(by),
    by a field of meta or null.
    """
    made = []

    def view(df: DataFrame, name: str) -> None:
        df.createOrReplaceTempView(name)
        made.append(name)

    for name, takes, gives, body in _SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body.format(z=repr(z), zz=repr(z * z))}")
        made.append(name)
    if reviews is not None:
        view(reviews, "reviews")
        view(facets.review_view(reviews).select("id", "product", "language", F.nullif("version", F.lit("")).alias("version"), F.substring("date", 1, 7).alias("month"), X.is_bad(F.col("rating")).alias("is_bad")), "review_facts")
    if items is not None and judgements is not None:
        view(items, "items")
        view(judgements, "judgements")
        pairs = scoring.eligible(items, judgements)
        view(scoring.scored_answers(pairs), "scored_answers")
    for name, takes, gives, body in _TABLES:
        if (reviews is not None) if name == "review_report" else (items is not None and judgements is not None):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({gives}) RETURN {body}")
            made.append(name)
    return made
