"""Row types of the engine. Every frame that feeds an order-sensitive operator also carries `ord`, its ingest ordinal."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEW_FIELDS = ("review_id", "platform", "platform_app_id", "product_id", "text", "rating", "timestamp", "app_version", "helpful_count")
CLEAN_FIELDS = (*REVIEW_FIELDS, "text_clean", "text_hash", "language")

_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "LONG": T.LongType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}


def of(text: str) -> T.StructType:
    """A struct of `name TYPE` pairs; MAP<TYPE> is a map from strings. Needs no session, so workers can import it."""
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        held = kind.removeprefix("MAP<").removesuffix(">")
        fields.append(T.StructField(name, T.MapType(T.StringType(), _TYPES[held]) if held != kind else _TYPES[kind]))
    return T.StructType(fields)


REVIEW = of("review_id STRING, platform STRING, platform_app_id STRING, product_id STRING, text STRING, rating INT, timestamp STRING, app_version STRING, helpful_count LONG")
CLEAN = T.StructType([*REVIEW.fields, *of("text_clean STRING, text_hash STRING, language STRING").fields])
LABEL = of("intent STRING, intent_secondary STRING, refund_requested BOOLEAN, language STRING, severity STRING, confidence DOUBLE, rationale STRING")
ITEM = of("id STRING, text STRING, meta MAP<STRING>, predictions MAP<STRING>")
JUDGEMENT = of("item_id STRING, label STRING, secondary STRING, flags MAP<BOOLEAN>, notes STRING, skipped BOOLEAN, blind BOOLEAN, label_version INT, predictions MAP<STRING>")
TOKEN = of("token STRING, lang STRING, country STRING, sort INT, count INT, filter_score_with INT, filter_device_with INT")
LISTING = of(
    "product_id STRING, display_name STRING, brand_group STRING, vertical STRING, inclusion_tier STRING, platform STRING, platform_app_id STRING, bundle_id STRING, store_title STRING, developer STRING, store_url STRING, confirmed BOOLEAN"
)
