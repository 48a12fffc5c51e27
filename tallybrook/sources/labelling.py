"""What a labelling model is told, what it may answer, and the files and addresses that collection starts from."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook import schemas

# The label of texts that no intent fits, and the address of a page of reviews.
NO_INTENT = "unclassifiable"
APPLE_PAGE = "https://itunes.apple.com/{country}/rss/customerreviews/page={page}/id={app}/sortBy=mostRecent/json"

# What an authored set has to cover, and its number of complaints.
SCENARIOS = {
    "unauthorized deduction/VAS": ("unauthorized_vas_deduction",),
    "failed transfer with deduction": ("transfer_failed_money_deducted",),
    "OTP/login failure": ("otp_not_received", "login_failure"),
    "KYC/account block": ("kyc_verification_stuck", "account_blocked_frozen"),
    "network/service complaint": ("network_coverage_complaint", "data_speed_complaint", "service_outage_report"),
}
AUTHORED = 20


def instructions(taxonomy: dict, languages: tuple[str, ...], severities: tuple[str, ...], task: str = "Label the customer text with the one intent that fits it best.") -> str:
    """The prompt for a taxonomy (intents: id, family, definition, examples, what is none of it and why)."""
    blocks = [
        "\n".join(
            [f"* {e['id']} [{e['family']}]: {e['definition'].strip()}"]
            + [f"  example: {x}" for x in e["positive_examples"]]
            + [f"  no example: {e['negative_example']} ({e['negative_rationale'].strip()})"]
        )
        for e in taxonomy["intents"]
    ]
    rules = (
        f"language: one of {', '.join(languages)}",
        f"severity: one of {', '.join(severities)}",
        f"intent: {NO_INTENT} where none of the intents fits",
        "intent_secondary: another matter that the text tells of too, else null",
        "refund_requested: whether money is asked back, whatever the intent",
        "confidence: from 0 to 1",
        "rationale: one sentence",
    )
    return "\n\n".join([task, *blocks, "\n".join(rules)])


def reply_schema(intents: list[str], languages: tuple[str, ...], severities: tuple[str, ...]) -> dict:
    """The JSON schema of a reply: fields of schemas.LABEL, all needed, their values bound to the vocabulary."""
    kinds = {"string": {"type": "string"}, "boolean": {"type": "boolean"}, "double": {"type": "number"}}
    fields = {f.name: kinds[f.dataType.typeName()] for f in schemas.LABEL.fields}
    for name, words in (("intent", [*intents, NO_INTENT]), ("language", languages), ("severity", severities)):
        fields[name] = {"type": "string", "enum": list(words)}
    fields["intent_secondary"] = {"anyOf": [{"type": "string", "enum": list(intents)}, {"type": "null"}]}
    return {"type": "json_schema", "schema": {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}}


def outside_vocabulary(rows: DataFrame, allowed: dict[str, list[str]], optional: tuple[str, ...] = ()) -> DataFrame:
    """field, value, n: values that a field may not have. Null is one of them, but for optional fields.

    One pass for all fields; counts are combined before the exchange.
    """
    held = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), _outside(f, words, f in optional).alias("out")) for f, words in allowed.items()])
    return rows.select(F.inline(F.filter(held, lambda e: e["out"]))).groupBy("field", "value").agg(F.count("*").alias("n"))


def _outside(field: str, words: list[str], optional: bool) -> Column:
    return F.coalesce(~F.col(field).cast("string").isin(*words), F.lit(not optional))


def authored_gaps(variants: DataFrame, scenarios: dict[str, tuple[str, ...]] | None = None, complaints: int = AUTHORED) -> DataFrame:
    """problem: a wrong number of complaints, and scenarios of which the set has none. No row: the set is whole."""
    scenarios = SCENARIOS if scenarios is None else scenarios
    wanted = sorted({i for intents in scenarios.values() for i in intents})
    has = variants.agg(F.countDistinct("complaint_id").alias("n"), F.collect_set(F.when(F.col("gold_intent").isin(*wanted), F.col("gold_intent"))).alias("intents"))
    number = F.when(F.col("n") != complaints, F.concat(F.col("n").cast("string"), F.lit(f" complaints, not {complaints}")))
    missing = [F.when(~F.arrays_overlap("intents", F.array(*map(F.lit, intents))), F.lit(f"nothing of {name}")) for name, intents in scenarios.items()]
    return has.select(F.explode(F.array_compact(F.array(number, *missing))).alias("problem"))


def apple_page_address(app: Column, page: Column, country: str = "pk") -> Column:
    """Address of a page of a listing's reviews, newest first; null if the listing or the page is."""
    head, rest = APPLE_PAGE.replace("{country}", country).split("{page}")
    middle, tail = rest.split("{app}")
    return F.concat(F.lit(head), page.cast("string"), F.lit(middle), app.cast("string"), F.lit(tail))


def retry_delays(retries: int = 4, first: float = 2.0) -> list[float]:
    """Seconds to wait before each further try: doubled every time."""
    return [first * 2**k for k in range(retries)]


def write_apps(apps: list[dict], path: str) -> None:
    """Apps as a configuration file, in their order and with their fields' order; replaced as a whole. None becomes confirmed by it."""
    import yaml

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.part")
    part.write_text(yaml.safe_dump({"apps": list(apps)}, sort_keys=False, allow_unicode=True), encoding="utf-8")
    os.replace(part, target)
