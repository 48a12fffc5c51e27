"""Readers and writers of reviews, items, judgements and dimensions."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybrook import schemas
from tallybrook.operators.clean import last_wins
from tallybrook.sources.shared import materialise

# ---- JSON lines


#: Blocks of files whose places are broadcast (some 15 MB); beyond, lines are joined to them.
MOST_BLOCKS = 100_000


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """value, path, line (its number in the file), ord (by path and line, dense). Blank lines are skipped, but have a number.

    A task numbers its lines one after another, so within a block numbers are dense, with blank lines and without. Blocks are counted,
    their counts summed up in the order of path and block, and the sums go to the scan as a table of a row a block.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    every = files.select("value", *at, F.monotonically_increasing_id().alias("_line"))
    some = every.where(F.trim("value") != "").select("*", F.monotonically_increasing_id().alias("_place"))
    lines = every.groupBy("path", "block").agg(F.min("_line").alias("_first_line"), F.count("*").alias("_lines"))
    places = some.groupBy("path", "block").agg(F.min("_place").alias("_first_place"), F.count("*").alias("_places"))
    before = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = lines.join(places, ["path", "block"], "left").select(
        "path", "block",
        (F.coalesce(F.sum("_lines").over(before.partitionBy("path")), F.lit(0)) - F.col("_first_line") + 1).alias("_to_line"),
        (F.coalesce(F.sum("_places").over(before.partitionBy(F.lit(1))), F.lit(0)) - F.col("_first_place")).alias("_to_ord"),
    )
    blocks = materialise(blocks, "blocks")
    side = F.broadcast(blocks) if blocks.count() <= MOST_BLOCKS else blocks
    return some.join(side, ["path", "block"]).select("value", "path", (F.col("_line") + F.col("_to_line")).alias("line"), (F.col("_place") + F.col("_to_ord")).alias("ord"))


def _named(text: str) -> Column:
    return F.concat(F.lit(text), F.col("path"), F.lit(":"), F.col("line"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = schemas.REVIEW, malformed: str = "fail", glob: str = "*.jsonl") -> DataFrame:
    """Rows of every file below path with `ord`. A malformed line fails the read and is named by file and line, or (`drop`) is left out."""
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    broken = F.try_parse_json("value").isNull()
    rows = _lines(spark, path, glob)
    if malformed == "drop":
        rows = rows.where(~broken)
    else:
        named = F.concat(_named("malformed line in "), F.lit(": "), F.substring("value", 1, 200))
        rows = rows.withColumn("value", F.when(broken, F.raise_error(named)).otherwise(F.col("value")))
    return rows.select(parsed.alias("r"), "ord").select("r.*", "ord")


def read_if_there(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """A path that does not exist is an empty table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("ord", T.LongType())]))
    return read_jsonl(spark, path, schema, **options)


def read_strict(spark: SparkSession, path: str, fields: tuple[str, ...] = schemas.REVIEW_FIELDS, schema: T.StructType = schemas.REVIEW, glob: str = "page_*.jsonl") -> DataFrame:
    """As read_jsonl(), for rows whose keys are exactly these, in this order. No row at all is an error."""
    lines = _lines(spark, path, glob)
    if lines.isEmpty():
        raise ValueError(f"no rows in {path}")
    right = F.coalesce(F.json_object_keys("value") == F.array(*map(F.lit, fields)), F.lit(False))
    checked = lines.withColumn("value", F.when(~right, F.raise_error(_named("unexpected fields in "))).otherwise(F.col("value")))
    return checked.select(F.from_json("value", schema).alias("r"), "ord").select("r.*", "ord")


def read_cleaned(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """read_strict() of cleaned rows: the fields of reviews, then text_clean, text_hash and language."""
    return read_strict(spark, path, schemas.CLEAN_FIELDS, schemas.CLEAN, glob)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """complaint_id, gold_intent, variants of an authoring document, a JSON object with a list of `complaints`; anything else is an error."""
    held = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    right = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    complaints = F.from_json(F.to_json(F.try_variant_get("v", "$.complaints", "variant")), _COMPLAINTS)
    checked = F.when(F.coalesce(right, F.lit(False)), complaints).otherwise(F.raise_error(F.lit("a pilot document must be a JSON object")))
    return held.select(F.explode(checked).alias("c")).select("c.*")


_COMPLAINTS = "array<struct<complaint_id: string, gold_intent: string, variants: map<string, struct<text: string, fact_span: string>>>>"


def write_jsonl(df: DataFrame, path: str) -> None:
    """Through Spark's commit protocol: a reader sees all of it or nothing."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


# ---- collected rows


def from_google(pages: DataFrame, app_id: str, product_id: str) -> DataFrame:
    """Store rows (reviewId, content, score, at, reviewCreatedVersion, thumbsUpCount) as reviews."""
    at = F.col("at")
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss") if dict(pages.dtypes)["at"].startswith("timestamp") else at
    return pages.select(
        F.col("reviewId").alias("review_id"), F.lit("google_play").alias("platform"), F.lit(app_id).alias("platform_app_id"), F.lit(product_id).alias("product_id"), F.col("content").alias("text"),
        F.col("score").cast("int").alias("rating"), stamp.alias("timestamp"), F.col("reviewCreatedVersion").alias("app_version"), F.col("thumbsUpCount").cast("long").alias("helpful_count"),
    )


def from_apple(entries: DataFrame, app_id: str, product_id: str) -> DataFrame:
    """Feed entries (a JSON column `entry`, values under `label`) as reviews; numbers that are none are null."""

    def label(path: str) -> Column:
        return F.get_json_object("entry", f"$['{path}'].label")

    return entries.select(
        label("id").alias("review_id"), F.lit("apple_app_store").alias("platform"), F.lit(app_id).alias("platform_app_id"), F.lit(product_id).alias("product_id"), label("content").alias("text"),
        label("im:rating").try_cast("int").alias("rating"), label("updated").alias("timestamp"), label("im:version").alias("app_version"), label("im:voteCount").try_cast("long").alias("helpful_count"),
    )


# ---- items and judgements


def _either(value: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(value, f"$.{n}", "string"), F.lit("")) for n in names])


def _answers(value: Column) -> Column:
    """A map of answers, each text or {intent}; empty ones go. The JSON's key order is kept."""
    raw = F.from_json(F.to_json(value), "map<string,string>")
    plain = F.transform_values(raw, lambda _, v: F.coalesce(F.get_json_object(v, "$.intent"), F.when(~v.startswith("{"), v)))
    return F.map_filter(plain, lambda _, v: v.isNotNull() & (v != ""))


def items(lines: DataFrame, column: str = "value") -> DataFrame:
    """Items of JSON lines, by their usual names or older ones; what is not known is meta. A line without an id fails."""
    v = F.parse_json(column)
    ident = _either(v, "id", "review_id")
    known = ("id", "review_id", "text", "text_scrubbed", "text_clean", "meta", "predictions", "models")
    rest = F.map_filter(F.from_json(column, "map<string,string>"), lambda k, x: ~k.isin(*known) & x.isNotNull())
    meta = F.coalesce(F.from_json(F.to_json(F.try_variant_get(v, "$.meta", "variant")), "map<string,string>"), rest)
    models = F.coalesce(F.try_variant_get(v, "$.predictions", "variant"), F.try_variant_get(v, "$.models", "variant"))
    checked = F.when(ident.isNull(), F.raise_error(F.lit("an item has no id")).cast("string")).otherwise(ident)
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return lines.select(checked.alias("id"), F.coalesce(_either(v, "text", "text_scrubbed", "text_clean"), F.lit("")).alias("text"), meta.alias("meta"), F.coalesce(_answers(models), empty).alias("predictions"), *(["ord"] if "ord" in lines.columns else []))


def judgements(lines: DataFrame, column: str = "value") -> DataFrame:
    """Judgements of JSON lines with ord; of one item the last counts, and first_ord is the place of its first."""
    v = F.parse_json(column)

    def get(name: str, kind: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", kind)

    rows = lines.select(
        _either(v, "item_id", "review_id", "id").alias("item_id"), _either(v, "label", "human_intent", "intent").alias("label"), _either(v, "secondary", "intent_secondary").alias("secondary"),
        F.from_json(F.to_json(get("flags", "variant")), "map<string,boolean>").alias("flags"), F.coalesce(get("notes", "string"), F.lit("")).alias("notes"), F.coalesce(get("skipped", "boolean"), F.lit(False)).alias("skipped"),
        F.coalesce(get("blind", "boolean"), F.lit(True)).alias("blind"), F.coalesce(get("label_version", "int"), F.lit(0)).alias("label_version"),
        _answers(F.coalesce(get("predictions", "variant"), get("models", "variant"))).alias("predictions"), "ord",
    )
    return last_wins(rows, "item_id")


# ---- configuration


def _yaml(path: str):
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


# The stores' hosts.
PLATFORM_HOSTS = {"google_play": "play.google.com", "apple_app_store": "apps.apple.com"}


def wrong_addresses(listings: DataFrame) -> DataFrame:
    """Listings (platform, store_url) whose address is not https, or not on their platform's host."""
    host = F.coalesce(*[F.when(F.col("platform") == p, h) for p, h in PLATFORM_HOSTS.items()], F.lit(""))
    url = F.coalesce("store_url", F.lit(""))
    right = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.lower(F.try_parse_url(url, F.lit("HOST"))) == host)
    return listings.where(~F.coalesce(right, F.lit(False)))


def confirmed_apps(apps: DataFrame, names: set[str] | None = None) -> DataFrame:
    """Apps (name, confirmed) that are chosen. Unknown names, none at all, or one that nobody confirmed is an error that names them."""
    chosen = apps if names is None else apps.where(F.col("name").isin(*names))
    found = {r.name: bool(r.confirmed) for r in chosen.select("name", "confirmed").collect()}  # configuration: a few rows
    if missing := sorted((names or set()) - set(found)):
        raise ValueError(f"unknown apps: {', '.join(missing)}")
    if not found:
        raise ValueError("no apps")
    if waiting := sorted(n for n, sure in found.items() if not sure):
        raise ValueError(f"not confirmed by a person: {', '.join(waiting)}")
    return chosen


def confirmed_listings(listings: DataFrame, platform: str, products: set[str] | None = None) -> DataFrame:
    """Confirmed listings of a platform; chosen products that have none are an error."""
    out = listings.where((F.col("platform") == platform) & F.col("confirmed"))
    if products is None:
        return out
    out = out.where(F.col("product_id").isin(*products))
    if missing := sorted(products - {r.product_id for r in out.select("product_id").distinct().collect()}):
        raise ValueError(f"unknown or unconfirmed products: {', '.join(missing)}")
    return out


def quotas(spark: SparkSession, path: str, key: str = "google_quotas") -> DataFrame:
    """platform_app_id, quota of a configuration file; a file that is not there has none."""
    data = (_yaml(path) or {}).get(key) or {} if Path(path).exists() else {}
    if not isinstance(data, dict):
        raise ValueError(f"{key} in {path} must be a mapping")
    return spark.createDataFrame([(str(k), int(v)) for k, v in data.items()], "platform_app_id string, quota long")


def roster(source: str | dict, providers: tuple[str, ...]) -> list[dict]:
    """Models to ask: id, provider and label are needed, ids differ, providers are known; prices are 0 and a request takes 0.5 s unless told."""
    data = _yaml(source) if isinstance(source, str) else source
    models, seen = (data or {}).get("models") or [], set()
    if not models:
        raise ValueError("the roster is empty")
    out = []
    for m in models:
        if lacking := [k for k in ("id", "provider", "label") if not m.get(k)]:
            raise ValueError(f"a model lacks {lacking}")
        if m["provider"] not in providers:
            raise ValueError(f"{m['id']}: provider {m['provider']!r} is none of {', '.join(providers)}")
        if m["id"] in seen:
            raise ValueError(f"model {m['id']} is there twice")
        seen.add(m["id"])
        out.append({"price_per_mtok_input": 0.0, "price_per_mtok_output": 0.0, "min_request_interval": 0.5, "effort": None, "disable_thinking": False} | m)
    return out


def judged_ids(judgements: DataFrame, key: str = "item_id") -> DataFrame:
    """What needs no judging again when a pass is resumed."""
    return judgements.select(key).where(F.col(key).isNotNull()).distinct()


def token_json(token: Column) -> Column:
    """A continuation token (a struct) as JSON, empty fields too; null stays null."""
    return F.when(token.isNotNull(), F.to_json(token, {"ignoreNullFields": "false"}))


def token_of(value: Column) -> Column:
    return F.from_json(value, schemas.TOKEN)


def judgement_json(columns: tuple[str, ...] = ("item_id", "label", "secondary", "flags", "notes", "skipped", "blind", "label_version", "predictions")) -> Column:
    """A judgement as a JSON line, its fields in this order, empty ones too."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def label_groups(labels: DataFrame) -> DataFrame:
    """grp, ids: labels (id, group, ord) by group, groups and ids in the order of their declaration; without a group: `labels`."""
    grp = F.coalesce(F.nullif("group", F.lit("")), F.lit("labels"))
    out = labels.groupBy(grp.alias("grp")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda e: e["id"]).alias("ids"), F.min("ord").alias("ord"))
    return out.select("grp", "ids", "ord")


def registry(spark: SparkSession, source: str | dict) -> DataFrame:
    """Listings with their product's fields. Problems in the file are all named in one error."""
    data = _yaml(source) if isinstance(source, str) else source
    rows, problems, seen, products = [], [], set(), set()
    for p in data.get("products") or []:
        if p["product_id"] in products:
            problems.append(f"product {p['product_id']} is there twice")
        products.add(p["product_id"])
        for e in p.get("listings") or []:
            key = (e["platform"], e["platform_app_id"])
            if key in seen:
                problems.append(f"listing {key} is there twice")
            seen.add(key)
            at = urlparse(str(e.get("store_url", "")))
            if e["platform"] not in PLATFORM_HOSTS:
                problems.append(f"listing {key} is on an unknown platform")
            elif at.scheme != "https" or at.hostname != PLATFORM_HOSTS[e["platform"]]:
                problems.append(f"listing {key} has no https address of its platform")
            rows.append({f.name: e.get(f.name, p.get(f.name)) for f in schemas.LISTING.fields})
        if p.get("inclusion_tier") == "core" and len({e["platform"] for e in p.get("listings") or []}) < 2:
            problems.append(f"core product {p['product_id']} is not on both platforms")
    if not rows:
        problems.append("no listing")
    if problems:
        raise ValueError("; ".join(problems))
    return spark.createDataFrame(rows, schemas.LISTING)


def labels_dim(spark: SparkSession, source: str | dict) -> DataFrame:
    """Labels of a label set or taxonomy: id, family, definition, positive_examples, negative_example, version."""
    data = _yaml(source) if isinstance(source, str) else source
    entries = data.get("labels") or data.get("intents") or []
    ids = [e.get("id") for e in entries]
    if not ids or not all(ids) or len(set(ids)) != len(ids):
        raise ValueError("labels need distinct ids")
    if "intents" in data:
        for e in entries:
            if not all(e.get(k) for k in ("id", "family", "definition", "positive_examples", "negative_example", "negative_rationale")) or len(e["positive_examples"]) != 2:
                raise ValueError(f"intent {e['id']} lacks a field, or has not two examples")
    rows = [(e["id"], e.get("family") or e.get("group") or "", e.get("definition") or "", list(e.get("positive_examples") or []), e.get("negative_example") or "", int(data.get("version") or 0)) for e in entries]
    return spark.createDataFrame(rows, "id string, family string, definition string, positive_examples array<string>, negative_example string, version int")


def authored_variants(payload: DataFrame) -> DataFrame:
    """complaint_id, gold_intent, language, text, fact_span of authored complaints (variants: form -> text and span)."""
    return payload.select("complaint_id", "gold_intent", F.explode("variants").alias("language", "v")).select("complaint_id", "gold_intent", "language", "v.text", "v.fact_span")


def authored_problems(variants: DataFrame, intents: list[str], forms: int = 4) -> DataFrame:
    """complaint_id, problem: an unknown intent, a span that its text does not hold, or a missing form."""
    wrong = F.when(~F.col("gold_intent").isin(*intents), "unknown intent").when(~F.contains("text", F.col("fact_span")), "span is not in the text")
    one = variants.select("complaint_id", wrong.alias("problem")).where("problem is not null")
    return one.unionByName(variants.groupBy("complaint_id").agg(F.countDistinct("language").alias("n")).where(F.col("n") != forms).select("complaint_id", F.lit("forms are missing").alias("problem")))
