import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallybrook import schemas
from tallybrook.operators import clean
from tallybrook.sources import reviews as R
from tallybrook.streaming import refresh

REVIEW = dict(review_id="a", platform="google_play", platform_app_id="com.app", product_id="p", text="one two three", rating=5, timestamp="2026-01-01", app_version="1", helpful_count=0)


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")


def test_json_lines(spark, tmp_path):
    write(tmp_path / "b" / "page_1.jsonl", [REVIEW | {"review_id": "3"}, "", REVIEW | {"review_id": "4", "text": None}])
    write(tmp_path / "a" / "page_1.jsonl", [REVIEW | {"review_id": "1"}, "  ", REVIEW | {"review_id": "2"}])
    rows = R.read_jsonl(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.review_id, r.ord) for r in rows] == [("1", 0), ("2", 1), ("3", 2), ("4", 3)]
    assert R.read_strict(spark, str(tmp_path)).count() == 4
    write(tmp_path / "c" / "page_1.jsonl", ["{broken"])
    assert R.read_jsonl(spark, str(tmp_path), malformed="drop").count() == 4
    write(tmp_path / "c" / "page_1.jsonl", [REVIEW, "", "{broken"])
    with pytest.raises(PySparkException, match=r"malformed line in .*c/page_1.jsonl:3: \{broken"):
        R.read_jsonl(spark, str(tmp_path)).collect()
    write(tmp_path / "c" / "page_1.jsonl", [dict(reversed(REVIEW.items()))])
    with pytest.raises(PySparkException, match=r"unexpected fields in .*c/page_1.jsonl:1"):
        R.read_strict(spark, str(tmp_path)).collect()
    assert R.read_if_there(spark, str(tmp_path / "none"), schemas.REVIEW).count() == 0
    out = str(tmp_path / "out")
    R.write_jsonl(R.read_jsonl(spark, str(tmp_path / "a")).drop("ord"), out)
    assert R.read_jsonl(spark, out, glob="*.json").count() == 2


@pytest.mark.parametrize("most", [R.MOST_BLOCKS, 0])
def test_ordinals_and_line_numbers_over_many_blocks(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_BLOCKS", most)
    want, n = [], 0
    for name in ("a", "b", "c"):
        rows = ["" if k % 7 == 3 or k < 5 else json.dumps(REVIEW | {"review_id": f"{name}{k}", "text": "x" * (k % 90)}) for k in range(400)]
        write(tmp_path / f"{name}.jsonl", rows)
        for k, row in enumerate(rows):
            if row:
                want.append((n, f"{name}.jsonl", k + 1, f"{name}{k}"))
                n += 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = R._lines(spark, str(tmp_path), "*.jsonl")
        assert not most or "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        found = sorted((r.ord, r.path.rsplit("/", 1)[1], r.line, json.loads(r.value)["review_id"]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == want


def test_items_and_judgements(spark):
    lines = [
        {"id": "a", "text": "t", "meta": {"lang": "ur"}, "predictions": {"m": "x", "n": {"intent": "y"}, "o": "", "p": None}},
        {"review_id": "b", "text_scrubbed": "s", "text_clean": "c", "models": {"m": "x"}, "rating": 2, "language": "en"},
    ]
    df = spark.createDataFrame([(json.dumps(x), k) for k, x in enumerate(lines)], "value string, ord long")
    a, b = R.items(df).orderBy("ord").collect()
    assert a.predictions == {"m": "x", "n": "y"} and a.meta == {"lang": "ur"}
    assert (b.id, b.text, b.meta, b.predictions) == ("b", "s", {"rating": "2", "language": "en"}, {"m": "x"})
    with pytest.raises(PySparkException, match="no id"):
        R.items(spark.createDataFrame([('{"text": "x"}',)], "value string")).collect()
    lines = [{"item_id": "a", "label": "x", "flags": {"unsure": True}}, {"review_id": "b", "human_intent": "y", "skipped": True}, {"item_id": "a", "label": "z", "blind": False, "label_version": 3}]
    got = R.judgements(spark.createDataFrame([(json.dumps(x), k) for k, x in enumerate(lines)], "value string, ord long")).orderBy("first_ord").collect()
    assert [(r.item_id, r.label, r.skipped, r.blind, r.label_version) for r in got] == [("a", "z", False, False, 3), ("b", "y", True, True, 0)]


def test_collected_rows(spark):
    pages = spark.createDataFrame([("r1", "text", 4, "2026-01-01T00:00:00", "1.2", 3)], "reviewId string, content string, score int, at string, reviewCreatedVersion string, thumbsUpCount int")
    assert tuple(R.from_google(pages, "com.app", "p").first()) == ("r1", "google_play", "com.app", "p", "text", 4, "2026-01-01T00:00:00", "1.2", 3)
    entry = {"id": {"label": "9"}, "content": {"label": "good"}, "im:rating": {"label": "five"}, "im:version": {"label": "2"}, "im:voteCount": {"label": "7"}, "updated": {"label": "2026-01-01T00:00:00-07:00"}}
    got = R.from_apple(spark.createDataFrame([(json.dumps(entry),)], "entry string"), "123", "p").first()
    assert (got.review_id, got.text, got.rating, got.helpful_count) == ("9", "good", None, 7)


def test_configuration(spark):
    e = {"platform": "google_play", "platform_app_id": "com.app", "store_url": "https://play.google.com/x", "confirmed": True}
    p = {"product_id": "p", "display_name": "P", "brand_group": "B", "vertical": "v", "inclusion_tier": "extended", "listings": [e]}
    assert R.registry(spark, {"products": [p]}).first().brand_group == "B"
    for wrong in ({"products": []}, {"products": [p, p]}, {"products": [p | {"inclusion_tier": "core"}]}, {"products": [p | {"listings": [e | {"store_url": "http://x"}]}]}):
        with pytest.raises(ValueError):
            R.registry(spark, wrong)
    intent = {"id": "i", "family": "f", "definition": "d", "positive_examples": ["a", "b"], "negative_example": "n", "negative_rationale": "r"}
    assert R.labels_dim(spark, {"version": 3, "intents": [intent]}).first().version == 3
    assert R.labels_dim(spark, {"labels": [{"id": "x", "group": "g"}]}).first().family == "g"
    for wrong in ({"labels": []}, {"labels": [{"id": "x"}, {"id": "x"}]}, {"intents": [intent | {"positive_examples": ["a"]}]}):
        with pytest.raises(ValueError):
            R.labels_dim(spark, wrong)
    payload = spark.createDataFrame([("c", "i", {"en": {"text": "money gone", "fact_span": "gone"}, "ur": {"text": "x", "fact_span": "y"}})], "complaint_id string, gold_intent string, variants map<string,struct<text:string,fact_span:string>>")
    variants = R.authored_variants(payload)
    assert variants.count() == 2
    assert sorted(r.problem for r in R.authored_problems(variants, ["i"]).collect()) == ["forms are missing", "span is not in the text"]


def test_cleaned_rows_and_payloads(spark, tmp_path):
    cleaned = REVIEW | {"text_clean": "one two three", "text_hash": "h", "language": "english"}
    write(tmp_path / "c" / "rows.jsonl", [cleaned, cleaned | {"review_id": "b"}])
    assert [(r.review_id, r.language) for r in R.read_cleaned(spark, str(tmp_path / "c")).orderBy("ord").collect()] == [("a", "english"), ("b", "english")]
    write(tmp_path / "c" / "rows.jsonl", [REVIEW])
    with pytest.raises(PySparkException, match="unexpected fields"):
        R.read_cleaned(spark, str(tmp_path / "c")).collect()
    payload = {"version": 1, "complaints": [{"complaint_id": "c", "gold_intent": "i", "variants": {"en": {"text": "money gone", "fact_span": "gone"}}}]}
    (tmp_path / "p.json").write_text(json.dumps(payload, indent=2))
    assert [tuple(r) for r in R.authored_variants(R.read_payload(spark, str(tmp_path / "p.json"))).collect()] == [("c", "i", "en", "money gone", "gone")]
    for wrong in ("[1]", "{", "5"):
        (tmp_path / "p.json").write_text(wrong)
        with pytest.raises(PySparkException, match="JSON object"):
            R.read_payload(spark, str(tmp_path / "p.json")).collect()


def test_quotas_and_rosters(spark, tmp_path):
    path = tmp_path / "quotas.yaml"
    assert R.quotas(spark, str(path)).collect() == []
    path.write_text("google_quotas:\n  com.a: 5\n  com.b: 0\n")
    assert sorted(tuple(r) for r in R.quotas(spark, str(path)).collect()) == [("com.a", 5), ("com.b", 0)]
    path.write_text("google_quotas: [1]\n")
    with pytest.raises(ValueError, match="mapping"):
        R.quotas(spark, str(path))
    model = {"id": "m", "provider": "p", "label": "M"}
    (one,) = R.roster({"models": [model | {"price_per_mtok_input": 3.0}]}, ("p",))
    assert (one["price_per_mtok_input"], one["price_per_mtok_output"], one["min_request_interval"], one["effort"], one["disable_thinking"]) == (3.0, 0.0, 0.5, None, False)
    for wrong in ({}, {"models": [{"id": "m"}]}, {"models": [model | {"provider": "q"}]}, {"models": [model, model]}):
        with pytest.raises(ValueError):
            R.roster(wrong, ("p",))


def test_unconfirmed_apps_and_listings_are_refused(spark):
    apps = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", None)], "name string, confirmed boolean")
    assert {r.name for r in R.confirmed_apps(apps, {"a", "c"}).collect()} == {"a", "c"}
    for names, problem in (({"a", "x"}, "unknown apps: x"), ({"a", "b"}, "not confirmed by a person: b"), ({"d"}, "person: d"), (set(), "no apps"), (None, "person: b, d")):
        with pytest.raises(ValueError, match=problem):
            R.confirmed_apps(apps, names)
    listings = spark.createDataFrame([("google_play", "p", True), ("google_play", "q", False), ("apple_app_store", "r", True)], "platform string, product_id string, confirmed boolean")
    assert [r.product_id for r in R.confirmed_listings(listings, "google_play").collect()] == ["p"]
    for products in ({"p", "q"}, {"r"}):
        with pytest.raises(ValueError, match="unknown or unconfirmed"):
            R.confirmed_listings(listings, "google_play", products)


def test_validation_and_census(spark):
    rows = [("a", "google_play", "x", "p", "hi", 5, "2026-01-02"), ("a", "google_play", "x", "p", "بلاک", 1, "2026-01-01"), (None, "google_play", "x", "p", " ", None, None)]
    df = spark.createDataFrame(rows, "review_id string, platform string, platform_app_id string, product_id string, text string, rating int, timestamp string")
    r = clean.validate_raw(df).first()
    assert (r.records, r.duplicates, r.empty_texts, r.rating_5, r.earliest, r.script_urdu_script, r.script_empty) == (3, 2, 1, 1, "2026-01-01", 1, 1)
    listings = spark.createDataFrame([("google_play", "x"), ("google_play", "y")], "platform string, platform_app_id string")
    assert {r.platform_app_id: r.observed for r in clean.census(listings, df).collect()} == {"x": 3, "y": 0}
    report = clean.report(df.withColumn("language", F.lit("english"))).collect()
    assert sum(r.n for r in report) == 12


def test_caught_up(spark):
    known = [1, 1, 0, 1, 1, 1, 1, 0]
    rows = spark.createDataFrame([("app", k // 4, k, bool(x)) for k, x in enumerate(known)], "app string, page int, pos int, known boolean")
    got = {r.page: (r.last_run, r.stops) for r in refresh.caught_up(rows, "app", "page", "pos", F.col("known"), 3).collect()}
    assert got == {0: (1, False), 1: (0, False)}
    got = {r.page: (r.last_run, r.stops) for r in refresh.caught_up(rows.where("pos < 7"), "app", "page", "pos", F.col("known"), 3).collect()}
    assert got[1] == (4, True)


def test_judgement_log(spark, tmp_path):
    schema = schemas.of("item_id STRING, label STRING, ord LONG")
    for k, lines in enumerate(([{"item_id": "a", "label": "x", "ord": 0}, {"item_id": "b", "label": "x", "ord": 1}], [{"item_id": "a", "label": "y", "ord": 0}])):
        write(tmp_path / "log" / f"{k}.jsonl", lines)
        from tallybrook.streaming.refresh import latest_stream

        latest_stream(spark, str(tmp_path / "log"), schema, str(tmp_path / "view"), str(tmp_path / "ck")).awaitTermination()
    from tallybrook.sources.bucketed import Bucketed

    assert {r.item_id: r.label for r in Bucketed(spark, str(tmp_path / "view"), schema).read().collect()} == {"a": "y", "b": "x"}


def test_monthly_stream(spark, tmp_path):
    write(tmp_path / "in" / "1.jsonl", [{"ts": "2026-01-01T10:00:00", "rating": 1}, {"ts": "2026-01-01T11:00:00", "rating": 5}, {"ts": "2026-02-20T00:00:00", "rating": 5}])
    rows = spark.readStream.schema("ts timestamp, rating int").json(str(tmp_path / "in"))
    q = refresh.monthly_stream(rows).writeStream.format("memory").queryName("monthly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.total, r.bad) for r in spark.sql("select * from monthly").collect())
    assert got == [(1, 0), (2, 1)]
