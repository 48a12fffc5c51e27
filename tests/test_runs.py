"""Labelling runs, bucketed tables, known ids, digests, quarantine and SQL functions, against plain versions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tallybrook import schemas
from tallybrook.operators import label_run as L
from tallybrook.operators import studies
from tallybrook.plans import views
from tallybrook.sources import files, quarantine
from tallybrook.sources.bucketed import Bucketed
from tallybrook.streaming.known import KnownIds

RECORDS = "id string, text_scrubbed string"


def counting(path, answer=lambda t: {"intent": t.split()[0], "confidence": 0.5}):
    def make():
        def ask(text):
            with open(path, "a") as f:
                f.write(json.dumps(text) + "\n")
            return (answer(text) if text else None), len(text), 3

        return ask

    return make


def test_each_text_is_asked_once_and_never_again(spark, tmp_path):
    cache, log = str(tmp_path / "cache"), tmp_path / "asked"
    rows = [(str(k), f"text {k % 7}") for k in range(50)] + [("none", None), ("empty", "")]
    records = spark.createDataFrame(rows, RECORDS).repartition(6)
    out, spend = L.label_run(records, L.RowPredictor(counting(log)), cache, "m", "p1", 3)
    assert sorted(map(json.loads, log.read_text().splitlines())) == sorted(["", *[f"text {k}" for k in range(7)]])
    assert spend == {"live_calls": 8, "unanswered": 1, "input_tokens": 42, "output_tokens": 24, "cache_hits": 44}
    assert {(r.id, r.label_intent, r.label_severity) for r in out.collect()} == {(i, "text" if t else None, None) for i, t in rows}
    _, spend = L.label_run(records, L.RowPredictor(counting(log)), cache, "m", "p1", 3)
    assert (spend["live_calls"], spend["cache_hits"]) == (1, 51)  # only what had no answer
    _, spend = L.label_run(records.where("text_scrubbed <> ''"), L.RowPredictor(counting(log)), cache, "m", "p2", 3)
    assert spend["live_calls"] == 7  # another prompt: another request


def test_a_run_that_died_keeps_what_other_runs_found(spark, tmp_path):
    cache = str(tmp_path / "cache")
    records = spark.createDataFrame([("1", "a b"), ("2", "c d")], RECORDS)

    def fails():
        def ask(text):
            raise OSError("no answer")

        return ask

    L.label_run(records.where("id = '1'"), L.RowPredictor(counting(tmp_path / "x")), cache, "m", "p", 1, run="one")
    with pytest.raises(Exception, match="no answer"):
        L.label_run(records, L.RowPredictor(fails, attempts=2), cache, "m", "p", 1, run="two")
    out, spend = L.label_run(records, L.RowPredictor(counting(tmp_path / "y")), cache, "m", "p", 1, run="two")
    assert spend["live_calls"] == 1 and {r.label_intent for r in out.collect()} == {"a", "c"}


def test_a_table_of_predictions(spark, tmp_path):
    from tallybrook.functions import text as X

    records = spark.createDataFrame([("1", "a b"), ("2", "c d"), ("3", "a b")], RECORDS)
    label = F.from_json(F.lit('{"intent": "known"}'), schemas.LABEL)
    table = records.where("id <> '2'").select(X.cache_key("m", "p", 1, F.col("text_scrubbed")).alias("key"), label.alias("label"), F.lit(5).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    out, spend = L.label_run(records, L.TablePredictor(table), str(tmp_path / "c"), "m", "p", 1)
    assert {r.id: r.label_intent for r in out.collect()} == {"1": "known", "2": None, "3": "known"} and spend["live_calls"] == 1 and spend["input_tokens"] == 5


LOG = schemas.of("item_id STRING, label STRING, ord LONG")


def test_upserts_rewrite_only_what_they_touch(spark, tmp_path):
    root = str(tmp_path / "t")
    table = Bucketed(spark, root, LOG)
    rng, want = random.Random(1), {}
    assert table.read().count() == 0
    for batch in range(4):
        keys = range(300) if batch == 0 else rng.sample(range(320), 10)
        rows = [(f"k{k}" if k != 7 else None, f"b{batch}", n) for n, k in enumerate(keys)] + [(f"k{max(keys)}", f"last{batch}", 10**6)]
        want |= {k: label for k, label, _ in rows}
        touched = Bucketed(spark, root, LOG).upsert(spark.createDataFrame(rows, LOG), batch)
        assert touched <= (64 if batch == 0 else 10)
        assert {r.item_id: r.label for r in table.read().collect()} == want
        assert table.upsert(spark.createDataFrame([("k1", "again", 0)], LOG), batch) == 0  # a batch that was committed
    names = sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith("."))
    assert names == ["data", "manifest-4.json"]
    held = {(v.name, b.name) for v in (tmp_path / "t" / "data").iterdir() for b in v.iterdir() if b.name.startswith("bucket=")}
    assert len(held) == len(table.manifest()["of"])  # what was replaced is gone


def test_an_upsert_that_died_before_its_manifest_leaves_no_trace(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    table = Bucketed(spark, root, LOG)
    table.upsert(spark.createDataFrame([("a", "x", 0), ("b", "x", 1)], LOG), 0)
    monkeypatch.setattr(Bucketed, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([("a", "y", 0)], LOG), 1)
    monkeypatch.undo()
    assert {r.item_id: r.label for r in table.read().collect()} == {"a": "x", "b": "x"}
    assert table.upsert(spark.createDataFrame([("a", "z", 0)], LOG), 1) == 1
    assert {r.item_id: r.label for r in table.read().collect()} == {"a": "z", "b": "x"}


def test_known_ids_equal_the_anti_join(spark):
    key = ("platform", "review_id")
    known = spark.range(20_000).select(F.lit("g").alias("platform"), (F.col("id") * 3).cast("string").alias("review_id"))
    known = known.unionByName(spark.createDataFrame([("g", None)], "platform string, review_id string"))
    rows = spark.range(60_000).select(F.lit("g").alias("platform"), F.col("id").cast("string").alias("review_id"), "id")
    rows = rows.unionByName(spark.createDataFrame([("g", None, -1), (None, "1", -2), (None, None, -3)], "platform string, review_id string, id long"))
    ids = KnownIds(known, key)
    assert sorted(r.id for r in ids.unseen(rows).collect()) == [-3, -2, *[k for k in range(60_000) if k % 3]]
    passed = rows.where("id % 3 <> 0 and id > 0").where(ids.maybe()).count()
    assert passed / 40_000 < 0.03  # false positives
    none = KnownIds(known.where("false"), key)
    assert none.unseen(rows).count() == rows.count()


def test_file_digests(spark, tmp_path, monkeypatch):
    for k, size in enumerate((1, 10, 3_000_000)):
        (tmp_path / "in" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "deep" / f"f{k}.bin").write_bytes(random.Random(k).randbytes(size))
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "in" / "deep").iterdir()}
    for whole in (files.WHOLE, 100):
        monkeypatch.setattr(files, "WHOLE", whole)
        got = files.file_digests(spark, str(tmp_path / "in")).collect()
        assert {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in got} == want
    one = files.sample_digests(spark, str(tmp_path / "in"), str(tmp_path / "in" / "deep" / "f1.bin")).where("role = 'output'").first()
    assert (one["name"], one.length, one.sha256) == ("f1.bin", *want["f1.bin"])


def test_lines_go_to_two_sinks(spark, tmp_path):
    good = [{"review_id": "1", "rating": 4, "text": "x"}, {"review_id": "2", "rating": None}, {"review_id": "3", "other": {"a": 1}}]
    bad = {'{"review_id": "4"': "not JSON", "[1]": "not an object", '"x"': "not an object", "null": "not an object", '{"rating": 3}': "no review_id", '{"review_id": "5", "rating": "many"}': "rating is of another type", '{"review_id": "6", "text": 5}': "text is of another type"}
    lines = spark.createDataFrame([(x, k) for k, x in enumerate([*map(json.dumps, good), *bad, "", "   "])], "value string, ord long")
    counts = quarantine.split_lines(lines, schemas.REVIEW, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert counts == {"lines": 10, "good": 3, "bad": 7}
    assert sorted((r.review_id, r.rating, r.ord) for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [("1", 4, 0), ("2", None, 1), ("3", None, 2)]
    assert {r.value: r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == bad
    either = quarantine.judged_lines(lines, schemas.of("label STRING"), (("item_id", "review_id"),))
    assert either.where("reason = 'no item_id'").count() == 1


ITEMS = "id string, text string, meta map<string,string>, predictions map<string,string>"


def test_sql_equals_the_dataframe(spark):
    rng = random.Random(4)
    items = spark.createDataFrame([(str(k), "t", {"lang": rng.choice("xy")} if k % 5 else {}, {"m": rng.choice(["q", "r"]), "n": rng.choice(["q", "", "unclassifiable"])}) for k in range(80)], ITEMS)
    judged = spark.createDataFrame([(str(k), rng.choice(["q", "r", "__none__"]), False, True) for k in range(60)], "item_id string, label string, skipped boolean, blind boolean")
    names = views.register(spark, items=items, judgements=judged)
    assert "score" in names and "review_report" not in names
    want = studies.score_report(items, judged, "lang")
    columns = ["section", "model", "hits", "total", "rate", "low", "high"]
    got = spark.sql("SELECT section, model, grp, hits, total, rate, low, high FROM score('lang')")
    key = lambda r: str(tuple(r))
    for section, group in (("model", None), ("group", "group")):
        own = want.where(F.col("section") == section).select(*columns, *([F.col("group").alias("grp")] if group else []))
        assert sorted(own.collect(), key=key) == sorted(got.where(F.col("section") == section).select(*columns, *(["grp"] if group else [])).collect(), key=key)
    assert spark.sql("SELECT * FROM score(NULL) WHERE section = 'group'").count() == 0
    assert spark.sql("SELECT wilson_low(0, 0), wilson_high(0, 0), share_pct(1, 0)").first() == (0.0, 0.0, None)


def test_score_in_one_call(spark):
    items = spark.createDataFrame([(str(k), "t", {"lang": "xy"[k % 2], "src": "s"}, {"m": "q" if k % 2 or k % 8 == 0 else "r"}) for k in range(200)], ITEMS)
    judged = spark.createDataFrame([(str(k), "q", False, True) for k in range(200)], "item_id string, label string, skipped boolean, blind boolean")
    found = studies.score(items, judged, "lang", rounds=400)
    assert [r.field for r in found["fields"].collect()] == ["lang", "src"]
    (row,) = found["power"].collect()
    assert (row.model, row.spread, row.significant) == ("m", 75.0, True) and row.p < 0.05 and row.mde > 0 and row.needed > 0
    assert found["report"].where("section = 'group'").count() == 2
    assert studies.score(items, judged, "src", rounds=50)["power"].collect() == [] and "power" not in studies.score(items, judged)
