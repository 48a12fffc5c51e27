import json

import pytest
import yaml

from tallybrook.functions import parsing
from tallybrook.sources import labelling as L
from tallybrook.sources import reviews as R

INTENT = {"id": "late_bill", "family": "billing", "definition": " Bill comes late. ", "positive_examples": ["no bill yet", "bill late"], "negative_example": "bill too high", "negative_rationale": "that is its amount"}


def test_instructions_name_the_whole_taxonomy():
    text = L.instructions({"intents": [INTENT, INTENT | {"id": "other"}]}, ("english", "urdu_script"), ("friction",))
    for part in ("late_bill [billing]: Bill comes late.\n", "example: bill late", "bill too high (that is its amount)", "english, urdu_script", "friction", "unclassifiable"):
        assert part in text
    assert text.index("late_bill") < text.index("other")


def test_replies_that_keep_to_the_schema_are_read(spark):
    schema = L.reply_schema(["late_bill"], ("english",), ("friction",))["schema"]
    assert schema["required"] == list(schema["properties"]) and not schema["additionalProperties"]
    assert schema["properties"]["intent"]["enum"] == ["late_bill", "unclassifiable"]
    assert schema["properties"]["intent_secondary"]["anyOf"] == [{"type": "string", "enum": ["late_bill"]}, {"type": "null"}]
    values = {"intent": "late_bill", "intent_secondary": None, "refund_requested": False, "language": "english", "severity": "friction", "confidence": 0.5, "rationale": "r"}
    assert set(values) == set(schema["required"])
    rows = spark.createDataFrame([(json.dumps(values),), (json.dumps({k: v for k, v in values.items() if k != "severity"}),)], "reply string")
    good, bad = parsing.quarantine(rows)
    assert (good.count(), bad.count()) == (1, 1)


def test_outside_vocabulary(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", None), (None, "x"), ("b", "y")], "one string, two string")
    got = L.outside_vocabulary(rows, {"one": ["a"], "two": ["x"]}, optional=("two",))
    assert {(r.field, r.value, r.n) for r in got.collect()} == {("one", "b", 2), ("one", None, 1), ("two", "y", 1)}
    assert L.outside_vocabulary(rows.limit(0), {"one": ["a"]}).count() == 0


def test_authored_gaps(spark):
    rows = [(f"c{k}", intents[0]) for k, intents in enumerate(list(L.SCENARIOS.values()) * 4)]
    whole = spark.createDataFrame(rows, "complaint_id string, gold_intent string")
    assert L.authored_gaps(whole).count() == 0
    less = whole.where("gold_intent <> 'otp_not_received'")
    assert sorted(r.problem for r in L.authored_gaps(less).collect()) == ["16 complaints, not 20", "nothing of OTP/login failure"]
    assert L.authored_gaps(whole.limit(0)).count() == 6


def test_apps_are_written_in_their_order(tmp_path):
    apps = [{"name": "ب", "app_id": "z", "confirmed": False}, {"name": "a", "app_id": "y", "confirmed": False}]
    path = tmp_path / "new" / "apps.yaml"
    L.write_apps(apps, str(path))
    assert yaml.safe_load(path.read_text(encoding="utf-8")) == {"apps": apps}
    assert "ب" in path.read_text(encoding="utf-8") and [x.name for x in path.parent.iterdir()] == ["apps.yaml"]
    assert L.retry_delays() == [2.0, 4.0, 8.0, 16.0]


def test_strict_reader_refuses_no_rows(spark, tmp_path):
    (tmp_path / "page_1.jsonl").write_text("\n \n")
    with pytest.raises(ValueError, match="no rows"):
        R.read_strict(spark, str(tmp_path))
