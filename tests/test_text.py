import random
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybrook.functions import catalogue as K
from tallybrook.functions import parsing, pii
from tallybrook.functions import text as X
from tallybrook.operators import titles as similar


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("x"))).collect()]


def test_normalise(spark):
    values = ["  Balance <b>kat</b>   gaya\nphir se  ", None, "", "a b\u001cc d", "<p>", "x < y > z", "a<b\nc>d"]
    assert column(spark, values, X.normalise) == ["Balance kat gaya phir se", "", "", "a b c d", "", "x z", "a d"]


def test_counts_and_drop_reasons(spark):
    values = ["", "🔥🔥🔥", "bohat acha", "بہت اچھا نہیں", "WalletCash app hang", "one, two; three!"]
    assert column(spark, values, X.drop_reason) == ["empty", "emoji_only", "too_short", None, None, None]
    assert column(spark, values, X.token_count) == [0, 0, 2, 3, 3, 3]
    assert column(spark, ["", " a b\u001cc ", None], X.word_count) == [0, 3, 0]


def test_languages(spark):
    values = ["بیلنس کم ہو گیا", "Mera balance kat GAYA", "The app is fast", "app بند ہے", "", "123 !!"]
    assert column(spark, values, X.language) == ["urdu_script", "roman_urdu", "english", "code_switched", "english", "english"]
    assert column(spark, ["paisay wapis", "all good", "سب app"], X.language_wide) == ["roman_urdu", "english", "code_switched"]
    assert column(spark, ["abc", "اب", "اب c"], X.script) == ["latin", "urdu_script", "mixed"]


def test_keywords(spark):
    for tag, text, hit in (
        ("otp", "OTP nahi aya", True), ("otp", "او ٹی پی نہیں آیا", True), ("money_lost", "Rs 50 deducted", True), ("money_lost", "پیسے غائب", True),
        ("bill", "billing page", False), ("no_such_group", "otp", False), ("support", "Koi response nahi", True),
    ):
        assert column(spark, [text], lambda c, t=tag: X.has_keyword(t, c)) == [hit], (tag, text)
    assert column(spark, ["Sent to wrong number", "galat number par bheja", "nothing"], lambda c: X.signal_score(c, K.SIGNAL_GROUPS[1][1])) == [2, 2, 0]


def test_features(spark):
    assert column(spark, ["Rs 500 deducted", "balance fine", "payment failed"], X.severity_proxy) == [True, False, True]
    words = [" ".join(["w"] * n) for n in (0, 9, 10, 19, 20, 39, 40)]
    assert column(spark, words, X.length_bucket) == ["short", "short", "medium", "medium", "long", "long", "very_long"]
    assert column(spark, [None, 0, 2, 3], X.is_bad, "int") == [False, False, True, False]
    assert column(spark, ["call 0300 1234567", "کال ۱۲۳۴۵۶", "all well"], X.has_pii_risk_cue) == [True, True, False]
    assert column(spark, ["Wallet Cash!", "QuickPay – 2"], X.normal_title) == ["walletcash", "quickpay2"]
    assert column(spark, ["2026-01-02T03:04:05Z", "2026-01-02", "no"], X.timestamp) == [datetime(2026, 1, 2, 3, 4, 5), datetime(2026, 1, 2), None]


def test_cache_key(spark):
    import hashlib

    want = hashlib.sha256("m|prompt_v1|taxonomy_v3|text".encode()).hexdigest()
    assert column(spark, ["text", None], lambda c: X.cache_key("m", "prompt_v1", 3, c)) == [want, None]
    other = hashlib.sha256("p|m|prompt_v1|taxonomy_v3|text".encode()).hexdigest()
    assert column(spark, ["text"], lambda c: X.cache_key("m", "prompt_v1", 3, c, "p")) == [other]


PII = [
    ("mail me at ali.khan@example.com.pk now", "mail me at <EMAIL> now"),
    ("CNIC 35202-1234567-1 hai", "CNIC <CNIC> hai"),
    ("id 3520212345671", "id <CNIC>"),
    ("call 0301-1234567 or +923011234567", "call <PHONE> or <PHONE>"),
    ("نمبر ۰۳۰۱۱۲۳۴۵۶۷ ہے", "نمبر <PHONE> ہے"),
    ("account number: 1234 5678 9012", "account number: <ACCOUNT>"),
    ("IBAN PK36SCBL0000001123456702", "IBAN <IBAN>"),
    ("My name is Ali Khan, thanks", "My name is <NAME>, thanks"),
    ("mera naam ahmed raza hai aur", "mera naam <NAME> hai aur"),
    ("میرا نام احمد ہے", "میرا نام <NAME> ہے"),
    ("line 042-12345678 busy", "line <PHONE> busy"),
]
UNTOUCHED = ["Rs 5000 deducted on 2026-01-05", "order 12345678", "version 10.2.3", "I am very angry", "", "ref 99-1234"]


def test_redaction(spark):
    df = spark.createDataFrame([(a,) for a, _ in PII] + [(t,) for t in UNTOUCHED] + [(None,)], "text_clean string")
    got = {r.text_clean: r for r in pii.scrub(df).collect()}
    for raw, clean in PII:
        assert pii.scrub_text(raw)[0] == clean
        assert got[raw].text_scrubbed == clean and sum(got[raw].pii_counts.values()) >= 1
    for raw in UNTOUCHED:
        assert pii.scrub_text(raw) == (raw, {}) and got[raw].text_scrubbed == raw
    assert got[None].text_scrubbed is None
    totals = {r.label: r.n for r in pii.totals(pii.scrub(df)).collect()}
    assert totals == {"email": 1, "cnic": 2, "phone": 4, "account": 1, "iban": 1, "name": 3}


def plain_scrub(text):
    view, spans = text.translate(str.maketrans(K.OTHER_DIGITS, K.ASCII_DIGITS)), []
    import re

    for label, pattern in K.PII:
        for m in re.finditer(pattern, view):
            if not any(m.start("pii") < e and s < m.end("pii") for s, e, _ in spans):
                spans.append((*m.span("pii"), label))
    for s, e, label in sorted(spans, reverse=True):
        text = text[:s] + K.PLACEHOLDERS[label] + text[e:]
    return text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["0301", "1234567", "-", " ", "35202-1234567-1", "account no ", "a@b.co", "۳۵۲۰۲", "I am Ali", ".", "PK36SCBL", "0000001123456702", "12345678"]), max_size=12).map("".join))
def test_redaction_of_overlaps(text):
    assert pii.scrub_text(text)[0] == plain_scrub(text)


@pytest.mark.parametrize(
    "reply, intent",
    [("otp", "otp"), (' "login". ', "login"), ("`OTP`", "otp"), ("I think it is login", "login"), ("otp or login", None), ("none", None), ("", None)],
)
def test_intent_replies(spark, reply, intent):
    assert column(spark, [reply], lambda c: parsing.intent_reply(c, ["otp", "login"])) == [intent]


def test_label_replies(spark):
    good = '{"intent":"x","intent_secondary":null,"refund_requested":true,"language":"english","severity":"low","confidence":0.5,"rationale":"r"}'
    values = [good, f"```json\n{good}\n```", f"  ```json\n{good}\n```\nI hope that helps: `x`.\n```\nother\n```", f"```{good}", good.replace("0.5", "1.5"), good.replace('"rationale":"r"', '"other":1'), "no json", None]
    got = column(spark, values, parsing.label_reply)
    assert [g and (g.intent, g.refund_requested, g.confidence) for g in got] == [("x", True, 0.5)] * 4 + [None] * 4
    right, wrong = parsing.quarantine(spark.createDataFrame([(v,) for v in values], "reply string"))
    assert (right.count(), wrong.count()) == (4, 4)


def test_spend_and_titles(spark):
    usd = spark.range(1).select(parsing.spend_usd(F.lit(1_000_000), F.lit(100_000), F.lit(3.0), F.lit(15.0), F.lit(1_000_000), F.lit(1_000_000))).first()[0]
    assert usd == pytest.approx(3.0 + 1.5 + 3.75 + 0.3)
    targets = spark.createDataFrame([("Plan World", None, None), ("Easy", "com.easy", "Easy Ltd"), ("Lone", None, "Nobody")], "name string, expected_app_id string, expected_developer string")
    rows = [("Plan World", "a", "Mosa - Plan World", "x", 0), ("Plan World", "b", "Other", "x", 1), ("Easy", "com.other", "Easy", "easy LTD", 0), ("Easy", "com.easy", "Far", "Q", 1), ("Lone", "c", "Lone", "Somebody", 0)]
    got = {r.name: r for r in parsing.best_title_match(targets, spark.createDataFrame(rows, "target string, app_id string, title string, developer string, ord int")).collect()}
    assert got["Plan World"].match.app_id == "a" and got["Easy"].match.app_id == "com.easy" and got["Lone"].match is None and not got["Easy"].conflict


def test_title_match_over_all_parts_and_suppliers(spark):
    from difflib import SequenceMatcher

    from tallybrook.plans import registry

    at = "/root/testdata/sf0.01"
    normal = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    titles = [(r.s_suppkey, r.s_name) for r in spark.read.parquet(f"{at}/supplier.parquet").collect()]
    want = {}
    for r in spark.read.parquet(f"{at}/part.parquet").collect():
        name = f"{r.p_name} {r.p_partkey}"
        ratio, _, title = max((SequenceMatcher(None, normal(name), normal(t)).ratio(), -k, t) for k, t in titles)
        want[name] = (title, round(ratio, 6))
    assert {r.name: (r.title, r.ratio) for r in registry.title_match(spark, at).collect()} == want


def test_titles_in_blocks(spark):
    targets = spark.createDataFrame([("ab",), ("--",), (None,)], "name string")
    titles = spark.createDataFrame([("ba", 3), ("ab", 2), ("AB", 1), ("", 5), (None, 4)], "title string, ord int")
    got = {r.name: (r.title, r.ratio) for r in similar.most_similar_titles(targets, titles, block=2).collect()}
    assert got == {"ab": ("AB", 1.0), "--": (None, 1.0), None: (None, None)}
    assert {r.title for r in similar.most_similar_titles(targets, titles.where("false")).collect()} == {None}


def test_has_words_is_the_count(spark):
    rng = random.Random(6)
    values = [None, "", " ", "one", " one ", "one two", "one\u00a0two\x1cthree", "بہت اچھی سروس"] + ["".join(rng.choices(["a", "bb", " ", "\n", "\u2003", "\x1d", "."], k=rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    for n in (0, 1, 2, 3, 5):
        assert df.where(X.has_words(F.col("t"), n) != (X.word_count(F.col("t")) >= n)).count() == 0
