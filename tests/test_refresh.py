"""Walks over pages against a plain loop, the paged source, and refreshed rows as they are read."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallybrook.sources import paged
from tallybrook.streaming import refresh
from tallybrook.streaming.walk import walk

PAGES = "app_id string, page long, place long, review_id string, review string, more boolean"
REVIEW = {"platform": "google_play", "platform_app_id": "a", "product_id": "p", "text": "three words here", "rating": 1, "timestamp": "2026-01-01", "app_version": "1", "helpful_count": 0}


def loop(pages, known, threshold, max_pages):
    """pages: lists of ids, newest first; the last one has no next page."""
    known, fresh, run, n = set(map(str, known)), [], 0, 0
    while n < max_pages:
        ids, more = (pages[n], n + 1 < len(pages)) if n < len(pages) else ([], False)
        n += 1
        if not ids:
            return fresh, n, "store_exhausted"
        for i in map(str, ids):
            if i in known:
                run += 1
            else:
                run = 0
                known.add(i)
                fresh.append(i)
        if run >= threshold:
            return fresh, n, "caught_up"
        if not more:
            return fresh, n, "store_exhausted"
    return fresh, n, "max_pages"


def stores():
    rng = random.Random(7)
    out = {
        "repeats": ([["x", "y"], ["x", "y"], ["z"]], []),  # a page that repeats the first: its ids are known by then
        "ends at max": ([[f"m{k}"] for k in range(6)], []),
        "goes on": ([[f"g{k}"] for k in range(9)], []),
        "empty": ([[]], ["q"]),
        "empty page": ([["a", "b"], [], ["c"]], []),
        "lone": ([["n1", "seen", "n2"]], ["seen"]),
        "no ids": ([[None, None, "b"], [None, "c"]], []),
        "caught": ([["k1", "k2"], ["u"]], ["k1", "k2"]),
    }
    for s in range(25):
        ids = [f"i{rng.randrange(14)}" for _ in range(rng.randrange(1, 40))]
        size = rng.randrange(1, 6)
        out[f"random {s}"] = ([ids[k : k + size] for k in range(0, len(ids), size)], rng.sample([f"i{k}" for k in range(14)], rng.randrange(12)))
    return out


def rows_of(stores, first=0):
    rows = []
    for app, (pages, _) in stores.items():
        for n, ids in enumerate(pages):
            more = n + 1 < len(pages)
            rows += [(app, n + first, k, i, json.dumps(REVIEW | {"review_id": i}), more) for k, i in enumerate(ids)] or [(app, n + first, None, None, None, more)]
    return rows


def known_of(spark, stores):
    return spark.createDataFrame([(app, i) for app, (_, known) in stores.items() for i in known], "app_id string, review_id string")


def found(rows):
    fresh, ends = {}, {}
    for r in sorted(rows, key=lambda r: (r.page or 0, r.place or 0)):
        if r.stop_reason is None:
            fresh.setdefault(r.app_id, []).append(str(json.loads(r.review)["review_id"]))
        else:
            assert r.app_id not in ends
            ends[r.app_id] = (r.pages_fetched, r.stop_reason, r.new_rows)
    return {a: (fresh.get(a, []), *e) for a, e in ends.items()}


def wanted(stores, threshold, max_pages):
    out = {}
    for app, (pages, known) in stores.items():
        fresh, n, reason = loop(pages, known, threshold, max_pages)
        out[app] = (fresh, n, reason, len(fresh))
    return out


def test_walk_over_a_table_equals_the_loop(spark):
    own = stores()
    pages = spark.createDataFrame(rows_of(own), PAGES).repartition(4)
    assert found(walk(pages, known_of(spark, own), 2, 6).collect()) == wanted(own, 2, 6)


@pytest.mark.parametrize("threshold,most", [(2, 6), (1, 3), (5, 40)])
def test_stop_reasons_equal_the_loop(spark, threshold, most):
    own = stores()
    rows = spark.createDataFrame([(a, p, p * 100 + (k or 0), i, i is not None and i in own[a][1], m, k is None) for a, p, k, i, _, m in rows_of(own)], "app string, page long, ord long, id string, known boolean, more boolean, none boolean")
    tokens = rows.select("app", "page", "more").distinct()
    got = refresh.stop_reasons(rows.where("not none"), "app", "page", "ord", F.col("known"), "id", threshold, most, tokens)
    assert {r.app: (r.pages_fetched, r.stop_reason, r.new_rows) for r in got.collect()} == {a: w[1:] for a, w in wanted(own, threshold, most).items()}
    whole = {a: s for a, s in own.items() if all(s[0])}  # no page without rows: the last one with rows has no next one
    got = refresh.stop_reasons(rows.where(F.col("app").isin(*whole)), "app", "page", "ord", F.col("known"), "id", threshold, most)
    assert {r.app: (r.pages_fetched, r.stop_reason, r.new_rows) for r in got.collect()} == {a: w[1:] for a, w in wanted(whole, threshold, most).items()}


def landed(spark, own, root):
    paged.land_pages(spark.createDataFrame(rows_of(own, 1), PAGES).repartition(3), root)


def test_landed_pages_come_back(spark, tmp_path):
    own = stores()
    root = str(tmp_path / "pages")
    landed(spark, own, root)
    got = sorted(tuple(r) for r in paged.read_pages(spark, root).collect())
    assert [(*r[:3], r[3], r[5]) for r in sorted(got, key=str)] == [(*r[:3], r[3], r[5]) for r in sorted(rows_of(own, 1), key=str)]
    marks = paged.checkpoints(root)
    assert {a: (m["next_page"], m["reviews_collected"], m["complete"]) for a, m in marks.items()} == {a: (len(p) + 1, sum(map(len, p)), True) for a, (p, _) in own.items()}
    assert paged.read_pages(spark, str(tmp_path / "nothing")).collect() == []
    assert {r.app_id for r in paged.read_pages(spark, root, app="lone").collect()} == {"lone"}


def test_a_page_without_its_checkpoint_is_not_read(spark, tmp_path):
    root = str(tmp_path / "pages")
    landed(spark, {"a": ([["1"], ["2"]], [])}, root)
    (tmp_path / "pages" / "a" / "page_000003.jsonl").write_text('{"review_id": "3"')  # a run that died here
    assert sorted(r.review_id for r in paged.read_pages(spark, root).collect()) == ["1", "2"]
    landed(spark, {"a": ([["1"], ["2"], ["3"]], [])}, root)
    assert sorted(r.review_id for r in paged.read_pages(spark, root).collect()) == ["1", "2", "3"]


def run(spark, root, out, checkpoint, known, date="2026-02-01", **how):
    refresh.refresh_stream(spark, root, out, checkpoint, known, date, **({"threshold": 2, "max_pages": 6} | how)).awaitTermination()
    rows = refresh.read_refreshed(spark, out).where(F.col("run_date") == date).collect()
    ends = refresh.read_refreshed(spark, out, "walks").where(F.col("run_date") == date).collect()
    fresh = {}
    for r in sorted(rows, key=lambda r: (r.page, r.place)):
        fresh.setdefault(r.app_id, []).append(str(r.review_id))
    return {r.app_id: (fresh.get(r.app_id, []), r.pages_fetched, r.stop_reason, r.new_rows) for r in ends}


def test_refresh_stream_equals_the_loop_and_goes_on_from_its_checkpoint(spark, tmp_path):
    own = stores()
    root, out, checkpoint = (str(tmp_path / x) for x in ("pages", "refreshed", "checkpoint"))
    landed(spark, own, root)
    known = known_of(spark, own)
    assert run(spark, root, out, checkpoint, known) == wanted(own, 2, 6)
    assert run(spark, root, out, checkpoint, known) == wanted(own, 2, 6)  # nothing new: the same rows
    again = run(spark, root, out, str(tmp_path / "second"), known, "2026-03-01")  # what the first run wrote is known
    assert sum(len(w[0]) for w in again.values()) == sum(len(set(map(str, sum(p[:6], []))) - set(wanted(own, 2, 6)[a][0]) - set(k)) for a, (p, k) in own.items() if a in again and again[a][1] > wanted(own, 2, 6)[a][1])


def test_a_batch_that_died_is_run_again(spark, tmp_path, monkeypatch):
    own = {"a": ([["1", "2"], ["3"]], [])}
    root, out, checkpoint = (str(tmp_path / x) for x in ("pages", "refreshed", "checkpoint"))
    landed(spark, own, root)
    known = known_of(spark, {"a": ([], ["0"])})
    from tallybrook import schemas

    kept = schemas.REVIEW
    monkeypatch.setattr(schemas, "REVIEW", "no schema at all (")  # the rows can't be written
    with pytest.raises(Exception):
        run(spark, root, out, checkpoint, known)
    monkeypatch.setattr(schemas, "REVIEW", kept)
    assert run(spark, root, out, checkpoint, known) == wanted(own, 2, 6)
    landed(spark, {"a": ([["1", "2"], ["3"], ["4"], ["5"]], []), "b": ([["9"]], [])}, root)
    assert run(spark, root, out, checkpoint, known)["b"] == (["9"], 1, "store_exhausted", 1)


def test_short_texts_are_written_but_not_read(spark, tmp_path):
    root, out = str(tmp_path / "pages"), str(tmp_path / "refreshed")
    rows = [("a", 1, k, i, json.dumps(REVIEW | {"review_id": i, "text": t}), False) for k, (i, t) in enumerate([("1", "bad app"), ("2", "  <b>App</b> bohat acha hai "), ("3", None), ("4", "سروس بہت اچھی"), (None, "one two three"), ("", "one two three")])]
    paged.land_pages(spark.createDataFrame(rows, PAGES), root)
    run(spark, root, out, str(tmp_path / "ck"), known_of(spark, {}))
    stored = refresh.read_refreshed(spark, out)
    assert stored.count() == 6
    corpus = spark.createDataFrame([("9", "raw", "cleaned text", "english", 0), ("2", "raw", "", "english", 1)], "review_id string, text string, text_clean string, language string, ord long")
    merged = refresh.with_refresh(corpus, stored.select("review_id", "text", F.col("place").alias("ord")))
    assert {r.review_id: (r.text, r.language) for r in merged.collect()} == {"9": ("cleaned text", "english"), "2": ("raw", "english"), "4": ("سروس بہت اچھی", "urdu_script")}
    alone = refresh.with_refresh(corpus.limit(0), stored.select("review_id", "text", F.col("place").alias("ord")))
    assert {r.review_id: (r.text, r.language) for r in alone.collect()} == {"2": ("App bohat acha hai", "roman_urdu"), "4": ("سروس بہت اچھی", "urdu_script")}


def test_pages_beyond_the_most_do_not_gather(spark):
    """A task held every row of an app, though its walk ends after max_pages."""
    from tallybrook.streaming.walk import _first_pages

    rows = [(app, page, place, f"{app}{page}{place}", "r", True) for app in ("a", None, "b") for page in range(3, 200) for place in range(3)]
    pages = spark.createDataFrame(rows, PAGES)
    kept = {(r.app_id, r.page) for r in _first_pages(pages, 4).collect()}
    assert kept == {(app, page) for app in ("a", None, "b") for page in range(3, 7)}
    assert "_last" in walk(pages, pages.select("app_id", "review_id"), 5, 4)._jdf.queryExecution().optimizedPlan().toString()
    fresh = walk(pages.where("app_id = 'a'"), pages.where("false").select("app_id", "review_id"), 5, 4).collect()
    assert sorted((r.page, r.place) for r in fresh if r.stop_reason is None) == [(page, place) for page in range(3, 7) for place in range(3)]
    assert [(r.stop_reason, r.pages_fetched, r.new_rows) for r in fresh if r.stop_reason] == [("max_pages", 4, 12)]
