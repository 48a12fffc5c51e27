import corpus_pipeline as P
from tallybrook.llm import secrets, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_keeps_the_columns_and_acts(spark):
    docs = sample(spark)
    before = rows(docs)
    for name, stage in P.STAGES[:-1]:
        out = P.C.materialise(stage(spark, docs, ""), name)
        after = rows(out)
        assert out.columns == COLUMNS and set(after) <= set(before), name
        if name == "language_id":
            assert len(after) > 0.98 * len(before)
        if name == "near_dedup":
            groups = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
            assert set(after) == set(groups.values()) and len({r.text for r in after.values()}) == len(after)
        if name == "suffix_array_dedup":
            for d, r in after.items():
                if r.text != before[d].text:
                    assert r.n_chars == len(r.text) < before[d].n_chars
            from tests.llm.test_suffix_dedup import brute

            want = {d: n for d, _, n, _, _ in brute([(d, r.text.encode()) for d, r in before.items()], 100)}
            assert {d for d, n in want.items() if n == 0} == {d for d, r in after.items() if r.text == before[d].text}
        if name == "secret_scan":
            assert {d: secrets.redact(r.text, secrets.scan(r.text)[4]) for d, r in before.items()} == {d: r.text for d, r in after.items()}
        docs, before = out, after
    packed = P.STAGES[-1][1](spark, docs, "").toPandas()
    assert set(packed.doc_id) == set(before)
    assert sorted(map(tuple, P.run(spark, "/root/testdata/sf0.001").toPandas()[["doc_id", "piece", "length"]].to_numpy().tolist())) == sorted(map(tuple, packed[["doc_id", "piece", "length"]].to_numpy().tolist()))


def test_odd_documents(spark):
    """Null, empty and repeated texts and ids, and columns with the names that the stages use themselves."""
    words = "the text of a document that is told about in the house by the dog at the door "
    rows_ = [(1, None), (2, ""), (None, "one that is without an id and of its own words in all of it"), (3, words), (3, words), (4, "123 !! 456"), (None, "another such text is here and it is like no text of the others"), (5, "x" * 300_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rejected boolean, Score string, lang_pred int, n_removed array<int>, b int, text_hash string, rest string, kept string, spans string"
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or ""), True, "s", 7, [1], 2, "h", "r", "k", "p") for d, t in rows_], schema)
    every = sorted(docs.collect(), key=str)
    got = {name: stage(spark, docs, "") for name, stage in P.STAGES}
    for name, stage in P.STAGES[:-1]:
        assert got[name].schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.where("false"), "").count() == 0, name
    assert P.pack(spark, docs.where("false"), "").count() == 0
    letters = [r for r in every if r.doc_id in (None, 3, 5)]
    kept = got["language_id"].collect()
    assert sorted((r for r in kept if r.doc_id != 5), key=str) == [r for r in letters if r.doc_id != 5]
    once = {str(r): r for r in every if r.doc_id in (None, 1, 3, 4, 5)}  # the empty text goes with the null one
    assert sorted(got["near_dedup"].collect(), key=str) == sorted(once.values(), key=str)
    cut = {str(r.doc_id) + (r.text or "")[-4:]: r for r in got["suffix_array_dedup"].collect()}
    same = [r for r in every if r.doc_id in (1, 2, 4)]
    assert sorted((r for r in got["suffix_array_dedup"].collect() if r.doc_id in (1, 2, 4)), key=str) == same
    assert [r.text for r in got["suffix_array_dedup"].collect() if r.doc_id == 5] == ["x"]
    assert len(cut) <= len(every) and got["suffix_array_dedup"].where("doc_id is null").count() == 2
    assert sorted(got["secret_scan"].withColumn("n_chars", P.F.coalesce("n_chars", P.F.lit(0))).collect(), key=str) == every
    packed = got["best_fit_packing"].groupBy("doc_id").agg(P.F.countDistinct("piece").alias("n")).collect()
    assert {r.doc_id for r in packed} == {None, 1, 2, 3, 4, 5}


def test_run_leaves_no_stage_behind(spark):
    before = set(P.C._WRITTEN)
    P.run(spark, "/root/testdata/sf0.001").count()
    assert not [x for x in set(P.C._WRITTEN) - before if "/pipeline-" in x]
    P.C.discard_all()
    assert not P.C._WRITTEN


def test_rows_of_one_id_or_none_stay_apart(spark):
    texts = [" ".join(f"{c}{n}" for n in range(60)) for c in "abcde"]
    near = texts[1].replace("b59", "x")  # like the second, and of an id of its own
    ids = [None, None, 7, 7, 8, 9, None]
    rows_ = [(i, t, "en", "a", len(t)) for i, t in zip(ids, [*texts, near, texts[0]], strict=True)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text) for r in P.near_dedup(spark, docs, "").collect())
    assert got == sorted((i or 0, t) for i, t in zip(ids[:5], texts, strict=True))
    out = P.substring_dedup(spark, docs, "").collect()
    want = {(i, t) for i, t in zip(ids, texts, strict=False)}
    assert len(out) == len(rows_) and want <= {(r.doc_id, r.text) for r in out}
    assert [len(r.text) < len(near) for r in out if r.doc_id == 9] == [True]
