import random
import zlib

import numpy as np

from tallybrook.llm import langid as L


def brute_grams(text):
    out = {}
    marked = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in marked:
        marked = marked.replace("  ", " ")
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            out[marked[i : i + n]] = out.get(marked[i : i + n], 0) + 1
    return out


def test_grams_count_every_gram():
    for text in ("The quick, brown fox!", "é", "a" * 9, "ein  Haus\n"):
        counts = L.grams(text)
        assert counts.sum() == sum(brute_grams(text).values())
    assert L.grams("12 34 !?") is None and L.grams("") is None


def test_grams_of_long_texts_are_those_of_the_whole(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("abΣé  .,1\n") for _ in range(rng.randint(1, 70)))
        whole = L.grams(text)
        for size in (1, 2, 3, 7, 16):
            with monkeypatch.context() as m:
                m.setattr(L, "_SLICE", size)
                part = L.grams(text)
            assert (whole is None and part is None) or (whole == part).all()
        assert whole is None or whole.sum() == sum(brute_grams(text).values())


def test_model_is_that_of_direct_counts(spark):
    """Cosines of the vectors made from plain dictionaries of n-grams against the model's centroids."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    (model,) = L.fit(docs)
    rows = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]

    def place(gram):
        h = 0
        for c in gram:
            h = (h * 0x1F123BB5 + ord(c)) % 2**64
        h ^= {1: 0, 2: 1 << 40, 3: 2 << 40}[len(gram)]
        return (h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - L.DIMS.bit_length() + 1)

    found, vectors = np.zeros(L.DIMS, int), []
    for r in rows:
        counts = np.zeros(L.DIMS)
        for gram, n in brute_grams(r.text).items():
            counts[place(gram)] += n
        found += counts > 0
        vectors.append(np.log1p(counts))
    idf = np.log((1 + len(rows)) / (1 + found)) + 1
    assert np.allclose(idf, model.idf)
    for r, v in zip(rows, vectors):
        v = v * idf / np.linalg.norm(v * idf)
        cosine = [sum(a * b for a, b in zip(c.tolist(), v.tolist())) for c in model.centres]
        lang, score, _ = model.predict(r.text)
        assert lang == model.langs[int(np.argmax(cosine))] and abs(score - max(0.0, min(1.0, max(cosine)))) < 1e-4


def test_names_that_clash(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    (model,) = L.fit(docs)
    odd = docs.selectExpr("*", "7 AS score", "'x' AS Lang_Pred", "true AS rejected", "1 AS own", "2 AS found")
    got = L.predict(odd, [model])
    assert got.columns == [*docs.columns, "own", "found", "lang_pred", "score", "rejected"]
    assert sorted(got.select("doc_id", "lang_pred", "score").collect()) == sorted(L.predict(docs, [model]).select("doc_id", "lang_pred", "score").collect())


def test_more_languages_than_a_model_holds(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(tuple(r) for r in L.identify(docs).collect())
    for most in (1, 3):
        monkeypatch.setattr(L, "MOST_LANGUAGES", most)
        monkeypatch.setattr(L, "FEW_RATES", most)
        assert len(L.fit(docs)) == -(-docs.select("lang").where("lang is not null").distinct().count() // most)
        got = sorted(tuple(r) for r in L.identify(docs).collect())
        assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want]) and [r[4] for r in got] == [r[4] for r in want]


def test_copies_do_not_fill_the_sample(spark):
    same = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'the same words again' AS text", "'en' AS lang")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").unionByName(same)
    assert L.identify(docs).where("doc_id IS NULL AND lang_pred <> 'en'").count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.held_out == found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    own = found[found.held_out]
    assert (own.lang_pred == own.lang).mean() > 0.97
    assert found.score.between(0, 1).all() and found.rejected.mean() < 0.02


def test_odd_rows(spark):
    rows = [(k, "the house is in the street and the dog is at the door", "en", 1) for k in range(12)]
    rows += [(k, "das haus ist in der strasse und der hund ist vor der tuer", "de", 1) for k in range(20, 32)]
    rows += [(40, None, "en", 1), (41, "", "en", 1), (42, "123 !!", "de", 1), (None, "the dog", None, 1), (43, "x" * 3_000_000, "en", 1), (1, "the house", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in L.identify(df).collect()}
    assert [got[k].lang_pred for k in (40, 41, 42)] == ["und"] * 3 and got[40].score == 0
    assert got[None].lang_pred == "en" and not got[None].held_out
    assert L.identify(df).count() == len(rows)
    assert L.identify(df.where("false")).collect() == []
    nothing = L.identify(df.withColumn("lang", L.F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_far_text_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    (model,) = L.fit(docs)
    assert model.predict("жизнь прекрасна и удивительна " * 9)[2] and not model.predict("Lllldoado.")[2]
    assert abs(np.linalg.norm(model.centres, axis=1) - 1).max() < 1e-4
