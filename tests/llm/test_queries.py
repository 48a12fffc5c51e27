"""Every registered query of the subpackage on a whole small table: its columns, and its rows against a plain version."""

import hashlib
import zlib

import numpy as np
import pytest

from tallybrook.llm import ann, html_text, langid, pieces, queries, secrets
from tests.llm.test_repair import brute as brute_repair
from tests.llm.test_simhash import brute_components
from tests.llm.test_suffix_dedup import brute as brute_repeats

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op2_document_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op3_sentencepiece": "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string",
    "op4_huffman_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean",
    "op7_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_html_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op10_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op11_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op12_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op13_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def rows(spark):
    held = {}

    def of(name):
        if name not in held:
            df = queries.queries()[name](spark, DIR)
            assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) == COLUMNS[name]
            held[name] = [tuple(r) for r in df.collect()]
        return held[name]

    return of


def library_ids(texts):
    from tokenizers import Tokenizer

    from tallybrook.llm import tokens

    return [[*x.ids, 2] for x in Tokenizer.from_file(tokens.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_every_query_is_listed():
    assert set(queries.queries()) == set(COLUMNS) and set(queries.oracle_sql()) <= set(COLUMNS)


def test_op1(rows, docs):
    assert sorted(rows("op1_suffix_array_dedup")) == brute_repeats([(d, t.encode()) for d, t in docs], 100)


def test_op2(rows, docs):
    got = {r[0]: r for r in rows("op2_document_fingerprints")}
    assert len(got) == len(docs)
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        assert got[d][1:3] == (len(t), hashlib.sha256(changed.encode()).hexdigest()) and all(0 <= x <= 1 for x in got[d][5:])
    same = {}
    for d, t in docs:
        assert same.setdefault(t, got[d][3]) == got[d][3]


def test_op3(rows, docs):
    tool = pieces.encoder(pieces.model_path()).library
    want = []
    for d, t in docs:
        ids = tool.encode(t)
        want.append((d, len(ids), crc(ids), hashlib.sha256(tool.decode(ids).encode()).hexdigest()))
    assert sorted(rows("op3_sentencepiece")) == want


def test_op4(rows, docs):
    at, want = 0, []
    for (d, _), ids in zip(docs, library_ids([t for _, t in docs]), strict=True):
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(rows("op4_huffman_tokens")) == want


def test_op5(rows, docs):
    got, want = rows("op5_best_fit_packing"), []
    for (d, _), ids in zip(docs, library_ids([t for _, t in docs]), strict=True):
        first = len(ids) % 1024 or min(len(ids), 1024)
        for k, (s, e) in enumerate(zip([0, *range(first, len(ids), 1024)], [first, *range(first + 1024, len(ids) + 1, 1024)], strict=True)):
            want.append((d, k, s, e - s, crc(ids[s:e])))
    assert sorted(r[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 1024
    total = sum(r[3] for r in got)
    assert len(bins) <= -(-total // 1024) + 2


def test_op6(rows, docs, spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = rows("op6_language_id")
    assert len(got) == len(docs) and all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in got)
    assert all((r[2] == langid.UNKNOWN) == (not any(c.isalpha() for c in dict(docs)[r[0]])) for r in got)
    held = [r for r in got if r[1] and r[2] != langid.UNKNOWN]
    assert sum(r[2] == lang[r[0]] for r in held) >= 0.95 * len(held)


def test_op7(rows, docs):
    assert sorted(rows("op7_simhash_near_dedup")) == brute_components(docs)


def test_op8(rows, spark):
    own = spark.read.parquet(f"{DIR}/embeddings.parquet").toPandas()
    x, ids = np.stack(own.embedding.to_numpy()).astype(float), own.vec_id.to_numpy()
    want = {}
    for i, q in zip(ids.tolist(), x):
        if i % 20 == 0:
            score = ann.exact(x, q)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:20]
            want |= {(i, n + 1): (int(ids[j]), float(score[j])) for n, j in enumerate(order)}
    got = {(r[0], r[1]): r[2:] for r in rows("op8_nearest_neighbours")}
    assert set(got) == set(want) and sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_op9(rows, spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = rows("op9_html_main_text")
    assert {r[0] for r in got} == set(pages) and len(got) == len(pages)
    for page_id, url, text, n in got:
        raw = pages[page_id].html or ""
        assert (url, n) == (pages[page_id].url, len(text)) and text == html_text.main_text(raw)
        assert "<" not in text or "&lt;" in raw or "<" in html_text.html.unescape(raw)


def test_op10(rows, docs):
    assert sorted(rows("op10_secret_scan")) == sorted((d, *secrets.scan(t)) for d, t in docs)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(rows, name):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    own = [c.split()[0] for c in COLUMNS[name].split(", ")]
    assert sorted(rows(name)) == sorted(con.execute(f"select {', '.join(own)} from ({queries.oracle_sql()[name]})").fetchall())


def test_op12(rows, spark):
    own = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(rows("op12_conversation_repair")) == brute_repair(own)
