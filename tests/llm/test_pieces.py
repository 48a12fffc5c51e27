import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybrook.llm import pieces as P

ODD = ["", " ", "  ", "a", " a", "a  b   c ", "\n", "a\nb\tc", "x▁y", "é€𝄞́", "日本語のテキスト", "\x00", "aaaaaaaaaaaaaaa", "…—–", "ﬁ ①", "don't stop", "=" * 70, "-" * 33, "h" * 5000, "​", "the " * 50]


def same(values):
    tool = P.encoder(P.model_path())
    got = [np.frombuffer(x, "<u4").tolist() for x in tool.encode(values)]
    assert got == tool.library.encode(values, num_threads=1)
    for ids in got:
        assert tool.decode(np.array(ids, np.uint32)) == tool.library.decode(ids)


def test_the_library_gives_the_same_ids():
    same(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aeinstr th.,\n"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
def test_any_text(values):
    same([v.replace("\x00", "") for v in values])


def test_only_ends_of_pieces_are_looked_up():
    """Every end of a word of up to the longest piece's length was looked up at each of its characters."""
    forward, asked = P.PieceEncoder(P.model_path()).forward, 0

    class Counted(dict):
        def get(self, key, default=None):
            nonlocal asked
            asked += 1
            return dict.get(self, key, default)

    forward.ends, forward.ids = Counted(forward.ends), Counted(forward.ids)
    word = P.MARK + "0123456789zqxj" * 20
    forward.encode([word])
    assert asked < forward.longest * len(word) / 3


def test_corpus_texts(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(1000).collect()]
    same(texts)


def test_unigram_viterbi_against_all_paths():
    rng = random.Random(6)
    for _ in range(60):
        vocab = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(9)} | {"a"}
        scores = {p: -rng.random() * 9 for p in vocab}
        forward = P.Forward({p: k for k, p in enumerate(sorted(vocab))}, scores, bpe=False)
        words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 8))) for _ in range(9)]
        for word, ids in forward.encode(words).items():
            def total(cuts):
                parts = [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]
                return sum(scores[p] if p in scores else forward.unknown if len(p) == 1 else -1e9 for p in parts)

            best = max(total(c) for n in range(len(word)) for c in itertools.combinations(range(1, len(word)), n))
            assert abs(best - sum(scores[forward.text_of[t]] if t >= 0 else forward.unknown for t in ids)) < 1e-9


def test_tables(spark):
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(None, "null id", 1), (3, "twin", 1), (99, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    encoded = P.encode_rows(df)
    back = {(r.doc_id, r.text) for r in P.decode_rows(encoded).collect()}
    assert {(d, t or "") for d, t, _ in rows if "▁" not in (t or "")} <= back and len(back) == len(rows)
    assert all(r.same for r in P.round_trip(df.where("doc_id <> 8")).collect())
    assert P.round_trip(df.where("false")).collect() == []
