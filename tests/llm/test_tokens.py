import random
import zlib

import numpy as np

from tallybrook.llm import huffman as H
from tallybrook.llm import packing as P
from tallybrook.llm import tokens as T

ODD = ["", "  ", "   a", "a  b", "a   b", "a \n  b", " x", " ", "a ", "a  ", "\n a", "\t  b\x1c  c", "it's 12 %% don't", "a\x1c b", "a　 b", "x<|endoftext|>y", "no_space" * 2000]


def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshréß.,\n") for _ in range(rng.randint(1, 9)))
    out = [(k, " ".join(word() for _ in range(rng.choice((1, 5, 50, 3000)))), k) for k in range(120)]
    out += [(200 + k, t, 0) for k, t in enumerate(ODD)]
    return out + [(500, None, 0), (None, "null id", 0), (3, "twin of three", 0), (3, "twin of three", 0)]


def expected(values):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(T.tokenizer_path())
    return [[*tool.encode(t or "", add_special_tokens=False).ids, 2] for t in values]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_library_ids():
    values = [t or "" for _, t, _ in rows()]
    got = T.encoder(T.tokenizer_path()).encode(values)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x[:-1] for x in expected(values)]


def test_ids_are_those_of_the_library_by_default():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(T.tokenizer_path())
    values = ["x\ty\tz\n\n\nw", "a\u00a0b\n\nc", "a\tb  c", "Âme e\u0301 한 次 b", "x<|endoftext|>y", "a <|endoftext|> b.\n<|endoftext|>", *ODD]
    got = T.PieceEncoder(T.tokenizer_path()).encode(values)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(x, add_special_tokens=False).ids for x in values]


def thue_morse(n):
    x, y = "a", "b"
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_pieces_of_equal_hashes_are_told_apart():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(T.tokenizer_path())
    (a, b), (c, d) = thue_morse(10), thue_morse(11)
    edges = np.array([0, 2048, 4096])
    assert len(set(T._hashes(np.frombuffer((c + d).encode(), np.uint8), edges).tolist())) == 1
    tool = T.PieceEncoder(T.tokenizer_path())
    for values in ([a, b], [c, d], [f"x {a} y {b} z {a}", f"{c} {d}"], [f"{d} {c}", b]):
        assert [np.frombuffer(x, "<u4").tolist() for x in tool.encode(values)] == [library.encode(x, add_special_tokens=False).ids for x in values]


def test_whole_table_has_the_library_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(T.tokenizer_path())
    values = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    tool, got = T.PieceEncoder(T.tokenizer_path()), []
    for i, j in T.slices(values):
        got += tool.encode(values[i:j])
    want = [x.ids for x in library.encode_batch(values, add_special_tokens=False)]
    assert [crc(np.frombuffer(x, "<u4")) for x in got] == [crc(x) for x in want]


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([0, 5, 9, 12, 13, 16, 45, 0])
    assert H.code_lengths(counts).tolist() == [0, 4, 4, 3, 3, 3, 1, 0]
    steep = np.array([2**k for k in range(30)])
    lengths = H.code_lengths(steep, 8).astype(int)
    assert lengths.max() == 8 and sum(2.0 ** -int(n) for n in lengths) <= 1
    assert H.code_lengths(np.array([0, 7])).tolist() == [0, 1] and H.code_lengths(np.array([0, 0])).tolist() == [0, 0]


def test_bits_round_trip():
    rng = np.random.default_rng(1)
    for size in (0, 1, 255, 256, 257, 16_384, 50_001):
        ids = np.minimum(rng.geometric(0.01, size), 900).astype(np.uint32)
        lengths = H.code_lengths(np.bincount(ids, minlength=1000))
        raw = H.write_file(np.array([7]), np.array([size]), ids, lengths, 11)
        start, doc_ids, counts, back = H.read_file(raw)
        assert (start, doc_ids.tolist(), counts.tolist()) == (11, [7], [size]) and (back == ids).all()


def check_round_trip(spark, data, parts):
    """Rows are in the order of ids, those of one id in any; starts add up."""
    df = spark.createDataFrame(data, "doc_id long, text string, n long").repartition(parts)
    files = H.encode_corpus(df)
    got = sorted(H.decode_corpus(files).collect(), key=lambda r: r.start)
    want = sorted(((-1 if d is None else d), np.array(x, "<u4").tobytes()) for (d, *_), x in zip(data, expected([t for _, t, _ in data]), strict=True))
    found = [(-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got]
    assert [d for d, _ in found] == [d for d, _ in want] and sorted(found) == want
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    return files


def test_corpus_round_trip(spark):
    files = check_round_trip(spark, rows(), 5)
    assert files.groupBy("part").count().where("count > 1").isEmpty()
    assert H.decode_corpus(H.encode_corpus(spark.createDataFrame(rows(), "doc_id long, text string, n long").where("false"))).count() == 0


def test_many_files_and_an_id_of_most_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "FILE_IDS", 500)
    data = [(None if k % 2 else 7, f"text {k} " * (k % 40), k) for k in range(300)] + rows()
    files = check_round_trip(spark, data, 5)
    assert files.groupBy("part").count().where("count > 1").count() > 1
    assert files.where("n_tokens > 20000").isEmpty()


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(T, "KEPT_IDS", 300)
    tool = T.PieceEncoder(T.tokenizer_path())
    for _, t, _ in rows()[:60]:
        assert [np.frombuffer(x, "<u4").tolist() for x in tool.encode([t or ""])] == [x[:-1] for x in expected([t])]
        assert len(tool.pool) <= 300


def test_one_task_packs_in_lots(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_PIECES", 25)
    data = rows()
    got = P.pack_documents(spark.createDataFrame(data, "doc_id long, text string, n long").coalesce(1)).toPandas()
    assert len(got) == sum(len(P.cut(len(x), 1024)) for x in expected([t for _, t, _ in data]))
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 1024 and len(fill) <= 1.03 * fill.sum() / 1024 + 1


def test_packing(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, piece int").repartition(4)
    got = P.pack_documents(df).toPandas()
    want = []
    for (d, *_), ids in zip(data, expected([t for _, t, _ in data]), strict=True):
        want += [(-1 if d is None else d, k, s, n, crc(ids[s : s + n])) for k, (s, n) in enumerate(P.cut(len(ids), 1024))]
    key = got.assign(doc_id=got.doc_id.fillna(-1))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(map(tuple, key.astype(int).to_numpy().tolist())) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 1024 + 1
    assert P.pack_documents(df.where("false")).count() == 0


def test_packing_carries_all_open_bins(spark):
    """One task has 20 long texts, 20 others a short one each that fits: every bin over the old cap was closed half empty."""
    long, short = " ".join(["a"] * 699), " ".join(["a"] * 319)
    data = [(k, long) for k in range(20)], [(100 + k, short) for k in range(20)]
    many = [spark.createDataFrame(spark.sparkContext.parallelize(d, n), "doc_id long, text string") for d, n in zip(data, (1, 20), strict=True)]
    got = P.pack_documents(many[0].unionByName(many[1]), carry=2).toPandas()
    assert sorted(got.length) == [320] * 20 + [700] * 20 and got.sequence_id.nunique() == 20


def test_cut_and_best_fit():
    assert P.cut(1, 4) == [(0, 1)] and P.cut(4, 4) == [(0, 4)] and P.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    sizes = np.array([6, 5, 4, 3, 2])
    bins = P.best_fit(sizes, 10)
    assert sorted(int(sizes[b].sum()) for b in bins) == [10, 10]
