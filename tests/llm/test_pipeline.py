import hashlib

import numpy as np

import corpus_pipeline
from strandloom.llm import bpe


def test_stages_in_order(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["the", "and", "winter", "river", "hollow", "stone", "cloud", "amber", "field", "north"]
    docs, labels = [], []
    for i in range(120):
        text = " ".join(rng.choice(words, 60))
        junk = i % 6 == 0
        docs.append((i, text.upper().replace(" ", "!! ") if junk else text, "aa" if i % 2 else "bb"))
        labels.append((i, int(not junk), 0))
    bench = " ".join(f"exam{k}" for k in range(20))
    docs += [(500, docs[1][1], "aa"), (500, docs[1][1], "aa"), (501, docs[2][1] + " again", "bb"), (502, docs[5][1] + " " + bench, "aa"), (503, None, None), (504, "", None), (505, "12 34", None), (None, docs[7][1], None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'s' as source", "1L as n_chars", "'x' as _again", "'y' as _fragment", "2 as row", "3L as tkey", "0.5 as score", "4 as m").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert out.columns == frame.columns, name
        out.write.parquet(str(tmp_path / f"stage{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
        left.append({r.doc_id for r in frame.select("doc_id").collect()})
    clean = {i for i, q, _ in labels if q}
    assert not left[0] & {503, 504, 505} and clean <= left[0]
    assert not left[1] & ({i for i, q, _ in labels if not q}) and clean <= left[1]
    assert not left[2] & {500, 501} and clean <= left[2] | {1, 2}
    assert 502 in left[2] and 502 not in left[3] and left[2] - left[3] == {502}
    assert left[4] == left[3]
    assert {r.doc_id: r.decoded_sha256 for r in frame.collect()} == {i: hashlib.sha256(d[1].encode()).hexdigest() for d in docs for i in [d[0]] if i in left[4]}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == left[4]
    ranks = {v: k for k, v in bpe.load_ranks(bpe.ranks_path()).items()}
    text = {d[0]: d[1] for d in docs}
    assert all(b"".join(ranks[t] for t in ids).decode() == text[i] for i, ids in got.items())


def small(spark, path, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, small(spark, tmp_path, [], [], [])).count() == 0


def test_nulls_ties_and_a_long_text(spark, tmp_path):
    long = "the winter river " * 30_000
    docs = [(1, None, None, None, None), (None, "the hollow stone and more", "aa", None, 1), (2, long, "aa", "s", 1), (3, long, "aa", "s", 1), (3, long, "aa", "s", 1), (4, "", "aa", "s", 0), (5, "a field of amber in the north", "aa", "s", 1)]
    got = corpus_pipeline.run(spark, small(spark, tmp_path, docs, [(2, None, None)], [(1, None), (2, "")])).collect()
    want = {(None, docs[1][1]), (2, long), (5, docs[6][1])}
    assert {(r.doc_id, r.decoded_sha256) for r in got} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want} and len(got) == 3
