import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import language_id, quality_gam, quality_rules, toxicity
from strandloom.llm.text import Texts

ODD = [(900, None), (901, ""), (902, "  \n\t"), (903, "123 ... !!"), (904, "a" * 50_000), (905, "word " * 20_000)]


def table(spark, rows, path, name, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Two invented languages; junk in capitals; toxic documents with a made-up insult, sometimes disguised."""
    path = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(2)
    words = {"aa": ["the", "and", "winter", "river", "hollow", "stone"], "bb": ["lo", "que", "montaña", "ríos", "aquel", "verde"]}
    docs, labels = [], []
    for i in range(600):
        lang = ("aa", "bb")[i % 2]
        text = [str(rng.choice(words[lang])) for _ in range(rng.integers(20, 80))]
        junk, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for at in rng.integers(0, len(text), 3):
                text[at] = ("you " if at % 2 else "") + ("blargfool" if i % 3 else "bl4rgfool")
        body = " ".join(text)
        docs.append((i, body.upper().replace(" ", "!! ") if junk else body, lang, "s", len(body)))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(i, t, None, None, 0) for i, t in ODD] + [docs[3]]
    labels += [(901, None, None), (12345, 1, 1)]
    table(spark, docs, path, "documents", "doc_id long, text string, lang string, source string, score long")
    table(spark, labels, path, "labels", "doc_id long, quality int, toxic int")
    return str(path), docs, {i: (q, t) for i, q, t in labels}


def crc(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode())


def test_language(spark, corpus):
    path, docs, _ = corpus
    rows = language_id.op7_ngram_language(spark, path).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    lang = {d[0]: d[2] for d in docs}
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]) > 0.97
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (900, 901, 902, 903))


def test_language_counts_against_brute_force():
    texts = ["Aé b", "", "x", "a  1 B", None]
    dims = 1 << 10
    counts, letters = language_id.bin_counts(Texts.of(pa.array(texts, pa.string())), dims)
    grams = []
    for t in texts:
        folded = re.sub(r"[^a-zé]+", " ", (t or "").lower())
        grams.append(sum(max(0, len(folded) - n + 1) for n in (1, 2, 3)))
    assert counts.sum(1).tolist() == grams and letters.tolist() == [3, 0, 1, 2, 0]
    alone, _ = language_id.bin_counts(Texts.of(pa.array(["Aé b"])), dims)
    assert (alone[0] == counts[0]).all()


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in language_id.softmax(z)])
    assert abs(language_id.calibrate(z * 5, y) - 5) < 0.6


def test_quality(spark, corpus):
    path, docs, labels = corpus
    rows = quality_gam.op3_additive_quality(spark, path).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id][0] for r in rows if r.held_out and r.doc_id < 900]) > 0.97


def test_interactions_are_learned():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit_additive(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_no_labels(spark):
    docs, labels = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, y string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_gam.classify(docs, labels).first().score == pytest.approx(0.5)
    assert toxicity.classify(docs, labels).first().score == 0.0


def test_toxicity(spark, corpus):
    path, docs, labels = corpus
    rows = toxicity.op4_boosted_toxicity(spark, path).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in rows if r.held_out and r.doc_id < 900]) > 0.97
    assert not any(r.predicted for r in rows if r.doc_id in (900, 901, 902, 903))


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts_against_brute_force(spark, corpus):
    path, docs, _ = corpus
    extra = [(2000 + i, t, "aa", "s", 0) for i, t in enumerate(["a b\na b\n\n \na b", "é|x # #  ", "w v w v w v w v w v", "1\r\n1\r\n1", "x " * 4 + "y " + "x " * 4 + "y"])]
    df = spark.createDataFrame([*docs, *extra], "doc_id long, text string, lang string, source string, score long")
    rows = quality_rules.judge(df, quality_rules.references(df)).collect()
    want = Counter((d[0], *by_hand(d[1])) for d in [*docs, *extra])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)


def test_rules_ignore_columns_of_any_name(spark, corpus):
    path, docs, _ = corpus
    df = spark.read.parquet(path + "/documents.parquet").where("lang is not null")
    plain = quality_rules.judge(df, quality_rules.references(df))
    odd = df.selectExpr("*", "1 as n_words", "'x' as kept", "2 as n", "3 as bin", "'w' as kind", "4 as word")
    assert sorted(map(tuple, quality_rules.judge(odd, quality_rules.references(odd)).collect())) == sorted(map(tuple, plain.collect()))


def test_summaries_keep_heavy_words():
    rng = np.random.default_rng(3)
    stream = rng.permutation(np.concatenate([np.full(300, 1), np.full(250, 2), np.arange(100, 5000)]))
    known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in np.array_split(stream, 40):
        known, counts = quality_rules._heavy(np.concatenate([known, part]), np.concatenate([counts, np.ones(len(part), np.int64)]), 30)
        assert len(known) <= 30
    assert {1, 2} <= set(known.tolist())


def test_references_and_distances(spark, corpus):
    path, docs, _ = corpus
    df = spark.read.parquet(path + "/documents.parquet")
    refs = quality_rules.references(df, common_share=0.02)
    assert set(refs) == {"aa", "bb"} and all(abs(r["shares"].sum() - 1) < 1e-9 and abs(r["chars"].sum() - 1) < 1e-9 for r in refs.values())
    spoken = Counter(w.lower() for d in docs if d[2] == "aa" for w in d[1].split())
    top = sorted((n / spoken.total() for n in spoken.values() if n >= 0.02 * spoken.total()), reverse=True)
    assert sorted(refs["aa"]["shares"][:-1], reverse=True) == pytest.approx(top)
    p, q = np.array([[2, 0], [0, 3], [1, 1], [0, 0]]), np.array([0.5, 0.5])
    assert quality_rules.js_distance(p, q) == pytest.approx([0.5579230452841438] * 2 + [0, 0])


@pytest.mark.parametrize("run", [language_id.op7_ngram_language, quality_gam.op3_additive_quality, toxicity.op4_boosted_toxicity, quality_rules.op6_divergence_rules])
def test_empty_tables(spark, tmp_path, run):
    table(spark, [], tmp_path, "documents", "doc_id long, text string, lang string")
    table(spark, [], tmp_path, "labels", "doc_id long, quality int, toxic int")
    assert run(spark, str(tmp_path)).count() == 0
