"""The classifiers' features, counts and fitting steps against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import language_id, quality_gam, samples, toxicity
from strandloom.llm.text import Texts

TEXTS = ["", None, "One two THREE, four! You b4d b4dword. é", "a b\na b\n\nx|y | #1 tú dich", "word " * 300 + "Word", "¿Qué? 漢字 … “quoted” don't", "x\ty  z\r\n" * 4, "same same same other"]


def texts(values):
    return Texts.of(pa.array(values, pa.string()))


def kind(c):
    return next((k for k, p in enumerate(["[a-z]", "[A-Z]", "[0-9]", " ", r"[\t-\r]", r"""[.,;:'"\-()]""", "[!?]", "[#*$%&|<>]", r"[\x00-\x7f]", r"[\x80-ɏ]", r"[ɐ-῿]"]) if re.match(p, c)), 11)


def quality_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = Counter(map(kind, text))
    n, w = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    spoken = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    bare = sum(bool(re.search(r"[a-z]$|[^\x00-\x7f]$", x)) for x in words)
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / w, chars[1] / max(1, chars[0] + chars[1] + chars[9] + chars[10]), chars[2] / n, chars[7] / n, chars[6] / n, chars[5] / n, text.count("|") / n,
        (len(spoken) - len(set(spoken))) / max(1, len(lines)), len(again) / w, sum(a == b for a, b in zip(words, words[1:])) / w, len(set(words)) / w if words else 0,
        math.log1p(len(text) / max(1, len(lines))) if text else 0, (chars[9] + chars[10] + chars[11]) / n, (chars[3] + chars[4]) / n, bare / w,
    ]


def test_quality_features():
    got = quality_gam.dense_features(texts(TEXTS))
    assert got == pytest.approx(np.array([quality_by_hand(t) for t in TEXTS]), abs=1e-5)


def best_split(g, h, ridge):
    """The step function of at most two parts that lowers the quadratic loss most, by trying every split."""
    best, out = sum(g) ** 2 / (sum(h) + ridge) + 1e-9, [sum(g) / (sum(h) + ridge)] * len(g)
    for m in range(1, len(g)):
        parts = [(sum(g[:m]), sum(h[:m])), (sum(g[m:]), sum(h[m:]))]
        gain = sum(a * a / (b + ridge) for a, b in parts)
        if gain > best:
            best, out = gain, [parts[0][0] / (parts[0][1] + ridge)] * m + [parts[1][0] / (parts[1][1] + ridge)] * (len(g) - m)
    return out


def test_one_boosting_round():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, h = rng.normal(size=7), rng.uniform(0.1, 1, 7)
        assert quality_gam.shallow_tree(g, h, 2, 1.0) == pytest.approx(best_split(g, h, 1.0))
    x = np.array([[0.0], [0.0], [1.0], [1.0], [2.0], [2.0]])
    y = np.array([0, 0, 1, 1, 1, 0.0])
    model = quality_gam.fit_additive(x, y, cycles=1, pair_cycles=0, rate=0.2, leaves=2)
    share = y.mean()
    g = [sum(y[x[:, 0] == v] - share) for v in (0, 1, 2)]
    h = [2 * share * (1 - share)] * 3
    assert model.tables[0] == pytest.approx(0.2 * np.array(best_split(g, h, 1.0)))
    z = math.log(share / (1 - share)) + model.tables[0]
    assert model.score(np.array([[0.0], [1.0], [2.0]])) == pytest.approx(1 / (1 + np.exp(-z)))


def spelled(word, table):
    return bytes(table[b] for b in word.encode() if table[b])


def lexicon_keys(word, table=toxicity._READ):
    """What terms a word has: its beginnings of three to six folded bytes, and the whole."""
    s = spelled(word, table)
    return {(n, s[:n]) for n in range(3, 7) if len(s) >= n} | ({("whole", s)} if s else set())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_lexicon_counts(spark):
    rows = [(t, int(i % 3 == 0)) for i, t in enumerate(["you blargfool the river", "the river stone", "bl4rg-fool blargs you", "hollow stone the", "b.l.a.r.g you", "the the the"] * 6)]
    found, strength = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"), min_share=0.1, ratio=2.0, sure=1.0)
    n1 = sum(y for _, y in rows)
    counts = Counter((k, y) for t, y in rows for k in {k for w in split(t) for k in lexicon_keys(w)})
    want = []
    for k in {k for k, _ in counts}:
        a, b = counts[k, 1], counts[k, 0]
        odds = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (len(rows) - n1 + 1))
        if a >= 0.1 * n1 and odds >= 2 and math.log(odds) >= math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)):
            want.append(math.log(odds))
    assert sorted(strength) == pytest.approx(sorted(want)) and len(want) > 3 and (found[1:] > found[:-1]).all()


def test_toxicity_features():
    words = texts(["blargfool ugh"]).words()
    key = toxicity.keys(words)
    known = np.array([key[0, -1], key[1, 0]], np.uint64).view(np.int64)
    order = np.argsort(known)
    lexicon = known[order], np.array([2.0, 0.5])[order]
    strength_of = {("whole", b"blargfool"): 2.0, (3, b"ugh"): 0.5}
    values = ["you are a bl4rg_fool and UGHLY so", "ugh " + "x " * 9 + "you", "", None, "Blargfool!", "nothing to see here"] + [t for t in TEXTS if t]
    got = toxicity.dense_features(texts(values), lexicon)
    second = {spelled(w, toxicity._PLAIN) for w in toxicity.SECOND_PERSON}
    for text, row in zip(values, got, strict=True):
        ws = split(text)
        power = [max([strength_of.get(k, 0) for k in lexicon_keys(w)], default=0) for w in ws]
        hit = [p > 0 for p in power]
        near = [any(spelled(v, toxicity._PLAIN) in second for v in ws[max(0, i - 5) : i + 6]) for i in range(len(ws))]
        disguised = [bool(spelled(w, toxicity._PLAIN)) and spelled(w, toxicity._READ) != spelled(w, toxicity._PLAIN) for w in ws]
        chars = Counter(map(kind, text or ""))
        n, w = max(1, len(text or "")), max(1, len(ws))
        want = [sum(hit) / w, sum(power) / w, math.log1p(sum(hit)), max(power, default=0), sum(a and b for a, b in zip(hit, near)) / w, chars[1] / n, chars[6] / n, chars[5] / n, sum(disguised) / w, sum(a and b for a, b in zip(hit, disguised)), math.log1p(len(ws))]
        assert row == pytest.approx(want), text


def gram_bin(gram, dims):
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
    return (((h + len(gram)) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - (dims.bit_length() - 1))


def test_language_bins():
    dims = 1 << 12
    counts, _ = language_id.bin_counts(texts(TEXTS), dims)
    for text, row in zip(TEXTS, counts, strict=True):
        folded = re.sub(r"[\W\d_]+", " ", (text or "").lower())
        want = Counter(gram_bin(folded[i : i + n], dims) for n in (1, 2, 3) for i in range(len(folded) - n + 1))
        assert {k: v for k, v in enumerate(row.tolist()) if v} == want, text


def test_language_document_frequencies(spark):
    dims = 1 << 12
    rows = [(t,) for t in TEXTS]
    seen, df = language_id.document_frequencies(spark.createDataFrame(rows, "text string"), dims)
    counts, _ = language_id.bin_counts(texts(TEXTS), dims)
    assert seen == len(TEXTS) and (df == (counts > 0).sum(0)).all()


def test_samples_are_bounded_by_documents_not_by_rows(spark):
    rows = [(7, 1, 1)] * 500 + [(i, i % 2, i % 2) for i in range(60)] + [(7, 0, 0), (8, None, None), (None, 1, 1)]
    known = samples.labelled(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), "quality", "doc_id")
    assert known.count() == 61
    drawn = samples.least_drawn(known, 61, 20, 5).collect()
    hashes = {r.doc_id: r.draw for r in samples.least_drawn(known, 61, 100, 5).collect()}
    assert len(drawn) == 20 and max(r.draw for r in drawn) <= sorted(hashes.values())[20]
    docs = spark.createDataFrame([(7, "b")] * 300 + [(7, "a"), (3, None)], "doc_id long, text string")
    some = spark.createDataFrame([(7, 1), (7, 0), (3, 1), (99, 1)], "doc_id long, y int")
    assert sorted(map(tuple, samples.texts_of(docs, some, "doc_id", "text").select("doc_id", "y", "text").collect())) == [(3, 1, ""), (7, 0, "a"), (7, 1, "a")]


@pytest.mark.parametrize("toxic", [1, 2, 4, 6])
def test_a_label_with_few_documents_still_gives_a_model(spark, toxic):
    """Fewer toxic documents than parts: what they say in capitals is learned; the calibrated scores are no constant."""
    docs = spark.createDataFrame([(i, f"SHOUT {i} AT THEM ALL!!" if i < toxic or i >= 45 else f"text {i} about the river") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < toxic)) for i in range(40)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert min(score[i] for i in [*range(toxic), *range(45, 50)]) > 0.5 > max(score[i] for i in range(toxic, 45))


@pytest.mark.parametrize("known", [[], [(1, 1)], [(1, 0), (2, 0)], [(1, 1), (2, 1), (3, 1)]])
def test_without_one_of_the_labels_the_score_is_a_share(spark, known):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    share = sum(y for _, y in known) / max(1, len(known))
    assert {(r.score, r.predicted) for r in toxicity.classify(docs, spark.createDataFrame(known, "doc_id long, toxic int")).collect()} == {(share, int(share >= 0.5))}


def test_every_capital_is_folded():
    for upper in "A\u0186\u1e9e\ua680\uff21\U00010400\U0001e900\u13a0":
        low = upper.lower()[0]
        counts, _ = language_id.bin_counts(texts([upper, low]), 1 << 12)
        assert upper != low and (counts[0] == counts[1]).all()


def isotonic_by_hand(margin, y, weight):
    """Pool adjacent violators over margins in order, equal margins pooled first."""
    pools = []
    for m in sorted(set(margin)):
        own = [(b, w) for a, b, w in zip(margin, y, weight, strict=True) if a == m]
        pools.append([sum(b * w for b, w in own), sum(w for _, w in own), [m]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            top = pools.pop()
            pools[-1] = [pools[-1][0] + top[0], pools[-1][1] + top[1], pools[-1][2] + top[2]]
    return {m: a / b for a, b, ms in pools for m in ms}


def test_calibration_by_pooling(spark):
    rng = np.random.default_rng(4)
    margin = np.round(rng.normal(size=80), 1).tolist()
    y = [int(rng.random() < 1 / (1 + math.exp(-2 * m))) for m in margin]
    weight = [1.0 if v else 2.5 for v in y]
    model = toxicity.IsotonicRegression(labelCol="y", weightCol="weight", featuresCol="margin", predictionCol="score").fit(spark.createDataFrame(list(zip(margin, y, weight, strict=True)), "margin double, y int, weight double"))
    want = isotonic_by_hand(margin, y, weight)
    got = {r.margin: r.score for r in model.transform(spark.createDataFrame([(m,) for m in want], "margin double")).collect()}
    assert got == pytest.approx(want)


def test_equal_features_tie_and_equal_references_tie(spark):
    """Texts of equal features get equal scores, wherever they stand."""
    docs = spark.createDataFrame([(i, "YOU FOOL!!" if i % 2 else "a calm river") for i in range(40)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert len({(r.doc_id % 2, r.score) for r in toxicity.classify(docs, labels).collect()}) == 2
