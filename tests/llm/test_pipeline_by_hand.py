"""The pipeline against plain Python: models are taken as fitted, what the stages make of them is done again."""

import hashlib
import math
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers as P
import regex
import tiktoken

import corpus_pipeline
from strandloom.llm import bpe, language_id, quality_gam

from .test_decontamination import by_hand as tiled
from .test_decontamination import words_of
from .test_jaccard_join import by_hand as linked
from .test_models_by_hand import gram_bin, quality_by_hand


def language_keeps(model, text):
    folded = regex.sub(r"[^\p{L}]+", " ", (text or "").lower())
    grams = Counter(gram_bin(folded[i : i + n], model.dims) for n in (1, 2, 3) for i in range(len(folded) - n + 1))
    z = [sum(n * float(model.table[b, k]) for b, n in grams.items()) / max(1, grams.total()) + model.bias[k] for k in range(len(model.langs))]
    e = [math.exp((x - max(z)) / model.temperature) for x in z]
    return bool(regex.search(r"\p{L}", text or "")) and max(e) / sum(e) >= 0.5


def quality_keeps(model, text):
    x = [float(np.float32(v)) for v in quality_by_hand(text)]
    z = model.bias + sum(t[bisect_right(list(c), v)] for c, t, v in zip(model.cuts, model.tables, x, strict=True))
    z += sum(t[bisect_right(list(model.coarse[a]), x[a]), bisect_right(list(model.coarse[b]), x[b])] for (a, b), t in model.pairs.items())
    return 1 / (1 + math.exp(-z)) >= 0.5


def corpus():
    rng = np.random.default_rng(12)
    vocabulary = {"aa": [f"{a}{b}" for a in ("wint", "riv", "ston", "hol") for b in ("er", "ing", "ed", "s", "low", "th")], "bb": [f"{a}{b}" for a in ("montañ", "rí", "verd", "aqu") for b in ("a", "os", "es", "el", "ón", "illo")]}
    items = [(i, " ".join(rng.choice(vocabulary["aa"], 14))) for i in range(5)]
    docs, labels = [], []
    for i in range(160):
        lang = ("aa", "bb")[i % 2]
        words = list(rng.choice(vocabulary[lang], rng.integers(12, 60)))
        if i % 10 == 4:
            words = docs[i - 4][1].split()
            words[int(rng.integers(0, len(words)))] = "other"
        if i % 12 == 6:
            words[5:5] = items[i % 5][1].split()[: int(rng.integers(4, 15))]
        junk = i % 7 == 3
        text = " ".join(words)
        docs.append((i, text.upper().replace(" ", "!! | ") if junk else text, lang if i % 9 else None, "s", len(text)))
        labels.append((i, int(not junk), 0))
    docs += [(200, docs[8][1], "aa", "t", 1), (201, None, None, None, None), (202, "", "aa", "s", 0), (203, "12 34", "bb", "s", 5), docs[10]]
    return docs, labels, items


def test_stages_by_hand(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left, out = list(docs), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if k == 0:
            model = language_id.fit(frame.where(~language_id.held_out()))
            left = [d for d in left if language_keeps(model, d[1])]
        elif k == 1:
            model = quality_gam.fit_on_sample(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where(~quality_gam.held_out()))
            left = [d for d in left if quality_keeps(model, d[1])]
        elif k == 2:
            heads = {c for _, c, _ in linked([d[:2] for d in left])}
            left = list({d[0]: d for d in left if d[0] in heads}.values())
        elif k == 3:
            left = [d for d in left if not any(tiled(words_of(t), words_of(d[1]), 5) >= 0.5 * len(words_of(t)) for _, t in items)]
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(str(tmp_path / f"stage{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert Counter(r.doc_id for r in frame.select("doc_id").collect()) == Counter(d[0] for d in left), k
        out.append(len(left))
    assert len(docs) > out[0] > out[1] > out[2] > out[3] > 50
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.ranks_path()), special_tokens={})
    want = {d[0]: (coder.encode_ordinary(d[1]), hashlib.sha256(d[1].encode()).hexdigest()) for d in left}
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in frame.collect()} == want
