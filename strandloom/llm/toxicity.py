"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from labelled rows: words and word beginnings of three to six letters that are far
more frequent in toxic than in other texts, with the logarithm of that ratio as strength. Look-alike
characters are read as the letters they stand for and separators inside words are skipped, so a
disguised word still hits; that it was disguised counts as a feature of its own. Dense features are
densities of hits, hits near a second-person word, capitals, punctuation and obfuscation rates.

The lexicon, the trees and the calibration are each fitted on a part of their own (two fifths, two fifths, one
fifth) of one bounded sample, at most ``per_class`` toxic and ``per_class`` other documents, weighted back to the shares of
all labelled ones. A step whose part has no document of a label, as there are fewer than five of it, takes all of that label in the sample.

Defined results: null counts as empty; empty texts are scored as texts without a hit; very long texts are read
whole; rows without a label, or with a null one, are scored but not learned from; repeated rows are scored each on
its own, but a document is learned from once, with each label it has; of terms that hit one word, the strongest counts;
texts of equal features get equal scores; other columns are ignored; an empty table gives no rows. Where one of the labels has no
document at all, the score is the share of label 1 among the labelled documents (0 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality_rules import char_histograms
from ..storage import materialize, spread
from .samples import labelled, least_drawn, texts_of
from .text import Texts, Words, mix, powers, slices

FEATURES = ["hit_density", "strength_density", "hits", "strongest", "near_second_person", "capitals", "marks", "punctuation", "obfuscated", "obfuscated_hits", "log_words"]
SHORTEST, LONGEST, PARTS = 3, 6, 5
# Second-person words of the languages at hand (fixed values).
SECOND_PERSON = ["you", "your", "yours", "you're", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros"]
# Characters read as the letters they stand for (fixed values).
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Bytes to folded bytes, with and without look-alikes; 0 for bytes that are skipped."""
    plain = np.zeros(256, np.uint8)
    plain[128:] = np.arange(128, 256)
    for c in range(26):
        plain[97 + c] = plain[65 + c] = 97 + c
    read = plain.copy()
    for a, b in LOOK_ALIKE.items():
        read[ord(a)] = ord(b)
    return plain, read


_PLAIN, _READ = _tables()


def _spelled(words: Words, table: np.ndarray) -> tuple[Texts, np.ndarray]:
    """The folded letters of each word as one text each (skipped bytes left out), and the size of each."""
    data = table[words.texts.data]
    kept = (data > 0) & words.inside
    cum = np.concatenate([[0], np.cumsum(kept)])
    bounds = np.concatenate([cum[words.start], cum[-1:]]) if words.n else np.zeros(1, np.int64)
    return Texts(data[kept], bounds), np.diff(bounds)


def keys(words: Words, table: np.ndarray = _READ) -> np.ndarray:
    """Words x (LONGEST - SHORTEST + 2): hashes of the beginnings and of the whole word; 0 where a word is shorter.

    Beginnings count bytes of folded letters; the whole word has a hash of another kind.
    """
    spelled, size = _spelled(words, table)
    width = LONGEST - SHORTEST + 2
    out = np.zeros((words.n, width), np.uint64)
    if not len(spelled.data):
        return out
    body = np.append(spelled.data, np.zeros(LONGEST, np.uint8)).astype(np.uint64)
    at = spelled.offsets[:-1]
    h = np.zeros(words.n, np.uint64)
    for n in range(1, LONGEST + 1):
        h = h * np.uint64(0x100000001B3) + body[np.minimum(at + n - 1, len(body) - 1)] + np.uint64(1)
        if n >= SHORTEST:
            out[:, n - SHORTEST] = np.where(size >= n, mix(h + np.uint64(n)), 0)
    some = np.flatnonzero(size > 0)
    ids = np.repeat(np.arange(words.n), size)
    pos = np.arange(len(ids)) - spelled.offsets[ids]
    whole = np.add.reduceat((spelled.data.astype(np.uint64) + np.uint64(7)) * powers(int(size.max()))[pos], spelled.offsets[:-1][some])
    out[some, -1] = mix(whole ^ np.uint64(0x5BD1E995))
    return out


def learn_lexicon(sample: DataFrame, *, min_share: float = 0.004, ratio: float = 15.0, sure: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and strengths of the terms; sample: text, y.

    A term is in at least ``min_share`` of the toxic rows, its odds are ``ratio`` times as high as in the others, and the
    logarithm of that lies ``sure`` standard errors above 0. The sample bounds how many terms there are.
    """

    def count(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            for a, _, texts in slices(batch.column(0)):
                words = texts.words()
                k = keys(words)
                doc = np.repeat(words.doc, k.shape[1])
                k = k.ravel()
                doc, k = doc[k > 0], k[k > 0]
                order = np.lexsort((doc, k))
                doc, k = doc[order], k[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])
                doc, k = doc[new], k[new]
                u, inverse = np.unique(k, return_inverse=True)
                toxic = np.bincount(inverse, y[a + doc], len(u)).astype(np.int64)
                clean = np.bincount(inverse, minlength=len(u)) - toxic
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(toxic), pa.array(clean)], ["key", "toxic", "clean"])

    rows = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = rows.get(1, 0), rows.get(0, 0)
    counted = sample.select("text", "y").mapInArrow(count, "key bigint, toxic bigint, clean bigint").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    top = counted.where(F.col("toxic") >= min_share * n1).withColumn("odds", odds).where((F.col("odds") >= ratio) & (F.log("odds") >= sure * error)).collect()
    top.sort(key=lambda r: r.key)
    return np.array([r.key for r in top], np.int64), np.array([np.log(r.odds) for r in top])


def dense_features(texts: Texts, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Texts x FEATURES."""
    known, power = lexicon
    words = texts.words()
    strength = np.zeros(words.n)
    plain = keys(words, _PLAIN)
    read = keys(words)
    disguised = (read[:, -1] != plain[:, -1]) & (plain[:, -1] > 0)
    if len(known) and words.n:
        k = read.view(np.int64)
        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
        strength = np.where(known[at] == k, power[at], 0).max(1)
    hit = strength > 0
    second = np.isin(plain[:, -1], _second_person())
    reach = np.zeros(words.n + 1, np.int64)
    near = np.flatnonzero(second)
    np.add.at(reach, np.maximum(near - 5, 0), 1)
    np.add.at(reach, np.minimum(near + 6, words.n), -1)
    close = hit & (np.cumsum(reach[:-1]) > 0)
    chars = char_histograms(texts).astype(float)
    n, w = np.maximum(chars.sum(1), 1), np.maximum(words.per_doc, 1)

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc, x, texts.n) if words.n else np.zeros(texts.n)

    strongest = np.zeros(texts.n)
    np.maximum.at(strongest, words.doc[hit], strength[hit])
    hits = per_doc(hit)
    out = [hits / w, per_doc(strength) / w, np.log1p(hits), strongest, per_doc(close) / w, chars[:, 1] / n, chars[:, 6] / n, chars[:, 5] / n, per_doc(disguised) / w, per_doc(disguised & hit), np.log1p(words.per_doc)]
    return np.stack(out, 1)


def _second_person() -> np.ndarray:
    return keys(Texts.of(pa.array([" ".join(SECOND_PERSON)])).words(), _PLAIN)[:, -1]


def features(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns in keep (name type) and x, the features of every row of docs (text first)."""
    names = [k.split()[0] for k in keep]

    def run(batches):
        for batch in batches:
            for a, b, texts in slices(batch.column(0)):
                x = dense_features(texts, lexicon)
                yield pa.RecordBatch.from_arrays([*(batch.column(i + 1).slice(a, b - a) for i in range(len(names))), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], [*names, "x"])

    return docs.select("text", *names).mapInArrow(run, ", ".join([*keep, "x array<double>"]))


def _margin(model, feats: DataFrame) -> DataFrame:
    raw = model.transform(feats.withColumn("features", array_to_vector("x")))
    return raw.withColumn("margin", vector_to_array("rawPrediction")[1])


def cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", per_class: int = 6_000, trees: int = 20, depth: int = 3, seed: int = 3) -> DataFrame:
    """doc_id, score, predicted of every row of docs."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = labelled(labels, label, doc_id)
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    # Of each label, at most per_class documents; by rank of the draw, so that every part gets its share of both labels.
    drawn = None
    for y, n in ((1, n1), (0, n0)):
        rank = F.row_number().over(Window.partitionBy("y").orderBy("draw", "doc_id"))
        one = least_drawn(known.where(F.col("y") == y), n, per_class, seed).select("doc_id", "y", ((rank - 1) % PARTS).alias("part"), F.lit(n / max(1, min(n, per_class))).alias("weight"))
        drawn = one if drawn is None else drawn.unionByName(one)
    sample = materialize(texts_of(docs, materialize(drawn), "doc_id", "text"))
    there = {(r.y, r.part) for r in sample.select("y", "part").distinct().collect()}
    if len({y for y, _ in there}) < 2:
        share = n1 / (n1 + n0) if n1 + n0 else 0.0
        return docs.select("doc_id", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))

    def step(*parts: int) -> Column:
        return F.col("part").isin(*parts) | F.col("y").isin([y for y in (0, 1) if not any((y, p) in there for p in parts)])

    lexicon = learn_lexicon(sample.where(step(0, 1)).coalesce(cores(sample)))
    rows = materialize(features(sample.coalesce(cores(sample)), lexicon, ["y int", "part int", "weight double"])).coalesce(cores(sample)).withColumn("features", array_to_vector("x")).persist()
    boosted = GBTClassifier(labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(rows.where(step(2, 3)))
    calibrated = IsotonicRegression(labelCol="y", weightCol="weight", featuresCol="margin", predictionCol="score").fit(_margin(boosted, rows.where(step(4)).drop("features")).select("y", "weight", "margin"))
    rows.unpersist()
    scored = _margin(boosted, features(docs, lexicon, ["doc_id bigint"])).select("doc_id", "margin")
    return calibrated.transform(scored).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op4_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = classify(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
