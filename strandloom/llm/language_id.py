"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of one to three lower-cased code points (anything that is not a letter counts as
one blank, runs of blanks as one), hashed into ``dims`` bins, as term frequency (share of the text's
n-grams) times inverse document frequency. Document frequencies are counted over all documents that
may be learned from. The weights are fitted by FTRL-proximal with L1 and L2 penalties on one half of a bounded
sample of different texts; its other half sets the temperature that calibrates the probabilities.

Because the features of a text are a weighted sum over its n-grams, a text's class scores are the mean
of its n-grams' rows of (idf x weights): scoring is one pass of table look-ups over whole texts.

Defined results: a null text or one without a letter gives ``und`` with score 0; very long texts are read
whole; an empty table gives no rows; repeated rows are scored each on its own, and learned from once in the fit; other
columns are ignored; a tie goes to the language that sorts first. Without any labelled row, everything is ``und``; where no
language has a second text, the temperature is 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import spread
from .text import code_points, members, slices, sums

BLANK = 0x20


def _fold_table() -> tuple[np.ndarray, np.ndarray]:
    """Of code points: the lower-cased letter, or a blank; and whether it is a letter."""
    global _fold
    if _fold is None:
        letter = members(r"\p{L}")
        fold = np.full(0x110000, BLANK, np.uint32)
        at = np.flatnonzero(letter)
        fold[at] = [ord(chr(p).lower()[0]) for p in at.tolist()]
        _fold = fold, letter
    return _fold


_fold: tuple[np.ndarray, np.ndarray] | None = None


def grams(texts, dims: int, longest: int = 3) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each n, the bin of the n-gram at each code point (``dims`` where none fits in the text); the texts' offsets; letters per text."""
    fold, letter = _fold_table()
    points, offsets = code_points(texts)
    letters = sums(letter[points], offsets)
    folded = fold[points]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != BLANK) | (folded[:-1] != BLANK)
    keep[offsets[:-1][offsets[:-1] < len(folded)]] = True
    base = np.concatenate([[0], np.cumsum(keep)])[offsets]
    folded = folded[keep]
    size, shift = len(folded), np.uint32(32 - dims.bit_length() + 1)
    bins, h = [], np.zeros(size, np.uint32)
    for n in range(1, longest + 1):
        h = h * np.uint32(0x01000193) + np.append(folded[n - 1 :], np.zeros(min(n - 1, size), np.uint32))
        b = (((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift).astype(np.int64)
        for back in range(1, n):
            last = base[1:] - back
            b[last[last >= base[:-1]]] = dims
        bins.append(b)
    return bins, base, letters


ROWS = 128


def bin_counts(texts, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts x bins: how often each bin occurs; and letters per text. ``dims`` is a power of 2."""
    bins, base, letters = grams(texts, dims)
    row = np.repeat(np.arange(texts.n) * (dims + 1), np.diff(base))
    out = np.zeros(texts.n * (dims + 1), np.int64)
    for b in bins:
        out += np.bincount(row + b, minlength=len(out))
    return out.reshape(texts.n, dims + 1)[:, :dims], letters


def document_frequencies(docs: DataFrame, dims: int, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents, and how many hold each bin. At most ``dims`` counts per task and at the driver."""

    def count(batches):
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for a, b, texts in slices(batch.column(0), 1 << 19, ROWS):
                bins, base, _ = grams(texts, dims)
                row = np.repeat(np.arange(texts.n) * (dims + 1), np.diff(base))
                held = np.zeros(texts.n * (dims + 1), bool)
                for x in bins:
                    held[row + x] = True
                total += held.reshape(texts.n, dims + 1)[:, :dims].sum(0)
                n += b - a
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["bin", "n"])

    out, seen = np.zeros(dims, np.int64), 0
    for r in docs.select(text).mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        if r.bin < 0:
            seen = r.n
        else:
            out[r.bin] = r.n
    return seen, out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bins x languages: idf x weight
    bias: np.ndarray
    temperature: float
    dims: int

    def scores(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, before calibration, and its letters."""
        counts, letters = bin_counts(texts, self.dims)
        return (counts.astype(np.float32) @ self.table) / np.maximum(counts.sum(1), 1)[:, None] + self.bias, letters

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return softmax(logits / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


SCALE = 30.0


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int, classes: int, *, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (dims x classes) and bias by follow-the-regularised-leader; most weights stay exactly 0."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, dims), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = softmax((x @ w)[None])[0]
            g[labels[i]] -= 1
            g = np.outer(x, g)
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - s * w
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:dims], w[dims]


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        top = z.max(1)
        return (top + np.log(np.exp(z - top[:, None]).sum(1)) - z[np.arange(len(labels)), labels]).mean()

    a, b, g = np.log(0.05), np.log(200.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, *, dims: int = 1 << 14, per_class: int = 800, fit_rows: int = 16_000, text: str = "text", lang: str = "lang", seed: int = 11) -> Model | None:
    """Learns from the rows of docs whose lang is not null.

    Of each language at most ``per_class`` different texts are drawn, and no more than its share of ``fit_rows`` (one, if there
    are more languages than that): half of them to fit on, half to calibrate.
    """
    known = docs.where(F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    seen, df = document_frequencies(known, dims, text)
    idf = np.log((1 + seen) / (1 + df)) + 1

    most = max(1, min(per_class, fit_rows // len(langs)))
    share = F.lit(0.0)
    for name in langs:
        share = F.when(F.col(lang) == name, F.lit(min(1.0, (2 * most + 100) / sizes[name]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    def featurise(batches):
        for batch in batches:
            for a, b, texts in slices(batch.column(1), 1 << 19, ROWS):
                counts, _ = bin_counts(texts, dims)
                at = [np.flatnonzero(c).astype(np.int32) for c in counts]
                value = [(c[i] / max(1, c.sum())).astype(np.float32) for c, i in zip(counts, at, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["lang", "at", "value"])

    near = known.select(F.col(lang).alias("lang"), F.coalesce(text, F.lit("")).alias("text"), draw.alias("draw")).where(F.col("draw") < share).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    sample = near.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "text")
    drawn = sample.mapInArrow(featurise, "lang string, at array<int>, value array<float>").toArrow()
    number = {name: k for k, name in enumerate(langs)}
    labels = np.array([number[x] for x in drawn.column("lang").to_pylist()], np.int64)
    lists = drawn.column("at").combine_chunks()
    bounds = lists.offsets.to_numpy()
    at, value = lists.values.to_numpy().astype(np.int64), drawn.column("value").combine_chunks().values.to_numpy()
    rows = [(at[a:b], value[a:b] * idf[at[a:b]] * SCALE) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    # One order whatever the partitions were.
    order = sorted(range(len(rows)), key=lambda i: (labels[i], len(rows[i][0]), rows[i][0].tobytes(), rows[i][1].tobytes()))
    rows, labels = [rows[i] for i in order], labels[order]
    turn = np.arange(len(rows)) - np.searchsorted(labels, labels)  # of each language, every other text
    here, there = np.flatnonzero(turn % 2 == 0), np.flatnonzero(turn % 2 == 1)
    weights, bias = ftrl([rows[i] for i in here], labels[here], dims, len(langs), seed=seed)
    logits = np.array([v @ weights[a] + bias for a, v in (rows[i] for i in there)]).reshape(-1, len(langs))
    return Model(langs, (weights * idf[:, None] * SCALE).astype(np.float32), bias, calibrate(logits, labels[there]), dims)


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the calibrated probability) of every row."""

    def run(batches):
        for batch in batches:
            for a, b, texts in slices(batch.column(1), 1 << 19, ROWS):
                if model is None:
                    names, best = ["und"] * texts.n, np.zeros(texts.n)
                else:
                    logits, letters = model.scores(texts)
                    p = model.probabilities(logits)
                    top = p.argmax(1)
                    names = [model.langs[k] if n else "und" for k, n in zip(top, letters, strict=True)]
                    best = np.where(letters > 0, p[np.arange(texts.n), top], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(best)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_ngram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
