"""Quality classifier: a generalised additive model with pairwise interactions.

One pass turns each whole text into a few dense features. On a bounded sample of labelled documents
(at most ``fit_rows``, drawn by a hash of doc_id), cyclic boosting visits the features in turn and fits a shallow tree over
one feature's bins to the gradient of the log loss each time; the trees of a feature add up to one look-up
table. Then the feature pairs with the largest remaining interaction get two-dimensional tables in
the same way. A score is the logistic function of the sum of the looked-up values, for all rows at once.

Defined results: null counts as empty; empty texts get a score like any other (their features are 0); very long texts
are read whole; rows without a label, or with a null one, are scored but not learned from; repeated rows are scored
each on its own, but a document is learned from once, with each label it has; a score on a cut between two bins belongs to
the upper one, and of splits of equal gain the first is taken; other columns are ignored; an empty table gives no rows.
Without labels of both kinds the score is the share of label 1 among them (0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import base_counts, char_histograms
from ..storage import materialize, spread
from .samples import labelled, least_drawn, texts_of
from .text import Words, lines, repeated, slices, sums

FEATURES = ["log_chars", "log_words", "word_length", "upper", "digits", "symbols", "marks", "punctuation", "pipes", "dup_lines", "repeat_words", "same_next", "distinct_words", "line_length", "beyond_ascii", "spaces", "ends_bare"]


def dense_features(texts) -> np.ndarray:
    """Texts x FEATURES; all 0 for an empty text."""
    base, chars = base_counts(texts), char_histograms(texts).astype(float)
    words = Words(texts)
    h = words.hashes()
    n_chars, n_words = chars.sum(1), words.per_doc.astype(float)
    per_char, per_word = np.maximum(n_chars, 1), np.maximum(n_words, 1)
    letters = np.maximum(chars[:, [0, 1, 9, 10]].sum(1), 1)
    same = np.zeros(texts.n)
    if words.n > 1:
        hit = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
        same = np.bincount(words.doc[1:][hit], minlength=texts.n)
    _, later = repeated(h, words.doc)
    again = np.bincount(words.doc[later], minlength=texts.n)
    start, _, doc = lines(texts)
    n_lines = np.maximum(np.bincount(doc, minlength=texts.n), 1)
    last = texts.data[words.end - 1] if words.n else np.zeros(0, np.uint8)
    bare = np.bincount(words.doc[(last >= 97) & (last <= 122) | (last >= 128)], minlength=texts.n)
    out = [np.log1p(n_chars), np.log1p(n_words), base["word_chars"] / per_word, chars[:, 1] / letters, chars[:, 2] / per_char, base["n_symbols"] / per_char, chars[:, 6] / per_char, chars[:, 5] / per_char, sums(texts.data == 0x7C, texts.offsets) / per_char, base["n_dup_lines"] / n_lines, base["n_repeat_words"] / per_word, same / per_word, np.where(n_words > 0, 1 - again / per_word, 0), np.where(n_chars > 0, np.log1p(n_chars / n_lines), 0), chars[:, [9, 10, 11]].sum(1) / per_char, chars[:, [3, 4]].sum(1) / per_char, bare / per_word]
    return np.stack(out, 1).astype(np.float32)


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the features of every row, as an array."""

    def run(batches):
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                x = dense_features(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, x array<float>")


def edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values nearest to the quantiles."""
    u = np.unique(x)
    if len(u) <= 1:
        return np.zeros(0)
    if len(u) <= bins:
        return (u[1:] + u[:-1]) / 2
    q = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    return q[(q > u[0])]


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A step function over ordered bins: the split of largest gain again and again, until there are ``leaves`` parts."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        m = np.arange(a + 1, b)
        left, right = (cg[m] - cg[a], ch[m] - ch[a]), (cg[b] - cg[m], ch[b] - ch[m])
        gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
        k = int(gain.argmax())
        return float(gain[k]), int(m[k])

    found = [best(*parts[0])]
    while len(parts) < leaves and max(f[0] for f in found) > 1e-9:
        k = max(range(len(parts)), key=lambda i: found[i][0])
        (a, b), m = parts[k], found[k][1]
        parts[k : k + 1], found[k : k + 1] = [(a, m), (m, b)], [best(a, m), best(m, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def shallow_tree_2d(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Over a grid of bins: one split along either axis, then one along the other axis on each side."""
    best, out = -1.0, np.zeros_like(g)
    for turned in (False, True):
        G, H = (g.T, h.T) if turned else (g, h)
        for m in range(1, G.shape[0]):
            rows = [shallow_tree(G[s].sum(0), H[s].sum(0), 2, ridge) for s in (slice(0, m), slice(m, None))]
            grid = np.concatenate([np.tile(rows[0], (m, 1)), np.tile(rows[1], (G.shape[0] - m, 1))])
            gain = float((2 * grid * G - grid**2 * (H + ridge / G.size)).sum())
            if gain > best:
                best, out = gain, grid.T if turned else grid
    return out


@dataclass
class Additive:
    """bias + table of each feature's bin + table of each pair's two coarse bins."""

    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: dict[int, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cuts, x[:, j], side="right")]
        for (j, k), table in self.pairs.items():
            z += table[np.searchsorted(self.coarse[j], x[:, j], side="right"), np.searchsorted(self.coarse[k], x[:, k], side="right")]
        return 1 / (1 + np.exp(-z))


def fit_additive(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, bins: int = 32, coarse_bins: int = 8, cycles: int = 60, pair_cycles: int = 20, n_pairs: int = 4, rate: float = 0.2, leaves: int = 4, ridge: float = 1.0) -> Additive:
    weight = np.ones(len(y)) if weight is None else weight
    share = float((y * weight).sum() / weight.sum()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Additive(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    m = x.shape[1]
    out = Additive(float(np.log(share / (1 - share))), [edges(x[:, j], bins) for j in range(m)])
    bin_of = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(out.cuts)]
    out.tables = [np.zeros(len(c) + 1) for c in out.cuts]
    z = np.full(len(y), out.bias)

    def gradient():
        p = 1 / (1 + np.exp(-z))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(cycles):
        for j in range(m):
            size = len(out.tables[j])
            if size < 2:
                continue
            g, h = gradient()
            step = rate * shallow_tree(np.bincount(bin_of[j], g, size), np.bincount(bin_of[j], h, size), leaves, ridge)
            out.tables[j] += step
            z += step[bin_of[j]]
    cuts = {j: edges(x[:, j], coarse_bins) for j in range(m)}
    at = {j: np.searchsorted(c, x[:, j], side="right") for j, c in cuts.items()}

    def grid(j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(cuts[j]) + 1, len(cuts[k]) + 1)
        cell = at[j] * shape[1] + at[k]
        g, h = gradient()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    gains = {}
    for j, k in combinations([j for j in range(m) if len(cuts[j])], 2):
        g, h = grid(j, k)
        gains[j, k] = float((g**2 / (h + ridge)).sum() - (g.sum(1) ** 2 / (h.sum(1) + ridge)).sum() - (g.sum(0) ** 2 / (h.sum(0) + ridge)).sum())
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    out.pairs = {(j, k): np.zeros((len(cuts[j]) + 1, len(cuts[k]) + 1)) for j, k in chosen}
    out.coarse = {j: cuts[j] for p in chosen for j in p}
    for _ in range(pair_cycles):
        for j, k in chosen:
            step = rate * shallow_tree_2d(*grid(j, k), ridge)
            out.pairs[j, k] += step
            z += step[at[j], at[k]]
    return out


def _drawn(labels: DataFrame, label: str, doc_id: str, fit_rows: int, seed: int) -> DataFrame:
    known = labelled(labels, label, doc_id)
    return least_drawn(known, known.count(), fit_rows, seed).select("doc_id", "y")


def _fit(rows: DataFrame) -> Additive:
    """Fits on the rows (doc_id, y, x), in an order of their own."""
    table = rows.select("doc_id", "y", "x").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)).astype(float) if table.num_rows else np.zeros((0, len(FEATURES)))
    y = table.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y, table.column("doc_id").to_numpy()))
    return fit_additive(x[order], y[order])


def fit(feats: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", fit_rows: int = 20_000, seed: int = 5) -> Additive:
    """Fits on at most ``fit_rows`` documents of feats that have a label, each once; the driver gets their features only."""
    drawn = F.broadcast(_drawn(labels, label, doc_id, fit_rows, seed))
    return _fit(feats.join(drawn, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")))


def fit_on_sample(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", fit_rows: int = 20_000, seed: int = 5) -> Additive:
    """The same from texts, of which only the drawn ones are turned into features; of rows that share a doc_id, the least text counts."""
    drawn = materialize(_drawn(labels, label, doc_id, fit_rows, seed))
    chosen = features(texts_of(docs, drawn.select("doc_id").distinct(), doc_id, text))
    return _fit(chosen.join(F.broadcast(drawn), "doc_id"))


def score(feats: DataFrame, model: Additive) -> DataFrame:
    """doc_id, score, predicted of every row of feats."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)).astype(float)
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return feats.mapInArrow(run, "doc_id bigint, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores of every row of docs, by a model learned from the labels; reads the texts once."""
    feats = materialize(features(docs))
    return score(feats, fit(feats, labels, **options))


def op3_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    scored = classify(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
