"""Quality rules: base rules on words and lines, then divergence from language references.

A document's histogram over character classes and its histogram over the common words of its
language are compared with the language's own, by Jensen-Shannon distance (base 2, so 0 to 1).
References are counts over all documents of a language; nothing is sampled. The common words of
a language are those whose share of its words is at least ``common_share``. Mergeable summaries of bounded
size propose them (``common_words``), and a second pass counts the proposals everywhere (``references``), so
the shares are exact and what reaches the driver does not grow with the table.

Defined results: a null text counts as empty; an empty text has no words and fails the base
rules; a very long text is counted whole; a null or unknown language is judged against the nearest reference, of
equally near ones the one that sorts first; texts shorter than the minimum lengths are not judged by divergence; a
distance at its limit passes; repeated rows are judged each on its own; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import spread
from .text import Words, code_points, lines, repeated, slices, spans_hash, sums

N_CLASSES = 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _classes() -> np.ndarray:
    """ASCII code points to classes; 9: Latin letters beyond ASCII, 10: other letters and marks, 11: the rest above ASCII."""
    out = np.full(128, 8, np.uint8)
    out[[9, 10, 11, 12, 13]] = 4
    out[32] = 3
    out[48:58] = 2
    out[65:91] = 1
    out[97:123] = 0
    for c in ".,;:'\"-()":
        out[ord(c)] = 5
    for c in "!?":
        out[ord(c)] = 6
    for c in "#*$%&|<>":
        out[ord(c)] = 7
    return out


_ASCII = _classes()


def char_histograms(texts) -> np.ndarray:
    """Counts of the character classes of each text."""
    points, offsets = code_points(texts)
    kind = np.where(points < 128, _ASCII[np.minimum(points, 127)], np.where(points < 0x250, 9, np.where(points < 0x2000, 10, 11))).astype(np.int64)
    doc = np.repeat(np.arange(texts.n), np.diff(offsets))
    return np.bincount(doc * N_CLASSES + kind, minlength=texts.n * N_CLASSES).reshape(texts.n, N_CLASSES)


BASE_SCHEMA = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def base_counts(texts) -> dict[str, np.ndarray]:
    """Counts of the base rules, per text."""
    words = Words(texts)
    lead = (texts.data & 0xC0) != 0x80
    out = {"n_words": words.per_doc, "word_chars": sums(lead & words.inside, texts.offsets), "n_symbols": sums(_SYMBOL[texts.data], texts.offsets)}
    start, end, doc = lines(texts)
    if len(start):
        spoken = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
        start, end, doc = start[spoken], end[spoken], doc[spoken]
    out["n_dup_lines"] = np.bincount(doc[repeated(spans_hash(texts.data, start, end), doc)[1]], minlength=texts.n) if len(start) else np.zeros(texts.n, np.int64)
    hashes = words.hashes()
    grams, at = words.shingles(5, hashes)
    twice, _ = repeated(grams, words.doc[at])
    edge = np.zeros(words.n + 1, np.int64)
    hit = at[twice]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 5, -1)
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(edge[:-1]) > 0], minlength=texts.n)
    return out


def _word_hashes(texts) -> tuple[Words, np.ndarray]:
    """Words with ASCII letters folded and outer punctuation kept: hashes as signed 64-bit integers."""
    words = Words(texts, _LOWER)
    return words, words.hashes().view(np.int64)


def _heavy(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """One Misra-Gries step: equal keys summed; beyond ``most`` keys, the next largest count is taken from all and what is left stays."""
    u, inverse = np.unique(keys, return_inverse=True)
    n = np.bincount(inverse, counts, len(u)).astype(np.int64)
    if len(u) > most:
        n -= np.partition(n, -most - 1)[-most - 1]
        u, n = u[n > 0], n[n > 0]
    return u, n


def common_words(docs: DataFrame, common_share: float, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word): hashes of at most 2 / common_share words per language, among them all with that share of its words.

    Each task keeps a Misra-Gries summary per language. Summaries are merged by summing them and keeping
    the largest; a word with a share above 1 / (size + 1) is never lost on the way.
    """
    most = int(np.ceil(2 / common_share))

    def propose(batches):
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b, texts in slices(batch.column(0)):
                words, h = _word_hashes(texts)
                codes, names = _codes(langs[a:b])
                for k, name in enumerate(names):
                    u, n = np.unique(h[codes[words.doc] == k], return_counts=True)
                    known, counts = found.get(name, (u[:0], n[:0]))
                    found[name] = _heavy(np.concatenate([known, u]), np.concatenate([counts, n]), most)
        names = [k for k, (u, _) in found.items() for _ in u]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *(u for u, _ in found.values())])), pa.array(np.concatenate([np.zeros(0, np.int64), *(n for _, n in found.values())]).astype(np.int64))], ["lang", "word", "n"])

    spoken = docs.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    summed = spoken.mapInArrow(propose, "lang string, word bigint, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return summed.withColumn("_rank", rank).where(F.col("_rank") <= most).select("lang", "word")


def _codes(values: np.ndarray) -> tuple[np.ndarray, list]:
    names = sorted({v for v in values if v is not None})
    number = {v: k for k, v in enumerate(names)}
    return np.array([number.get(v, -1) for v in values], np.int64), names


def references(docs: DataFrame, common_share: float = 0.01, text: str = "text", lang: str = "lang") -> dict[str, dict]:
    """lang -> {"chars": shares of classes, "words": hashes, "shares": their shares, the last being all other words}.

    What reaches the driver is bounded: per language, N_CLASSES counts and at most the proposed words.
    """
    proposed: dict[str, list] = {}
    for r in common_words(docs, common_share, text, lang).collect():
        proposed.setdefault(r.lang, []).append(r.word)
    table = {k: np.sort(np.array(v, np.int64)) for k, v in proposed.items()}

    def count(batches):
        total: dict[tuple, int] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b, texts in slices(batch.column(0)):
                chars = char_histograms(texts)
                words, h = _word_hashes(texts)
                codes, names = _codes(langs[a:b])
                for k, name in enumerate(names):
                    for c, n in enumerate(chars[codes == k].sum(0)):
                        total[name, "c", c] = total.get((name, "c", c), 0) + int(n)
                    mine, known = h[codes[words.doc] == k], table.get(name, np.zeros(0, np.int64))
                    counts = _bins(mine, known)
                    for w, n in enumerate(np.bincount(counts, minlength=len(known) + 1)):
                        total[name, "w", w] = total.get((name, "w", w), 0) + int(n)
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.int64())], ["lang", "kind", "bin", "n"])

    counted = docs.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang)).mapInArrow(count, "lang string, kind string, bin bigint, n bigint").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")).collect()
    out: dict[str, dict] = {}
    for name in {r.lang for r in counted}:
        known = table.get(name, np.zeros(0, np.int64))
        chars, spoken = np.zeros(N_CLASSES), np.zeros(len(known) + 1)
        for r in counted:
            if r.lang == name:
                (chars if r.kind == "c" else spoken)[r.bin] = r.n
        common = spoken[:-1] >= common_share * max(1, spoken.sum())
        rest = spoken.sum() - spoken[:-1][common].sum()
        out[name] = {"chars": chars / max(1, chars.sum()), "words": known[common], "shares": np.append(spoken[:-1][common], rest) / max(1, spoken.sum())}
    return out


def _bins(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each hash among the sorted known ones; their number for others."""
    if not len(known):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known))


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) of each row's shares from the reference; 0 for empty rows."""
    total = counts.sum(1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) / 2 + np.where(reference > 0, reference * np.log2(reference / m), 0).sum(1) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(d, 0)), 0.0)


RULES_SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame, refs: dict[str, dict], *, max_char: float = 0.28, max_word: float = 0.40, min_chars: int = 120, min_words: int = 40, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts, distances and verdict of each document; one pass without a shuffle."""
    names = sorted(refs)

    def run(batches):
        for batch in batches:
            ids, langs = batch.column(0), np.array(batch.column(2).to_pylist(), object)
            for a, b, texts in slices(batch.column(1)):
                out = base_counts(texts)
                chars = char_histograms(texts)
                words, h = _word_hashes(texts)
                far_c, far_w = np.full((len(names), texts.n), np.inf), np.full((len(names), texts.n), np.inf)
                own = np.array([names.index(x) if x in refs else -1 for x in langs[a:b]], np.int64)
                for k, name in enumerate(names):
                    if not ((own == k) | (own < 0)).any():
                        continue
                    ref, size = refs[name], len(refs[name]["words"]) + 1
                    counts = np.bincount(words.doc * size + _bins(h, ref["words"]), minlength=texts.n * size).reshape(texts.n, size)
                    far_c[k], far_w[k] = js_distance(chars, ref["chars"]), js_distance(counts, ref["shares"])
                if names:
                    own = np.where(own < 0, np.argmin(far_c + far_w, 0), own)
                    dc, dw = far_c[own, np.arange(texts.n)], far_w[own, np.arange(texts.n)]
                else:
                    dc = dw = np.zeros(texts.n)
                failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
                strange = (chars.sum(1) >= min_chars) & (dc > max_char) | (out["n_words"] >= min_words) & (dw > max_word)
                columns = [out[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(failed), pa.array(~failed & ~strange), pa.array(dc), pa.array(dw)], [c.split()[0] for c in RULES_SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text), F.col(lang)).mapInArrow(run, RULES_SCHEMA)


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    judged = judge(docs, references(docs))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})
