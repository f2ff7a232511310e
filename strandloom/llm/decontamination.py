"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, marks and digits (by Unicode classes) after full case folding; whatever else stands between
them does not count. Documents and benchmark items that share a seed (``shortest`` consecutive words) are
joined by the seeds; then the longest match of words that are not marked yet is found by running Karp-Rabin hashes,
compared word by word, marked on both sides, and again, until no match of ``shortest`` words is left. Tiles may lie in
any order, so passages with their sentences moved about are caught. A document is contaminated by an item when the
tiles cover at least ``coverage`` of the item's words.

1. The items' seeds are written, and set in a Bloom filter of bounded size, the only thing sent to all tasks.
2. One pass over the documents leaves of each the words of runs that the filter lets through, its fragment.
   Tiles lie within fragments. Most documents have none; equal fragments, as of one passage in very many
   documents, are one row from here on.
3. Fragments meet items by an equi-join on seeds. To cover its share, an item must have some number of seeds in the document,
   so the most frequent ones, one less than that, are left out of the join without losing a pair.
4. Every pair is tiled, on the words themselves.

Neither the benchmark nor the documents pass through the driver. Defined results: null texts count as
empty; empty documents and items without a word never match; very long texts are searched whole; an item shorter than
``shortest`` words must occur whole; items with equal words match alike, each with a row of its own; of matches of equal
length, the first in the item and then in the document is marked first; repeated document rows give repeated result
rows; empty tables give no match; other columns are ignored (``decontaminate`` keeps them, whatever their names).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..storage import materialize, spread
from . import bloom
from .text import give_back, members, mix, powers, slices, windows

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache(1)
def _points() -> tuple[np.ndarray, np.ndarray]:
    """Of code points: are they part of a word, and a hash value of each."""
    return members(r"[\p{L}\p{M}\p{N}]"), mix(np.arange(1, 0x110001, dtype=np.uint64))


class Words:
    """The folded words of texts: start and end in ``text``, text number, 64-bit hash."""

    def __init__(self, texts: list[str | None]):
        folded = [(t or "").casefold() for t in texts]
        self.text = "".join(folded)
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *map(len, folded)])
        word, value = _points()
        inside, first = word[points], np.zeros(len(points), bool)
        first[bounds[:-1][bounds[:-1] < len(points)]] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:]
        ends[:-1] &= ~inside[1:] | first[1:]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1
        self.hashes = np.zeros(0, np.uint64)
        if len(self.start):
            size = self.end - self.start
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            self.hashes = mix(np.add.reduceat(value[points[inside]] * powers(int(size.max()))[at], np.cumsum(size) - size) + size.astype(np.uint64))

    def seeds(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words of a text, and the number of each one's first word."""
        h, at = windows(self.hashes, self.doc, k)
        return mix(h + np.uint64(k)), at

    def joined(self, a: int, b: int) -> str:
        """Words a to b - 1, with blanks between them."""
        return " ".join([self.text[i:j] for i, j in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)])


def _running(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of words[i] * base^i modulo 2^64, and base^-i: a run's hash is the difference of two sums, moved to place 0."""
    n = len(words)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(mix(words) * up[:n], dtype=np.uint64)]), down


def _grams(running: tuple[np.ndarray, np.ndarray], marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the runs of ``size`` words without a mark."""
    sums, down = running
    if len(sums) <= size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(marks)])
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return (sums[at + size] - sums[at]) * down[at], at


def tiles(pattern: np.ndarray, text: np.ndarray, shortest: int, broken: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, words) of the tiles, longest first; ``broken`` marks words of text that none may hold.

    Words are numbers; runs of equal hash are compared before they are marked.
    """
    in_pattern = np.zeros(len(pattern), bool)
    in_text = np.zeros(len(text), bool) if broken is None else broken.copy()
    run_p, run_t = _running(pattern), _running(text)
    out: list[tuple[int, int, int]] = []

    def common(size: int):
        hp, ap = _grams(run_p, in_pattern, size)
        ht, at = _grams(run_t, in_text, size)
        keep = np.isin(hp, ht)
        return hp[keep], ap[keep], ht, at

    high = min(len(pattern), len(text))
    while high >= shortest:
        low, best = shortest, None
        while low <= high:  # a common run of some length holds shorter ones: halve
            mid = (low + high + 1) // 2
            found = common(mid)
            if len(found[0]):
                best, low = (mid, found), mid + 1
            else:
                high = mid - 1
        if best is None:
            break
        size, (hp, ap, ht, at) = best
        order = np.argsort(ht, kind="stable")
        ht, at = ht[order], at[order]
        low, stop = np.searchsorted(ht, hp, "left"), np.searchsorted(ht, hp, "right")
        before = len(out)
        for p, a, b in zip(ap.tolist(), low.tolist(), stop.tolist(), strict=True):
            if in_pattern[p : p + size].any():
                continue
            for t in at[a:b].tolist():
                if not in_text[t : t + size].any() and (pattern[p : p + size] == text[t : t + size]).all():
                    in_pattern[p : p + size] = in_text[t : t + size] = True
                    out.append((p, t, size))
                    break
        high = size if len(out) > before else size - 1
    return out


def tile_pair(item: str, fragment: str, shortest: int, coverage: float) -> tuple[float, int, int] | None:
    """Coverage, tiles and words in tiles of a contaminating item, from blank-separated words; a line break parts runs."""
    number: dict[str, int] = {}
    pattern = np.array([number.setdefault(w, len(number) + 1) for w in item.split(" ")], np.uint64)
    text = np.array([number.get(w, 0) for w in fragment.replace("\n", " \n ").split(" ")], np.uint64)
    found = tiles(pattern, text, min(shortest, len(pattern)), text == 0)
    total = sum(s for *_, s in found)
    return (total / len(pattern), len(found), total) if total >= coverage * len(pattern) else None


def _contents(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, words, n (words of it), content (a digest of them) of items with a word."""

    def run(batches):
        for batch in batches:
            for a, b, _ in slices(batch.column(1)):
                words = Words(batch.column(1).slice(a, b - a).to_pylist())
                bounds = np.searchsorted(words.doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([words.joined(i, j) for i, j in pairwise(bounds.tolist())], pa.string()), pa.array(np.diff(bounds), pa.int32())], ["item_id", "words", "n"])

    rows = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text")).mapInArrow(run, "item_id bigint, words string, n int")
    return materialize(rows.where("n > 0").withColumn("content", F.md5("words")))


def _item_seeds(contents: DataFrame, shortest: int) -> DataFrame:
    """content, n, k, pos, seed of all seeds of every content."""

    def run(batches):
        for batch in batches:
            for a, b, _ in slices(batch.column(1)):
                words = Words(batch.column(1).slice(a, b - a).to_pylist())
                k_of = np.minimum(shortest, np.bincount(words.doc, minlength=b - a))
                for k in np.unique(k_of).tolist():
                    h, at = words.seeds(k)
                    h, at = h[k_of[words.doc[at]] == k], at[k_of[words.doc[at]] == k]
                    owner, first = words.doc[at], np.searchsorted(words.doc, words.doc[at])
                    own = batch.column(0).slice(a, b - a).take(pa.array(owner))
                    n = batch.column(2).slice(a, b - a).take(pa.array(owner))
                    yield pa.RecordBatch.from_arrays([own, n, pa.array(np.full(len(h), k), pa.int32()), pa.array(at - first, pa.int32()), pa.array(h.view(np.int64))], ["content", "n", "k", "pos", "seed"])

    one = contents.groupBy("content").agg(F.first("words").alias("words"), F.first("n").alias("n"))
    return materialize(one.mapInArrow(run, "content string, n int, k int, pos int, seed bigint"))


def _fragments(texts: list[str | None], lengths: list[int], table: np.ndarray) -> list[str | None]:
    """Of each text, the words of the runs that the filter lets through: blanks between words, line breaks between runs; null without one."""
    words = Words(texts)
    edge = np.zeros(len(words.start) + 1, np.int64)
    for k in lengths:
        h, at = words.seeds(k)
        hit = at[bloom.inside(h, table)]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + k, -1)
    covered = np.cumsum(edge[:-1]) > 0
    out: list[str | None] = [None] * len(texts)
    if covered.any():
        head, tail = covered.copy(), covered.copy()
        same = words.doc[1:] == words.doc[:-1]
        head[1:] &= ~(covered[:-1] & same)
        tail[:-1] &= ~(covered[1:] & same)
        runs: dict[int, list[str]] = {}
        for a, b in zip(np.flatnonzero(head).tolist(), (np.flatnonzero(tail) + 1).tolist(), strict=True):
            runs.setdefault(int(words.doc[a]), []).append(words.joined(a, b))
        for d, found in runs.items():
            out[d] = "\n".join(found)
    return out


class Index:
    """The benchmark, ready to be joined: contents and their items, seeds, the filter and the seeds' lengths."""

    def __init__(self, benchmark: DataFrame, shortest: int, coverage: float, item_id: str = "item_id", text: str = "text"):
        self.shortest, self.coverage = shortest, coverage
        self.contents = _contents(benchmark, item_id, text)
        self.seeds = _item_seeds(self.contents, shortest)
        self.lengths = sorted(r.k for r in self.seeds.select("k").distinct().collect())  # at most ``shortest``
        self.table = benchmark.sparkSession.sparkContext.broadcast(bloom.built(self.seeds.select("seed")))

    def marked(self, docs: DataFrame, text: str) -> tuple[DataFrame, str]:
        """The rows of docs with their fragment (null without one) in a further column, and that column's name."""
        at, lengths, table = docs.columns.index(text), self.lengths, self.table
        name = "_fragment"
        while name in docs.columns:
            name += "_"

        def run(batches):
            for batch in batches:
                for a, b, _ in slices(batch.column(at)):
                    part = batch.slice(a, b - a)
                    found = pa.array(_fragments(part.column(at).to_pylist(), lengths, table.value), pa.string())
                    yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, name])
            give_back()

        return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType())])), name

    def matched(self, fragments: DataFrame) -> DataFrame:
        """key, content, coverage, n_tiles, matched_words of the contaminated ones of fragments (key, fragment), which are distinct."""
        shortest, coverage, lengths, table = self.shortest, self.coverage, self.lengths, self.table

        def seeds_of(batches):
            for batch in batches:
                for a, b, _ in slices(batch.column(1)):
                    # A line break must part runs: each run is a text of its own here.
                    runs = [(i, r) for i, f in enumerate(batch.column(1).slice(a, b - a).to_pylist()) for r in f.split("\n")]
                    words, owner = Words([r for _, r in runs]), np.array([i for i, _ in runs], np.int64)
                    for k in lengths:
                        h, at = words.seeds(k)
                        ok = bloom.inside(h, table.value)
                        pair = np.unique(np.stack([owner[words.doc[at[ok]]].astype(np.uint64), h[ok]]), axis=1)
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(pair[0].astype(np.int64))), pa.array(pair[1].view(np.int64))], ["key", "seed"])

        often = self.seeds.groupBy("seed").agg(F.count("*").alias("often"))
        rank = F.row_number().over(Window.partitionBy("content").orderBy(F.desc("often"), "pos"))
        needed = F.ceil(F.col("n") * coverage / F.col("k"))  # a tile of k words or more has a seed for every k of them
        index = self.seeds.join(often, "seed").withColumn("rank", rank).where(F.col("rank") >= needed).select("content", "seed").distinct()
        pairs = fragments.mapInArrow(seeds_of, "key string, seed bigint").join(index, "seed").select("key", "content").distinct()
        one = self.contents.groupBy("content").agg(F.first("words").alias("words"))
        both = pairs.join(fragments, "key").join(one, "content").select("key", "content", "fragment", "words")

        def tile(batches):
            for batch in batches:
                rows = [tile_pair(w, f, shortest, coverage) for f, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                keep = pa.array([i for i, r in enumerate(rows) if r], pa.int64())
                share, n, total = zip(*[r for r in rows if r], strict=True) if len(keep) else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(share, pa.float64()), pa.array(n, pa.int32()), pa.array(total, pa.int32())], ["key", "content", "coverage", "n_tiles", "matched_words"])

        return materialize(both.mapInArrow(tile, "key string, content string, coverage double, n_tiles int, matched_words int"))


def _distinct(suspects: DataFrame, fragment: Column) -> DataFrame:
    return materialize(suspects.select(F.md5(fragment).alias("key"), fragment.alias("fragment")).groupBy("key").agg(F.first("fragment").alias("fragment")))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, shortest: int = 5, coverage: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, matched_words: a row for each document and item that contaminates it."""
    index = Index(benchmark, shortest, coverage)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    marked, name = index.marked(rows, "text")
    suspects = materialize(marked.where(F.col(name).isNotNull()).select("doc_id", F.col(name).alias("fragment"), F.md5(name).alias("key")))
    found = index.matched(_distinct(suspects, F.col("fragment"))).join(index.contents.select("content", "item_id"), "content")
    return suspects.select("doc_id", "key").join(found, "key").select("doc_id", "item_id", "coverage", "n_tiles", "matched_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, shortest: int = 5, coverage: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns; only rows with a fragment are shuffled.

    Texts are cut into words once: rows are written with their fragments before these are looked at.
    """
    index = Index(benchmark, shortest, coverage)
    marked, name = index.marked(docs, text)
    rows = materialize(marked)
    some = rows.where(F.col(name).isNotNull())
    bad = index.matched(_distinct(some, F.col(name))).select("key").distinct()
    return rows.where(F.col(name).isNull()).unionByName(some.join(bad, F.md5(some[name]) == bad["key"], "left_anti")).drop(name)


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contaminated documents, with the items they hold."""
    return contaminated(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
