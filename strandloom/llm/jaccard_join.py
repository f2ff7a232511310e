"""N-gram Jaccard join: all documents whose sets of word 5-grams have a Jaccard similarity of 0.8 or more.

1. ``sketches``: one pass gives each document a fingerprint of its set and ``HASHES`` MinHash values of 16 bits.
2. Documents with equal sets form one class; from here on, a class is one node, named by its least doc_id.
3. Classes that agree on a band of ``ROWS`` values are candidates. A large bucket is cut into blocks, and each
   pair of blocks is one group, so that no task holds a bucket.
4. Inside a group, candidates are pruned in the Bayesian way: MinHash values are compared ``STEP`` at a time, and a
   pair goes as soon as the posterior probability (uniform prior) that its similarity reaches the threshold
   falls below ``tolerance``. What leaves a group is a spanning forest of its surviving pairs, never the pairs; in a
   large group, a node is compared with nodes that no pair has joined yet, so that n near copies cost about n comparisons.
5. Components of the forests hold all pairs left to verify. A Bloom filter of their ids, of bounded size, goes to all tasks, so
   that no other text is turned into a set or shuffled. The set of each class, made once, meets the others of its
   component in blocks; pairs are pruned as before, and those that survive are verified exactly, on the sets themselves. What
   leaves is each node's number of linked documents and the least node it is linked to.

So no list of pairs is ever made. A group of n near copies costs n rows of output, n^2 / 2 comparisons of MinHash values
(``keep_one``, which needs no numbers of links, about n) and as many verifications as there are links. Its sets
are sent once for each of its blocks: about the root of twice the number of tasks, and n / WIDEST for more rows than that.
A pair at the threshold shares no band with probability (1 - 0.8^4)^20 = 3e-5, and is pruned wrongly with a probability of the order of
``tolerance``.

Defined results: words are runs of anything but ASCII white space, compared as they are; a text of one to
four words is one shingle; a null or empty text has no shingle and links to nothing (class_id is its doc_id); very long
texts are compared whole; a null doc_id is not compared (class_id null, n_links 0); rows that share a doc_id count as one
node; repeated rows are links of each other; ties in similarity do not arise, as every link counts; the
class is named by its least doc_id; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import materialize, release, spread
from . import bloom
from .text import Texts, Words, give_back, mix, repeated, slices

K, THRESHOLD = 5, 0.8
ROWS, BANDS, STEP = 4, 20, 16
HASHES = ROWS * BANDS
# Rows of a block: at most, and at least where a group has more; bytes of sets in a block, about.
WIDEST, NARROWEST, BLOCK_BYTES = 2048, 128, 16 << 20
# Rows up to which groups are compared side by side.
SIDE = 32
_MULTIPLY = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64))


def shingle_sets(texts: Texts, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text, and their offsets."""
    words = Words(texts)
    hashes = words.hashes()
    grams, at = words.shingles(k, hashes)
    doc = words.doc[at]
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < k))
    if len(short):
        first = np.searchsorted(words.doc, short)
        whole = np.array([int(np.bitwise_xor.reduce(mix(hashes[a : a + n] + np.arange(1, n + 1, dtype=np.uint64)))) for a, n in zip(first, words.per_doc[short], strict=True)], np.uint64)
        grams, doc = np.concatenate([grams, mix(whole)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        grams, doc = grams[order], doc[order]
    new = ~repeated(grams, doc)[1]
    grams, doc = grams[new], doc[new]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=texts.n))])


def _reduce(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ufunc over each span; spans must not be empty."""
    return ufunc.reduceat(values, offsets[:-1])


SKETCH = "doc_id bigint, tkey bigint, n int, key binary, sig binary"


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every row: a hash of its text, and size and 128-bit fingerprint of its set and its MinHash values (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(2), 1 << 20):
                grams, offsets = shingle_sets(texts)
                n = np.diff(offsets)
                some = np.flatnonzero(n)
                keys, sigs = np.full(texts.n, None, object), np.full(texts.n, None, object)
                if len(some):
                    bounds = np.append(offsets[some], offsets[-1])
                    one, two = _reduce(np.add, grams, bounds), _reduce(np.bitwise_xor, mix(grams + np.uint64(0x5851F42D4C957F2D)), bounds)
                    sig = np.empty((len(some), HASHES), np.uint16)
                    for i in range(HASHES):
                        # The least value picks a shingle; 16 mixed bits of it tell it from others.
                        sig[:, i] = mix(_reduce(np.minimum, grams * _MULTIPLY[i] + _ADD[i], bounds)).astype(np.uint16)
                    for j, r in enumerate(some):
                        keys[r], sigs[r] = one[j].tobytes() + two[j].tobytes(), sig[j].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n.astype(np.int32)), pa.array(keys.tolist(), pa.binary()), pa.array(sigs.tolist(), pa.binary())], [c.split()[0] for c in SKETCH.split(", ")])
        give_back()

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text")).mapInArrow(run, SKETCH)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of n equal MinHash values with which a pair may stay: P(similarity >= threshold) by a Beta posterior."""

    def reaches(m: int) -> float:
        return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return next(m for m in range(n + 1) if reaches(m) >= tolerance)


def _grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by their first ``columns`` columns."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        last = {c: table.column(c)[-1].as_py() for c in range(columns)}
        low, high = 0, table.num_rows - 1  # the first row of the last group
        while low < high:
            mid = (low + high) // 2
            same = all(table.column(c)[mid].as_py() == v for c, v in last.items())
            low, high = (low, mid) if same else (mid + 1, high)
        if low:
            yield table.slice(0, low).combine_chunks()
        rest = table.slice(low)
    if rest is not None:
        yield rest.combine_chunks()


def _groups(table: pa.Table, columns: int) -> np.ndarray:
    """Offsets of the groups."""
    new = np.zeros(table.num_rows + 1, bool)
    new[[0, -1]] = True
    for c in range(columns):
        v = table.column(c).to_numpy()
        new[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node (0 to n - 1) that each is connected to."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        before = low.copy()
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            break
    return low


def _steps(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(MinHash values compared, the fewest equal ones to stay)"""
    return [(n, least_matches(n, threshold, tolerance)) for n in range(STEP, HASHES + 1, STEP)]


def _pruned(sig: np.ndarray, a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) that stay after pruning."""
    matches = np.zeros(len(a), np.int64)
    for n, least in steps:
        matches += (sig[a, n - STEP : n] == sig[b, n - STEP : n]).sum(1)
        stay = matches >= least
        a, b, matches = a[stay], b[stay], matches[stay]
    return a, b


def surviving_pairs(group: np.ndarray, block: np.ndarray, mixed: np.ndarray, sig: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group (a < b) that stay after pruning; rows of mixed groups pair across blocks only. Groups are consecutive."""
    out_a, out_b = [], []
    size = np.bincount(group)
    place = np.arange(len(group)) - (np.cumsum(size) - size)[group]
    left = np.arange(len(group))
    for d in range(1, int(size.max(initial=0))):
        left = left[place[left] + d < size[group[left]]]
        a = left[~mixed[left] | (block[left] != block[left + d])]
        a, b = _pruned(sig, a, a + d, steps)
        out_a.append(a)
        out_b.append(b)
    return np.concatenate(out_a or [left[:0]]), np.concatenate(out_b or [left[:0]])


def joined(n: int, linked) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of n rows; ``linked(x, rows)`` are those of the rows that x has a pair with.

    Each row is held once against the rows that nothing has joined so far.
    """
    open_, out_a, out_b = np.arange(n), [], []
    while len(open_):
        todo, open_ = [int(open_[0])], open_[1:]
        while todo and len(open_):
            x = todo.pop()
            new = linked(x, open_)
            out_a.append(np.full(len(new), x))
            out_b.append(new)
            open_ = np.setdiff1d(open_, new, assume_unique=True)
            todo += new.tolist()
    return np.concatenate([*out_a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*out_b, np.zeros(0, np.int64)]).astype(np.int64)


def _n_blocks(spark: SparkSession, rows: Column, size: Column | None = None, widest: int = WIDEST, narrowest: int = NARROWEST) -> Column:
    """Into how many blocks a group goes: enough for all tasks to share its pairs of blocks, and none too large."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = F.least(F.ceil(rows / narrowest), F.lit(ceil(sqrt(2 * tasks))))
    bounds = [F.ceil(rows / widest), shared] + ([] if size is None else [F.ceil(size / BLOCK_BYTES)])
    return F.greatest(*bounds).cast("int")


def _blocked(members: DataFrame, blocks: str = "m") -> DataFrame:
    """Cuts groups into as many blocks as the column ``blocks`` says, by hash of ``rep``; each row goes to every pair of blocks that has its own.

    Adds i, j (i <= j: the pair of blocks) and block (the row's own).
    """
    cut = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    return cut.withColumn("_o", other).withColumns({"i": F.least("block", "_o"), "j": F.greatest("block", "_o")}).drop("_o")


def candidate_edges(classes: DataFrame, *, threshold: float = THRESHOLD, tolerance: float = 1e-5, widest: int = WIDEST, narrowest: int = 256) -> DataFrame:
    """(src, dst): spanning forests of the pairs of classes that survive pruning. classes: rep, sig."""
    steps = _steps(threshold, tolerance)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig))), pa.array(sig.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "bucket", "rep"])

    bands = classes.select("rep", "sig").mapInArrow(split, "band int, bucket bigint, rep bigint")
    blocks = _n_blocks(classes.sparkSession, F.col("n"), widest=widest, narrowest=narrowest)
    shared = materialize(bands.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("m", blocks))
    keyed = lambda some: bands.join(some, ["band", "bucket"]).join(classes.select("rep", "sig"), "rep")
    members = keyed(shared.where(F.col("n") <= widest).drop("n"))
    dealt = _blocked(members).select("band", "bucket", "i", "j", "block", "rep", "sig")
    sort = ["band", "bucket", "i", "j"]

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 4):
            bounds = _groups(table, 4)
            size = np.diff(bounds)
            i, j, block, rep = (table.column(c).to_numpy() for c in ("i", "j", "block", "rep"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            small = np.flatnonzero(np.repeat(size <= SIDE, size))
            group = np.repeat(np.arange(int((size <= SIDE).sum())), size[size <= SIDE])
            a, b = surviving_pairs(group, block[small], (i != j)[small], sig[small], steps)
            a, b = [small[a]], [small[b]]
            for k in np.flatnonzero(size > SIDE):
                own = sig[bounds[k] : bounds[k + 1]]
                x, y = joined(int(size[k]), lambda x, rows, own=own: _pruned(own, np.full(len(rows), x), rows, steps)[1])
                a.append(x + bounds[k])
                b.append(y + bounds[k])
            nodes, at = np.unique(rep, return_inverse=True)  # groups that share a node are joined here already
            low = _forest(len(nodes), at[np.concatenate(a)], at[np.concatenate(b)])
            hit = np.flatnonzero(low != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(nodes[low[hit]])], ["src", "dst"])

    out = dealt.repartition(*sort).sortWithinPartitions(*sort).mapInArrow(prune, "src bigint, dst bigint")
    large = materialize(shared.where(F.col("n") > widest).select("band", "bucket"))  # few: found without a shuffle of all bands
    if large.isEmpty():
        return out

    def linked(sets: Sets, x: int, other: Sets) -> np.ndarray:
        return _near(sets, x, other, steps)

    return out.unionByName(pivot_edges(materialize(keyed(large)), ["band", "bucket"], linked, widest=widest).select("src", "dst"))


@dataclass
class Sets:
    """Members of a group: ids, MinHash values, and (where there are any) their sets."""

    rep: np.ndarray
    sig: np.ndarray
    grams: list[np.ndarray] | None

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch) -> Sets:
        column = lambda c: table.column(c).to_pylist()
        grams = [np.frombuffer(g, np.uint64) for g in column("grams")] if "grams" in table.schema.names else None
        return cls(np.asarray(table.column("rep").to_numpy()), np.frombuffer(b"".join(column("sig")), np.uint16).reshape(-1, HASHES), grams)


def _near(sets: Sets, x: int, other: Sets, steps: list[tuple[int, int]]) -> np.ndarray:
    """The rows of other that stay after pruning against row x of sets."""
    rows = np.arange(len(other.rep))
    matches = np.zeros(len(rows), np.int64)
    for n, least in steps:
        matches += (other.sig[rows, n - STEP : n] == sets.sig[x, n - STEP : n]).sum(1)
        stay = matches >= least
        rows, matches = rows[stay], matches[stay]
    return rows


def pivot_edges(members: DataFrame, keys: list[str], linked, *, widest: int, size: Column | None = None) -> DataFrame:
    """keys, src, dst: edges that connect, in each group, all that ``linked(sets, x, others)`` links. members: keys, rep, sig (and grams), written.

    Every member is held against the group's pivot, the least of its ids, first: that is one comparison each, and most near copies are joined
    by it. Only the rest meets all members, in a grid of blocks of ``widest`` rows of both; a member that the pivot has joined stands
    for all others, so that a row of the rest needs one edge to these. n near copies so cost about n comparisons and are sent once, and again for each
    block of the rest.
    """
    kinds = [f"{c} {members.schema[c].dataType.simpleString()}" for c in keys]
    own = [c for c in ("sig", "grams") if c in members.columns]
    pivots = materialize(members.groupBy(*keys).agg(F.min_by(F.struct("rep", *own), "rep").alias("_p"), F.count("*").alias("_n"), (F.sum(size) if size is not None else F.lit(0)).alias("_bytes")))
    met = members.join(pivots.select(*keys, "_p"), keys).select(*keys, "rep", *own, "_p")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column("_p")
            first = np.asarray(p.field("rep").to_numpy())
            joined_ = np.zeros(batch.num_rows, bool)
            group = np.zeros(batch.num_rows, np.int64)
            for c in keys:
                group = np.unique(np.stack([group, np.unique(batch.column(c).to_numpy(), return_inverse=True)[1]], 1), axis=0, return_inverse=True)[1].ravel()
            for g in np.unique(group):
                rows = np.flatnonzero(group == g)
                pivot = Sets.of(pa.Table.from_batches([pa.RecordBatch.from_arrays([p.field(c).slice(int(rows[0]), 1) for c in ("rep", *own)], ["rep", *own])]))
                joined_[rows[linked(pivot, 0, Sets.of(batch.take(pa.array(rows))))]] = True
            rep = np.asarray(batch.column("rep").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), batch.column("rep"), pa.array(first), pa.array(joined_ | (rep == first))], [*keys, "rep", "pivot", "joined"])

    held = materialize(met.mapInArrow(hold, ", ".join([*kinds, "rep bigint, pivot bigint, joined boolean"])))
    edges = held.where("joined and rep <> pivot").select(*keys, F.col("rep").alias("src"), F.col("pivot").alias("dst"))
    rest = held.where("not joined").groupBy(*keys).agg(F.count("*").alias("_r"))
    across = F.greatest(F.ceil(F.col("_n") / widest), F.ceil(F.col("_bytes") / BLOCK_BYTES))
    down = F.greatest(F.ceil(F.col("_r") / widest), F.ceil(F.col("_bytes") / F.col("_n") * F.col("_r") / BLOCK_BYTES))
    sized = materialize(rest.join(pivots, keys).select(*keys, down.cast("int").alias("_down"), across.cast("int").alias("_across")))
    if sized.isEmpty():
        return edges
    known = members.join(held.select(*keys, "rep", "joined"), [*keys, "rep"]).join(sized, keys)
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = known.where("not joined").withColumn("i", place("_down")).withColumn("j", every("_across")).select(*keys, "i", "j", "rep", *own)
    right = known.withColumn("j", place("_across")).withColumn("i", every("_down")).select(*keys, "i", "j", "rep", "joined", *own)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        src, dst, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        if a.num_rows and b.num_rows:
            rows, others = Sets.of(a), Sets.of(b)
            part = np.where(b.column("joined").to_numpy(), 0, np.arange(1, b.num_rows + 1))  # what is known to be connected
            for x in range(a.num_rows):
                hit = linked(rows, x, others)
                parts, first = np.unique(part[hit], return_index=True)
                src.append(np.full(len(first), rows.rep[x]))
                dst.append(others.rep[hit[first]])
                if len(parts) > 1:
                    part[np.isin(part, parts)] = parts[0]
            at = sum(map(len, src))
        return pa.table([*(pa.array([a.column(c)[0].as_py()] * at, a.schema.field(c).type) if a.num_rows else pa.array([], b.schema.field(c).type) for c in keys), pa.array(np.concatenate(src), pa.int64()), pa.array(np.concatenate(dst), pa.int64())], names=[*keys, "src", "dst"])

    grid = [*keys, "i", "j"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both stem from members: columns of their own
    return edges.unionByName(left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(meet, ", ".join([*kinds, "src bigint, dst bigint"])).where("src <> dst"))


def shared_sizes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[k] and b[k]; pairs sorted by a.

    One by one where pairs are few, else by products of parts of the incidence matrix, less what only one set has.
    """
    size = np.array([len(s) for s in sets])
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    flat = np.concatenate(sets)
    distinct, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    columns = int((n > 1).sum())
    if len(a) * (15e-6 + 2e-8 * size.mean()) < len(sets) ** 2 * columns / 15e9:
        ids = np.split(at, np.cumsum(size)[:-1])
        has = np.zeros(len(distinct), bool)
        heads = np.flatnonzero(np.diff(a, prepend=-1))
        for low, high in zip(heads, np.append(heads[1:], len(a)), strict=True):
            has[ids[a[low]]] = True
            out[low:high] = [np.count_nonzero(has[ids[y]]) for y in b[low:high].tolist()]
            has[ids[a[low]]] = False
        return out
    row = np.repeat(np.arange(len(sets)), size)[n[at] > 1]
    at = number[at[n[at] > 1]]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    chunk, stripe = max(256, (1 << 23) // len(sets)), 512
    for low in range(0, columns, chunk):
        x, y = np.searchsorted(at, [low, low + chunk])
        m = np.zeros((len(sets), min(chunk, columns - low)), np.float32)
        m[row[x:y], at[x:y] - low] = 1
        for top in range(0, len(sets), stripe):
            p, q = np.searchsorted(a, [top, top + stripe])
            if p < q:
                out[p:q] += (m[top : top + stripe] @ m.T)[a[p:q] - top, b[p:q]].astype(np.int64)
    return out


def _similar(both: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """both / (n + m - both) >= threshold, with room for a threshold that is not exact in binary."""
    return both * (1 + threshold) >= threshold * (n + m) - 1e-9


def verified(members: DataFrame, *, threshold: float = THRESHOLD, tolerance: float = 1e-5, count: bool = True) -> DataFrame:
    """(component, rep, links, least) per member and pair of blocks. members: component, m, i, j, block, rep, weight, sig, grams.

    Without ``count``, links are left out and a spanning forest of the links is enough.
    """
    steps, kinds = _steps(threshold, tolerance), "component bigint, rep bigint, links bigint, least bigint"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            bounds = _groups(table, 3)
            component, i, j, block, rep, weight = (table.column(c).to_numpy() for c in ("component", "i", "j", "block", "rep", "weight"))
            links, least = np.zeros(len(rep), np.int64), rep.copy()
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").slice(lo, hi - lo).to_pylist()]
                sig = np.frombuffer(b"".join(table.column("sig").slice(lo, hi - lo).to_pylist()), np.uint16).reshape(-1, HASHES)
                size = np.array([len(s) for s in sets])
                if count:
                    a, b = surviving_pairs(np.zeros(hi - lo, np.int64), block[lo:hi], (i != j)[lo:hi], sig, steps)
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], b[order]
                    ok = _similar(shared_sizes(sets, a, b), size[a], size[b], threshold)
                    a, b = a[ok], b[ok]
                    links[lo:hi] = np.bincount(a, weight[lo:hi][b], hi - lo) + np.bincount(b, weight[lo:hi][a], hi - lo)
                else:
                    _, at = np.unique(np.concatenate(sets), return_inverse=True)
                    ends, has = np.cumsum(size), np.zeros(int(at.max()) + 1, bool)

                    def linked(x, rows, sig=sig, size=size, at=at, ends=ends, has=has):
                        rows = _pruned(sig, np.full(len(rows), x), rows, steps)[1]
                        if not len(rows):
                            return rows
                        own = at[ends[x] - size[x] : ends[x]]
                        has[own] = True
                        both = np.add.reduceat(has[at].astype(np.int32), ends - size)[rows]
                        has[own] = False
                        return rows[_similar(both, size[x], size[rows], threshold)]

                    a, b = joined(hi - lo, linked)
                order = np.argsort(rep[lo:hi], kind="stable")
                place = np.argsort(order)
                least[lo:hi][order] = rep[lo:hi][order][_forest(hi - lo, place[a], place[b])]
            yield pa.RecordBatch.from_arrays([pa.array(component), pa.array(rep), pa.array(links), pa.array(least)], [c.split()[0] for c in kinds.split(", ")])

    # The pairs of blocks of a component go to tasks next to each other, so that none gets many of them.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.pmod(F.xxhash64("component") + (F.col("j") * (F.col("j") + 1) / 2).cast("bigint") + F.col("i"), F.lit(tasks)).cast("int")
    sort = ["component", "i", "j"]
    return members.select(*sort, "block", "rep", "weight", "sig", "grams").repartitionById(tasks, task).sortWithinPartitions(*sort).mapInArrow(check, kinds)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, tkey, text) to (rep, tkey, grams), the set of shingle hashes."""
    for batch in batches:
        for a, b, texts in slices(batch.column(2), 1 << 20):
            grams, offsets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([grams[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["rep", "tkey", "grams"])
    give_back()


def _filter(keys: DataFrame, doc_id: str) -> np.ndarray:
    """A Bloom filter of (doc_id, tkey)."""
    return bloom.built(keys.select(F.xxhash64(doc_id, "tkey").alias("h")))


def classified(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = 1e-5, widest: int = WIDEST, narrowest: int = NARROWEST, count: bool = True) -> DataFrame:
    """doc_id, tkey (a hash of the text), class_id, n_links, copies of every row of docs; without ``count``, n_links lacks links to other sets."""
    drawn = materialize(sketches(docs, doc_id, text))
    some = drawn.where("doc_id is not null and key is not null")
    heads = some.groupBy("key").agg(F.min(F.struct("doc_id", "tkey")).alias("h"), F.count("*").alias("weight"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = materialize(heads.select("key", F.col("h.doc_id").alias("rep"), F.col("h.tkey").alias("tkey"), "weight", "sig", "n"))
    edges = materialize(candidate_edges(classes, threshold=threshold, tolerance=tolerance, widest=widest, narrowest=2 * narrowest))
    near = materialize(connected_components(edges).withColumnRenamed("id", "rep"))
    found = materialize(near.join(classes.drop("key", "sig"), "rep"))
    blocks = _n_blocks(docs.sparkSession, F.col("rows"), F.col("bytes"), widest, narrowest)
    sized = found.groupBy("component").agg(F.count("*").alias("rows"), F.sum(F.col("n").cast("bigint") * 8).alias("bytes")).select("component", "rows", blocks.alias("m"))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("rep"), F.xxhash64(text).alias("tkey"), F.col(text).alias("text"))
    wanted = bloom.passing(texts.where("rep is not null"), F.xxhash64("rep", "tkey"), _filter(found, "rep"))
    once = wanted.mapInArrow(_set_rows, "rep bigint, tkey bigint, grams binary").dropDuplicates(["rep", "tkey"])  # rows of docs may be repeated
    about = found.join(sized, "component").select("rep", "tkey", "component", "m", "rows", "weight")
    members = materialize(once.join(about, ["rep", "tkey"]).join(classes.select("rep", "tkey", "sig"), ["rep", "tkey"]))
    wide = F.lit(False) if count else F.col("rows") > widest
    checked = verified(_blocked(members.where(~wide)), threshold=threshold, tolerance=tolerance, count=count)
    if not count and not (large := members.where(wide)).isEmpty():  # a forest of links is enough
        steps = _steps(threshold, tolerance)

        def linked(sets: Sets, x: int, other: Sets) -> np.ndarray:
            rows = _near(sets, x, other, steps)
            mine = sets.grams[x]
            both = np.array([len(np.intersect1d(mine, other.grams[y], assume_unique=True)) for y in rows.tolist()], np.int64)
            return rows[_similar(both, len(mine), np.array([len(other.grams[y]) for y in rows.tolist()], np.int64), threshold)]

        found_edges = pivot_edges(large.select("component", "rep", "sig", "grams"), ["component"], linked, widest=widest, size=F.length("grams"))
        checked = checked.unionByName(found_edges.select("component", F.col("src").alias("rep"), F.lit(0).cast("bigint").alias("links"), F.col("dst").alias("least")))
    checked = materialize(checked)
    several = not members.where("m > 1").isEmpty()
    release(edges, near, found, members)
    linked = checked.groupBy("rep").agg(F.sum("links").alias("links"), F.min("least").alias("least"))
    if several:  # components over several blocks: join what their blocks found
        whole = connected_components(checked.where("least <> rep").select(F.col("rep").alias("src"), F.col("least").alias("dst")))
        linked = linked.join(whole.withColumnRenamed("id", "rep"), "rep", "left").withColumn("least", F.coalesce("component", "least")).drop("component")
    named = classes.select("key", "rep", "weight").join(linked, "rep", "left")
    out = drawn.select("doc_id", "tkey", "key").join(named, "key", "left")
    mine = F.col("doc_id").isNotNull() & F.col("rep").isNotNull()
    return out.select(
        "doc_id",
        "tkey",
        F.when(mine, F.coalesce("least", "rep")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(mine, F.col("weight") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
        F.when(mine, F.col("weight")).otherwise(F.lit(1)).cast("bigint").alias("copies"),
    )


def join_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id that links lead to), n_links (documents at or above the threshold), copies (with an equal set, itself included)."""
    return classified(docs, **options).drop("tkey")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, one of each class: the one with the class's doc_id (of repeated rows, one). Rows without a doc_id all stay.

    Only ids and hashes decide. Rows that a Bloom filter of those that go knows nothing of are not shuffled; only rows that are
    repeated and stay are grouped as wholes.
    """
    rows = classified(docs, doc_id=doc_id, text=text, count=False, **options).where("doc_id is not null")
    each = rows.groupBy("doc_id", "tkey", "class_id").agg(F.count("*").alias("n"))
    least = F.min("tkey").over(Window.partitionBy("doc_id", "class_id"))
    flags = each.select("doc_id", "tkey", ((F.col("doc_id") == F.col("class_id")) & (F.col("tkey") == least)).alias("stays"), (F.col("n") > 1).alias("again"))
    touched = materialize(flags.where("not stays or again"))
    table = _filter(touched, "doc_id")
    named = docs.select(F.xxhash64(docs[doc_id].cast("bigint"), F.xxhash64(docs[text])).alias("h"), docs[doc_id].cast("bigint").alias("doc_id"), F.xxhash64(docs[text]).alias("tkey"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))

    def passed(through: bool) -> DataFrame:
        return bloom.passing(named, F.col("h"), table, through)

    # Rows that the filter holds back stay where they are; the others meet the ids.
    alone, met = passed(False), passed(True).join(touched.select("doc_id", "tkey"), ["doc_id", "tkey"], "left_anti")
    out = alone.select("row.*").unionByName(met.select("row.*"))
    if touched.where("stays").isEmpty():
        return out
    again = passed(True).join(touched.where("stays").select("doc_id", "tkey"), ["doc_id", "tkey"], "left_semi").groupBy("doc_id", "tkey").agg(F.first("row").alias("row"))
    return out.unionByName(again.select("row.*"))


def op1_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and number of links."""
    return join_classes(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
