"""Hard negatives by anchor-clustered shared lists (MAXIMUS).

Anchors are clustered by direction. For an anchor u of a cluster whose anchors lie within an angle ``reach`` of its centre, the score of a candidate x is at
most |u| |x| cos(max(0, angle(x, centre) - reach)). The part without |u| is one bound for the whole cluster, and
sorted by it the candidates are one list, which all members walk until no later candidate can change their results.

1. Centres and the bounds at which lists are cut come from a sample of at most ``SAMPLE`` anchors and as many rows. They decide how much is walked, never
   what is found. All anchors are assigned; each cluster's reach is the greatest angle of any of its anchors.
2. ``walk`` goes down the lists segment by segment. In each, a candidate goes to the lists of the clusters that still have an open
   anchor for which its bound is enough. A list's segment is cut into blocks and its anchors into groups, so that no task
   holds more than a block and a group, however large a cluster is or how many copies a vector has. Inside, the block is
   sorted by bound once and the group walks it in chunks; an anchor leaves as soon as the next bound is below its k-th best score.
   Between segments, the k best scores so far close all requests that the rest of the list cannot change.
3. A request asks for the k best scores within limits. The first walk finds each anchor's positives, of its label; the
   second, for each positive, the best of other labels from ``share`` of its score up to its score.

Components x become floor(256 x), so scores are whole numbers and exact: double precision where |u| |x| allows, else arbitrary precision.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; of rows that share a vec_id one takes
part, the one with the least label, then the least vector; shorter vectors are continued with zeros, and an empty one scores 0; vectors may be of
any length; a component beyond 2^62 counts as 2^62, and a score beyond a long as its limit; ties go to the smaller vec_id, and all equal vectors are candidates;
an anchor without another row of its label, or whose positive has a negative score, gives no rows for it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize, release, spread
from .samples import DRAWS

CLUSTERS, SAMPLE = 8, 4096
# Anchors of a group, candidates of a block and of a chunk.
GROUP, BLOCK, CHUNK = 512, 4096, 512
# Shares of a list at which its segments end.
CUTS = (1 / 16, 1.0)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
LIMIT = float(1 << 62)


def usable(rows: DataFrame, *, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding") -> DataFrame:
    """vec_id, label, vector of the rows that take part."""
    body = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"), F.col(vector).alias("vector"))
    sound = body.where("vec_id is not null and label is not null and vector is not null").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return sound.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows of whole numbers, shorter ones continued with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -LIMIT, LIMIT)
    size = np.asarray(column.value_lengths())
    if not len(size) or (size == size[0]).all():
        return flat.reshape(len(size), int(size[0]) if len(size) else 0)
    out = np.zeros((len(size), int(size.max())))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = min(a.shape[1], b.shape[1])
    return a[:, :d], b[:, :d]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, as longs."""
    a, b = _common(a, b)
    largest = np.sqrt((a**2).sum(1).max(initial=0)) * np.sqrt((b**2).sum(1).max(initial=0))
    if largest < 1 << 52:
        return (a @ b.T).astype(np.int64)
    whole = [[int(v) for v in r] for r in b]
    return np.array([[min(MOST, max(LEAST, sum(int(u) * v for u, v in zip(r, w, strict=True)))) for w in whole] for r in a], np.int64).reshape(len(a), len(b))


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


def _above(bound: np.ndarray) -> np.ndarray:
    """A bound with room for rounding."""
    return bound + 1e-9 * np.abs(bound) + 1


@dataclass
class Index:
    centres: np.ndarray  # unit vectors
    reach: np.ndarray | None = None  # greatest angle between a centre and an anchor of its cluster
    sample: np.ndarray | None = None  # bounds of the sampled rows, by cluster

    def cosines(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each vector with each centre; 1 for vectors without a direction."""
        x, centres = _common(x, self.centres)
        return np.where(size[:, None] > 0, np.clip(x @ centres.T / np.maximum(size, 1e-300)[:, None], -1, 1), 1)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Of each vector in the list of each cluster: the most that its score can be for an anchor of length 1."""
        size = norms(x)
        return size[:, None] * np.cos(np.maximum(0, np.arccos(self.cosines(x, size)) - self.reach[None]))


def centres(x: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """At most n unit vectors around which the vectors x gather (spherical k-means, from vectors far from each other)."""
    x = x[norms(x) > 0]
    if not len(x):
        return np.zeros((1, 1))
    x = x / norms(x)[:, None]
    chosen, near = [0], x @ x[0]
    while len(chosen) < n and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    out = x[chosen]
    for _ in range(rounds):
        own = (x @ out.T).argmax(1)
        total = np.zeros_like(out)
        np.add.at(total, own, x)
        size = norms(total)
        out = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-300)[:, None], out)
    return out


def _sampled(rows: DataFrame, n: int) -> np.ndarray:
    """The vectors of at most SAMPLE of the n rows, those with the least hashes of their ids."""
    drawn = rows.select("vector", F.pmod(F.xxhash64("vec_id"), F.lit(DRAWS)).alias("draw")).where(F.col("draw") < min(DRAWS, int(DRAWS * (2 * SAMPLE + 100) / max(1, n))))
    return matrix(drawn.orderBy("draw").limit(SAMPLE).select("vector").toArrow().column(0))


ASSIGNED = "cluster int, norm double, cosine double"


def assigned(anchors: DataFrame, index: Index) -> DataFrame:
    """Adds each anchor's cluster, length and cosine with the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"))
            size = norms(x)
            cosine = index.cosines(x, size)
            own = cosine.argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(size), pa.array(cosine[np.arange(len(own)), own])], [*batch.schema.names, "cluster", "norm", "cosine"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    return anchors.mapInArrow(run, f"{kinds}, {ASSIGNED}")


def _best(request: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each request: by score, then by the smaller id."""
    order = np.lexsort((other, -score.astype(np.float64), request)) if not len(score) or np.abs(score).max() < 1 << 52 else np.array(sorted(range(len(score)), key=lambda i: (request[i], -int(score[i]), other[i])), np.int64)
    r = request[order]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[place < k]


def walked(anchor: dict[str, np.ndarray], wants: dict[str, np.ndarray], listed: dict[str, np.ndarray], k: int, same: bool, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What a group of anchors finds in a block: request (its place in wants), score, id; and how many scores were computed.

    anchor: x, norm, id, label; wants: at (the anchor's place), low, high; listed: x, bound, id, label.
    """
    order = np.argsort(-listed["bound"], kind="stable")
    low = wants["low"].copy()
    request, score, other = (np.zeros(0, np.int64) for _ in range(3))
    live, computed = np.arange(len(low)), 0
    for start in range(0, len(order), chunk):
        top = listed["bound"][order[start]]
        live = live[_above(anchor["norm"][wants["at"][live]] * top) >= low[live]]
        if not len(live):
            break
        part = order[start : start + chunk]
        rows, place = np.unique(wants["at"][live], return_inverse=True)
        s = scores(anchor["x"][rows], listed["x"][part])
        computed += s.size
        fits = (anchor["label"][rows][:, None] == listed["label"][part][None]) == same
        fits &= anchor["id"][rows][:, None] != listed["id"][part][None]
        own = s[place]
        r, c = np.nonzero(fits[place] & (own >= low[live][:, None]) & (own <= wants["high"][live][:, None]))
        if not len(r):
            continue
        request, score, other = np.concatenate([request, live[r]]), np.concatenate([score, own[r, c]]), np.concatenate([other, listed["id"][part[c]]])
        keep = _best(request, score, other, k)
        request, score, other = request[keep], score[keep], other[keep]
        full = np.flatnonzero(np.bincount(request, minlength=len(low)) == k)
        last = np.searchsorted(request, full, side="right") - 1
        low[full] = np.maximum(low[full], score[last])
    return request, score, other, computed


WANTS = "array<struct<request:int,low:bigint,high:bigint>>"
FOUND = "anchor_id bigint, request int, score bigint, other_id bigint"


def _top(found: DataFrame, k: int, keys: tuple[str, ...] = ("anchor_id", "request")) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _routed(rows: DataFrame, index: Index, upper: np.ndarray, lower: np.ndarray) -> DataFrame:
    """cluster, bound and the row, for each list in which its bound lies above ``lower`` and not above ``upper``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = index.bounds(matrix(batch.column("vector")))
            row, cluster = np.nonzero((bounds <= upper) & (bounds > lower))
            for at in range(0, len(row), 1 << 13):
                r, c = row[at : at + (1 << 13)], cluster[at : at + (1 << 13)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(bounds[r, c]), *batch.take(pa.array(r)).columns], ["cluster", "bound", *batch.schema.names])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("vec_id", "label", "vector").mapInArrow(run, f"cluster int, bound double, vec_id bigint, label bigint, vector {kind}")


def walk(anchors: DataFrame, rows: DataFrame, n: int, index: Index, *, k: int, same: bool, cuts: tuple[float, ...] = CUTS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """anchor_id, request, score, other_id: the k best of each request among the n rows of the anchor's label (``same``) or of others.

    anchors: vec_id, label, vector, cluster, norm, wants (WANTS: scores from low to high).
    """
    spark = anchors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, open_ = None, anchors
    upper = np.full(len(index.centres), np.inf)

    def find(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        if left.num_rows and right.num_rows:
            column = lambda t, c: t.column(c).to_numpy()
            wants = left.column("wants").combine_chunks()
            at, flat = np.repeat(np.arange(left.num_rows), np.asarray(wants.value_lengths())), wants.flatten()
            number, low, high = (flat.field(c).to_numpy() for c in ("request", "low", "high"))
            anchor = {"x": matrix(left.column("vector")), "norm": column(left, "norm"), "id": column(left, "vec_id"), "label": column(left, "label")}
            listed = {"x": matrix(right.column("vector")), "bound": column(right, "bound"), "id": column(right, "vec_id"), "label": column(right, "label")}
            r, score, other, _ = walked(anchor, {"at": at, "low": low, "high": high}, listed, k, same)
            out = [anchor["id"][at[r]], number[r], score, other]
        return pa.table([pa.array(v, t) for v, t in zip(out, [pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

    for share in cuts:
        # The least bound that any open anchor of a cluster needs; a slack as in _above.
        low = lambda w: w["low"].cast("double")
        need = F.min(F.array_min(F.transform("wants", lambda w: (low(w) - 2 - 1e-8 * F.abs(low(w))) / F.greatest("norm", F.lit(1e-300)))))
        state = open_.groupBy("cluster").agg(F.count("*").alias("n"), need.alias("need")).collect()
        if not state:
            break
        edge = np.full(len(upper), -np.inf) if share >= 1 else np.quantile(index.sample, 1 - share, axis=0)
        lower = np.full(len(upper), np.inf)
        groups, blocks = np.zeros(len(upper), int), np.zeros(len(upper), int)
        for r in state:
            lower[r.cluster] = max(edge[r.cluster], r.need)
            reached = float(((index.sample[:, r.cluster] > lower[r.cluster]) & (index.sample[:, r.cluster] <= upper[r.cluster])).mean()) * n
            groups[r.cluster] = ceil(r.n / group)
            blocks[r.cluster] = max(1, ceil(reached / block), min(ceil(reached / 256), ceil(tasks / len(state))))
        per = lambda counts: F.get(F.array(*[F.lit(int(c)) for c in counts]), F.col("cluster"))
        own = lambda counts: F.pmod(F.xxhash64("vec_id"), F.greatest(per(counts), F.lit(1))).cast("int")
        every = lambda counts: F.explode(F.sequence(F.lit(0), per(counts) - 1))
        left = open_.select("cluster", "vec_id", "label", "vector", "norm", "wants", own(groups).alias("group")).withColumn("block", every(blocks))
        right = _routed(rows, index, upper, lower).withColumn("block", own(blocks)).withColumn("group", every(groups))
        keys = ["cluster", "group", "block"]
        new = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, FOUND)
        was, found = found, materialize(_top(new if found is None else new.unionByName(found), k))
        if was is not None:
            release(was)
        # What the rest of a list cannot change is closed.
        upper = edge
        last = found.groupBy("anchor_id", "request").agg(F.count("*").alias("_k"), F.min("score").alias("_least")).where(F.col("_k") == k).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("request", "_least"))).alias("_least"))
        rest = F.col("norm") * F.get(F.array(*[F.lit(float(e)) for e in edge]), F.col("cluster"))
        raised = F.transform("wants", lambda w: w.withField("low", F.greatest(w["low"], F.coalesce(F.element_at("_least", w["request"]), w["low"]))))
        kept = F.filter(raised, lambda w: rest + 1e-9 * F.abs(rest) + 1 >= w["low"])
        open_ = anchors.join(last, "vec_id", "left").withColumn("wants", kept).drop("_least").where(F.size("wants") > 0)
    return found if found is not None else materialize(spark.createDataFrame([], FOUND))


def mine(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, share: Fraction = Fraction(80, 100), clusters: int = CLUSTERS, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: vec_id, label, vector, as ``usable`` gives them."""
    rows = materialize(rows)
    n = rows.count()
    some = rows.where(is_anchor)
    index = Index(centres(_sampled(some, some.count()), clusters))
    anchors = materialize(assigned(some, index))
    reached = {r.cluster: np.arccos(r.c) + 1e-7 for r in anchors.groupBy("cluster").agg(F.min("cosine").alias("c")).collect()}
    index.reach = np.array([reached.get(c, 0.0) for c in range(len(index.centres))])
    index.sample = index.bounds(_sampled(rows, n))
    every = F.array(F.struct(F.lit(0).alias("request"), F.lit(LEAST).cast("bigint").alias("low"), F.lit(MOST).cast("bigint").alias("high")))
    near = walk(anchors.withColumn("wants", every), rows, n, index, k=positives, same=True, **options)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    chosen = materialize(near.select("anchor_id", F.row_number().over(order).alias("request"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    p, less = F.col("positive_score"), 1 - share
    # p less this is the least whole number that is ``share`` of p or more; nothing here leaves a long.
    down = F.expr(f"positive_score div {less.denominator} * {less.numerator} + positive_score % {less.denominator} * {less.numerator} div {less.denominator}")
    wants = chosen.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("request", (p - down).cast("bigint").alias("low"), p.alias("high"))).alias("wants"))
    far = walk(anchors.join(wants, "vec_id"), rows, n, index, k=negatives, same=False, **options)
    release(rows, anchors, near)
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "request").orderBy(F.desc("score"), "other_id")))
    return ranked.join(chosen, ["anchor_id", "request"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_shared_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row, with the labels of every seventh moved by one."""
    old = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (old + 1) % 10).otherwise(old)
    return mine(usable(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), label=label), F.col("vec_id") % 100 == 0)
