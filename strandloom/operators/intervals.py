"""Gaps and islands, single-linkage clusters, and the binned overlap join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import size
from ..storage import deal_by


def merged_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, start, end of the islands of overlapping or touching intervals."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(key, start, end, F.when(reach >= F.col(start), 0).otherwise(1).alias("_new"))
    island = F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # equal rows: one island
    return marked.withColumn("_island", island).groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def unaligned_regions(df: DataFrame, key: str, start: str, end: str, length: str) -> DataFrame:
    """key, start, end, size of what no interval of a key covers: before the first, between islands, after the last."""
    sizes = df.groupBy(key).agg(F.max(length).alias("_length"))
    order = Window.partitionBy(key).orderBy(start)
    islands = merged_intervals(df, key, start, end).join(sizes, key)
    seen = islands.select(key, start, end, "_length", F.lag(end).over(order).alias("_before"), F.lead(start).over(order).alias("_after"))
    s, e, length_ = F.col(start), F.col(end), F.col("_length")
    left = F.when(F.col("_before").isNull() & (s != 0), F.struct(F.lit(1).alias("s"), s.alias("e")))
    inner = F.when(F.col("_after").isNotNull() & (F.col("_after") - e - 1 != 0), F.struct((e + 1).alias("s"), (F.col("_after") - 1).alias("e")))
    right = F.when(F.col("_after").isNull() & (length_ - e != 0), F.struct((e + 1).alias("s"), length_.alias("e")))
    gap = F.explode(F.filter(F.array(left, inner, right), lambda x: x.isNotNull()))
    gaps = seen.select(key, gap.alias("_gap")).select(key, F.col("_gap.s").alias(start), F.col("_gap.e").alias(end))
    return gaps.withColumn("size", size(F.col(start), F.col(end)))


def value_clusters(df: DataFrame, keys: list[str], value: str, reach: int) -> DataFrame:
    """keys, value, canonical: values closer than or at ``reach`` to the one before share a cluster; its mean, cut towards 0, stands for it."""
    order = Window.partitionBy(*keys).orderBy(value)
    gap = F.col(value) - F.lag(value).over(order)
    marked = deal_by(df.select(*keys, value), *keys).select(*keys, value, F.when(gap <= reach, 0).otherwise(1).alias("_new"))
    # By range: equal values are in one cluster, whichever of them opened it.
    numbered = marked.withColumn("_cluster", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy(*keys, "_cluster")
    mean = F.sum(F.col(value).cast("bigint")).over(whole) / F.count("*").over(whole)
    return numbered.select(*keys, value, mean.cast("int").alias("canonical")).distinct()


def chained_islands(df: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """key, start, end of chains of intervals that share more than their ends, however many a key has.

    Intervals of one start are one row, so that a bin of ``width`` starts holds at most as many rows. What lies before a bin reaches it as one
    number, the greatest end of all earlier bins of its key: a prefix maximum over one row per bin. Whether an interval opens a chain is then known inside
    its bin; the last opening start of the earlier bins, again a prefix maximum, names the chain that goes on there. No window holds a key's intervals.
    """
    rows = df.where(F.col(start) < F.col(end)).groupBy(key, start).agg(F.max(end).alias(end)).withColumn("_bin", F.floor(F.col(start) / width))
    inside = Window.partitionBy(key, "_bin").orderBy(start).rowsBetween(Window.unboundedPreceding, -1)

    def before(rows: DataFrame, value: Column, name: str) -> DataFrame:
        """Adds the greatest value of the earlier rows of the key: of earlier bins, and of the own one."""
        earlier = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        tops = rows.groupBy(key, "_bin").agg(F.max(value).alias("_top")).select(F.col(key).alias("_k"), F.col("_bin").alias("_b"), F.max("_top").over(earlier).alias("_top"))
        own = rows.withColumn("_own", F.max(value).over(inside))
        return own.join(tops, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bin") == F.col("_b"))).withColumn(name, F.greatest("_top", "_own")).drop("_top", "_own", "_k", "_b")

    opened = before(rows, F.col(end), "_reach").withColumn("_opens", F.when(F.coalesce(F.col("_reach") <= F.col(start), F.lit(True)), F.col(start)))
    named = before(opened, F.col("_opens"), "_chain")
    return named.groupBy(key, F.coalesce("_opens", "_chain").alias(start)).agg(F.max(end).alias(end))


def overlap_join(left: DataFrame, right: DataFrame, on: tuple[str, str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: int = 512) -> DataFrame:
    """Rows of equal key whose spans share more than their ends: l.start < r.end and r.start < l.end.

    Bins have levels, of ``width``, 64 x ``width``, 4096 x ``width`` .. positions. A span's own level is the first whose bins are a 64th of it or longer, so that it
    lies in 65 of them at most. A pair meets in a bin of the longer span's level: each row is dealt to bins of its own level and of
    the higher ones that the other side has, which one pass over both sides finds. A very long span so makes a few rows, not one for each bin of ``width``.
    A pair that shares several bins is kept in the first only. Columns of the two sides must differ.
    """
    (ls, le), (rs, re) = left_span, right_span
    factor = 64

    def levelled(df: DataFrame, s: Column, e: Column, p: str) -> tuple[DataFrame, list[int]]:
        own = F.lit(0)
        for level in range(1, 6):  # as far as positions go
            own = F.when(e - s > width * factor**level, F.lit(level)).otherwise(own)
        out = df.withColumns({f"_{p}s": s, f"_{p}e": e, f"_{p}o": own})
        found = out.agg(F.bit_or(F.element_at(F.array(*[F.lit(1 << k) for k in range(6)]), F.col(f"_{p}o") + 1))).first()[0] or 0
        return out, [k for k in range(6) if found >> k & 1]

    def dealt(df: DataFrame, p: str, there: list[int]) -> DataFrame:
        def bins(level: int) -> Column:
            w = width * factor**level
            every = F.sequence(F.floor(F.col(f"_{p}s") / w), F.floor(F.greatest(F.col(f"_{p}s"), F.col(f"_{p}e") - 1) / w))
            return every if most == 0 else F.transform(every, lambda b: F.struct(F.lit(level).alias("l"), b.alias("b")))

        if most == 0:
            return df.withColumn(f"_{p}b", F.explode(bins(0)))
        own = [F.when((F.col(f"_{p}o") == k) | ((F.col(f"_{p}o") < k) & F.lit(k in there)), bins(k)) for k in range(most + 1)]
        placed = df.withColumn(f"_{p}x", F.explode(F.flatten(F.filter(F.array(*own), lambda x: x.isNotNull()))))
        return placed.withColumns({f"_{p}l": F.col(f"_{p}x.l"), f"_{p}b": F.col(f"_{p}x.b")}).drop(f"_{p}x")

    (a, lefts), (b, rights) = levelled(left, ls, le, "l"), levelled(right, rs, re, "r")
    most = max([0, *lefts, *rights])
    x, y = dealt(a, "l", rights), dealt(b, "r", lefts)
    meet = (x[on[0]] == y[on[1]]) & (F.col("_lb") == F.col("_rb"))
    level = F.lit(0)
    if most:
        meet, level = meet & (F.col("_ll") == F.col("_rl")), F.col("_ll")
    bin_width = F.element_at(F.array(*[F.lit(width * factor**k) for k in range(most + 1)]), level + 1) if most else F.lit(width)
    real = (F.col("_ls") < F.col("_re")) & (F.col("_rs") < F.col("_le")) & (F.col("_lb") == F.floor(F.greatest("_ls", "_rs") / bin_width))
    if most:
        real = real & (level == F.greatest("_lo", "_ro"))
    return x.join(y, meet).where(real).drop(*(f"_{p}{c}" for p in "lr" for c in "seolb"))
