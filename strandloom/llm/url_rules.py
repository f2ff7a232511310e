"""URL filter: listed rules first, then association rules mined from labelled URLs.

A URL is a set of tokens: its top-level domain, its domain, labels before it, path segments that are not
numbers, extension and query keys. All of a URL's tokens are mined and matched. Spark's FP-growth finds the token
sets that often come with the label ``block`` or with ``allow``; of the rules ``tokens -> label``, those below the
support, confidence or lift asked for are pruned, and those that a rule on fewer of the tokens makes redundant.
Rules are matched by an inverted index: each is filed under its rarest item, so that a URL meets only rules it
shares that item with. Of the rules that fit a URL, the surest decides.

Labels may come from any table; the query takes the verdicts of the listed rules. URLs that no listed rule
fits are not learned from: the mined rules judge them.

Two steps that lose no rule keep FP-growth small. Tokens that are in the same rows (as those of one long URL) are one
item; a URL has the item if it has any of them. A token that comes with one label only is a rule as it
stands, which makes every longer one redundant, and is not mined further. Sets of any length are mined: whether a rule is redundant is
carried upward through the frequent sets, from each to those of one item more, so that no set's subsets are listed. The number of sets grows as 2 to the
number of tokens that are frequent together; README has figures. Nothing of this reaches the driver but counts.

Defined results: a null URL, or one without ``://``, has empty host, path and token set, fits no rule, and
is allowed, as is any URL that no rule fits; a very long URL is matched by all of its tokens; equal URLs get equal
verdicts; a tie between listed rules of equal length goes to the one that sorts first, between mined ones to the greater
support, then to ``block``, then to the one that sorts first; without rows of both labels nothing is mined; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, release

HOT = 1000
# (verdict, host, path) of the listed rules.
LISTED = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    rules = sorted(LISTED if rules is None else rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(rules):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    top = F.slice(F.reverse(labels), 1, 1)
    domain = F.when(n >= 2, F.array(F.concat_ws(".", F.slice(labels, n - 1, 2)))).otherwise(F.array().cast("array<string>"))
    below = F.when(n > 2, F.slice(labels, 1, F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    segments = F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z]{1,5}$", ""), "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    extension = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.concat(F.lit(kind + "="), x))

    parts = F.concat(named("tld", top), named("domain", domain), named("segment", segments), named("label", below), named("query", keys), F.when(extension != "", F.array(F.concat(F.lit("extension="), extension))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.coalesce(F.when(host != "", parts), F.array().cast("array<string>")))


@dataclass
class Rules:
    """items: token, item. rules: items (sorted), filed (the rarest of them), blocked, confidence, support."""

    items: DataFrame
    rules: DataFrame


_BLOCK, _ALLOW = "block", "allow"  # no tokens: these have a kind


def _redundant(sets: DataFrame, sure: DataFrame, gain: float) -> DataFrame | None:
    """(items, blocked) of the sure rules that one on fewer of their items makes redundant.

    sets: (items, blocked) of all frequent sets with a label, among which are all subsets of each.
    """
    sized = sure.select("items", "blocked", "confidence", F.size("items").alias("size"))
    longest = sized.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    best = sized.where("size = 1").select(F.col("items").alias("part"), "blocked", F.col("confidence").alias("best"))
    out = None
    for size in range(2, longest + 1):
        parts = sets.where(F.size("items") == size).select("items", "blocked", F.explode(F.transform("items", lambda x: F.array_except("items", F.array(x)))).alias("part"))
        below = parts.join(best, ["part", "blocked"]).groupBy("items", "blocked").agg(F.max("best").alias("below"))
        level = below.join(sized.where(F.col("size") == size), ["items", "blocked"], "full")
        level = materialize(level) if size % 4 == 0 else level  # else plans would grow with the length
        needless = level.where(F.col("below") + gain >= F.col("confidence")).select("items", "blocked")
        out = needless if out is None else out.unionByName(needless)
        best = level.select(F.col("items").alias("part"), "blocked", F.greatest("below", "confidence").alias("best"))
    return out


def mine(labelled: DataFrame, *, min_support: float = 0.02, min_confidence: float = 0.8, min_lift: float = 1.5, longest: int | None = None, gain: float = 0.02) -> Rules:
    """labelled: tokens, blocked (null: not learned from).

    A rule holds for at least ``min_support`` of the rows. Its label is ``min_lift`` times as frequent among its rows as
    among all, or the other label ``min_lift`` times as seldom: the first is out of reach where most rows have one label.
    It is redundant if such a rule for the same label on fewer of its items is at most ``gain`` less sure. ``longest`` leaves out
    rules on more items, for those who want short rules only.
    """
    spark = labelled.sparkSession
    known = labelled.where("blocked is not null").select(F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))).alias("tokens"), F.col("blocked").cast("int").alias("b"))
    baskets = materialize(known.groupBy("tokens").agg(F.count("*").alias("n"), F.sum("b").alias("b")))
    n, total = baskets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if total in (0, n):
        return Rules(spark.createDataFrame([], "token string, item string"), spark.createDataFrame([], "items array<string>, filed string, blocked boolean, confidence double, support double"))
    least = max(1, math.ceil(min_support * n - 1e-9))

    # Tokens in the same baskets: equal counts and equal fingerprints of these.
    marks = [F.bit_xor(F.xxhash64("tokens", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    often = baskets.select("tokens", "n", "b", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), *marks)
    often = often.where(F.greatest(F.col("b"), F.col("n") - F.col("b")) >= least)
    named = often.groupBy("n", "b", "m1", "m2").agg(F.min("token").alias("item"))
    items = materialize(often.join(named, ["n", "b", "m1", "m2"]).select("token", "item", "n", "b"))
    mixed = items.where("b > 0 and b < n").select("token", "item")

    held = baskets.select("tokens", F.explode("tokens").alias("token")).join(mixed, "token").groupBy("tokens").agg(F.collect_set("item").alias("own"))
    rows = known.join(held, "tokens", "left").select(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.array(F.when(F.col("b") == 1, _BLOCK).otherwise(_ALLOW))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(rows).freqItemsets
    marked = sets.select(F.array_sort(F.array_except("items", F.array(F.lit(_BLOCK), F.lit(_ALLOW)))).alias("items"), F.array_contains("items", _BLOCK).alias("blocks"), F.array_contains("items", _ALLOW).alias("allows"), "freq")
    marked = materialize(marked.where(F.size("items").between(1, longest or 1 << 30)))
    with_label = marked.where("blocks or allows").select("items", F.col("blocks").alias("blocked"), F.col("freq").alias("hits"))
    found = with_label.join(marked.where("not blocks and not allows").select("items", F.col("freq").alias("rows")), "items")
    pure = items.where("b = 0 or b = n").select(F.array("item").alias("items"), (F.col("b") > 0).alias("blocked"), F.col("n").alias("hits"), F.col("n").alias("rows")).distinct()

    confidence, prior = F.col("hits") / F.col("rows"), F.when(F.col("blocked"), total / n).otherwise(1 - total / n)
    lifted = (confidence >= min_lift * prior) | (1 - prior >= min_lift * (1 - confidence))
    sure = materialize(found.unionByName(pure).withColumn("confidence", confidence).where((F.col("hits") >= least) & (F.col("confidence") >= min_confidence) & lifted))
    needless = _redundant(with_label.select("items", "blocked"), sure, gain)
    rarest = sure.select("items", F.explode("items").alias("item")).distinct().join(items.select("item", "n").distinct(), "item").groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("filed"))
    kept = sure if needless is None else sure.join(needless, ["items", "blocked"], "left_anti")
    rules = materialize(kept.join(rarest, "items").select("items", "filed", "blocked", "confidence", (F.col("hits") / n).alias("support")))
    release(baskets, marked, sure)
    return Rules(items.select("token", "item"), rules)


def match(urls: DataFrame, mined: Rules, tokens: str = "tokens") -> DataFrame:
    """Adds ``mined`` (the items of the surest rule that fits; null without one), ``mined_blocks`` and ``confidence``.

    Token sets are matched once, however many rows have them. Sets that more than one row in HOT has, at most HOT of them, go
    to their rows by broadcast, the others by a shuffle.
    """
    rows = urls.select(F.struct(*(urls[c] for c in urls.columns)).alias("_row"), F.coalesce(urls[tokens], F.array().cast("array<string>")).alias("_own"))
    sets = materialize(rows.groupBy("_own").agg(F.count("*").alias("_n")))
    total = sets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    have = sets.select("_own", F.explode("_own").alias("token")).join(mined.items, "token").groupBy("_own").agg(F.collect_set("item").alias("_have"))
    met = have.select("_own", "_have", F.explode("_have").alias("filed")).join(mined.rules, "filed").where(F.size(F.array_except("items", "_have")) == 0)
    order = F.struct(F.negate("confidence"), F.negate("support"), ~F.col("blocked"), "items")
    best = met.groupBy("_own").agg(F.min_by(F.struct(F.array_join("items", " ").alias("mined"), F.col("blocked").alias("mined_blocks"), "confidence"), order).alias("_best"))
    judged = materialize(sets.join(best, "_own", "left"))
    release(sets)
    hot = F.broadcast(judged.where(F.col("_n") * HOT > total).drop("_n"))
    cold = judged.where(F.col("_n") * HOT <= total).drop("_n")
    found = rows.join(hot, "_own").unionByName(rows.join(hot.select("_own"), "_own", "left_anti").join(cold, "_own", "left"))
    return found.select("_row.*", "_best.mined", "_best.mined_blocks", "_best.confidence")


def op5_association_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    url = F.col("url")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"))
    seen = materialize(pages.withColumns({"rule": rule, "listed": verdict}))
    judged = match(seen, mine(seen.select("tokens", (F.col("listed") == "block").alias("blocked"))))
    mined = F.when(F.col("mined_blocks"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", mined).alias("verdict"), "mined", "confidence")
