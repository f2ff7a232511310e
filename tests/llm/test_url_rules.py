import random
import re
from itertools import combinations, product

from pyspark.sql import functions as F

from strandloom.llm import url_rules as u

URLS = ["https://M.example.com/en/25#top", "http://example.com/en/7?x=1", "https://example.net/de/8", "https://a.net/de/9", "ftp://x.org/es/", "http://x.org/es", "nourl", None, "", "://", "http://HOST", "http://notcom/en/", "http://com/en/1", "a://b://c/d?e", "http://x.com?en/", "http://example.net/de/8/a.html?utm_source=f&a", "http://x.org/\n/es"]


def by_hand(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for v, h, p in u.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None)))


def test_parts_and_listed_rules(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(URLS)], "page_id long, url string").withColumns({"host": u.host_of(F.col("url")), "path": u.path_of(F.col("url"))})
    rule, verdict = u.listed_rule(F.col("host"), F.col("path"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.withColumns({"rule": rule, "verdict": verdict}).collect()}
    assert got == {i: by_hand(x) for i, x in enumerate(URLS)}


def rules_of(mined):
    """(tokens, label is block) -> confidence; an item stands for each of its tokens."""
    alike = {}
    for r in mined.items.collect():
        alike.setdefault(r.item, []).append(r.token)
    return {(frozenset(t), r.blocked): round(r.confidence, 9) for r in mined.rules.collect() for t in product(*(alike[i] for i in r["items"]))}


def mined_by_hand(baskets, min_support, min_confidence=0.8, min_lift=1.5, longest=4, gain=0.02):
    """Every token set by counting, pruned as the operator says; baskets: (tokens, blocked)."""
    n, total = len(baskets), sum(b for _, b in baskets)
    sure = {}
    for label in (True, False):
        prior = (total if label else n - total) / n
        for c in {c for t, b in baskets if b == label for k in range(1, longest + 1) for c in combinations(sorted(set(t)), k)}:
            mine = [b == label for t, b in baskets if set(c) <= set(t)]
            x = sum(mine) / len(mine)
            if sum(mine) >= max(1, min_support * n - 1e-9) and x >= min_confidence and (x >= min_lift * prior or 1 - prior >= min_lift * (1 - x)):
                sure[frozenset(c), label] = x
    return {(c, label): round(x, 9) for (c, label), x in sure.items() if not any(s < c and m == label and y + gain >= x for (s, m), y in sure.items())}


def matched_by_hand(own, rules):
    """Confidence of the surest rule that fits."""
    return max((x for (t, _), x in rules.items() if t <= set(own or ())), default=None)


def test_mining_and_matching(spark):
    rows = [(["tld=com", "segment=ads", f"label={i % 9}"], True) for i in range(60)] + [(["tld=com", "segment=news"], False)] * 60 + [(["tld=org", "segment=ads"], False)] * 40 + [([], False)] * 5 + [(["tld=org"], None), (None, None)]
    mined = u.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), min_support=0.05)
    got = rules_of(mined)
    assert got == mined_by_hand([r for r in rows if r[1] is not None], 0.05)
    assert got[frozenset(["segment=ads", "tld=com"]), True] == 1.0 and got[frozenset(["tld=org"]), False] == 1.0
    urls = spark.createDataFrame([(1, ["tld=com", "segment=ads", "x"], "k"), (2, ["segment=ads"], "k"), (3, None, "k"), (4, [], "k"), (1, ["tld=com", "segment=ads", "x"], "k")], "id long, tokens array<string>, item string")
    assert sorted((r.id, r.mined, r.mined_blocks) for r in u.match(urls, mined).collect()) == [(1, "segment=ads tld=com", True)] * 2 + [(2, None, None), (3, None, None), (4, None, None)]


def test_without_both_labels_nothing_is_mined(spark):
    for rows in ([], [(["a=b"], True)] * 5, [(["a=b"], False)] * 5, [(["a=b"], None)] * 5):
        mined = u.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"))
        assert mined.rules.count() == 0
        assert [r.mined for r in u.match(spark.createDataFrame([(["a=b"],)], "tokens array<string>"), mined).collect()] == [None]


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, x, "h") for i, x in enumerate(URLS * 3)], "page_id long, url string, host string").write.parquet(str(tmp_path / "pages.parquet"))
    got = u.op5_association_urls(spark, str(tmp_path)).collect()
    assert len(got) == 3 * len(URLS)
    for r in got:
        host, path, rule, verdict = by_hand((URLS * 3)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ([verdict] if verdict else ["block", "allow"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert u.op5_association_urls(spark, str(tmp_path)).count() == 0


def test_rules_and_matches_against_brute_force(spark):
    rng = random.Random(8)
    hosts = ["shop.example.com", "www.example.com", "news.example.org", "a.b.example.net"]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'ads'])}/{rng.randrange(9)}{rng.choice(['', '.html', '?q=1', '/'])}" for _ in range(300)]
    blocked = [None if rng.random() < 0.1 else ("/ads/" in x and "example.com" in x) or ("/es/" in x and rng.random() < 0.9) for x in urls]
    df = spark.createDataFrame(list(zip(range(300), urls, blocked, strict=True)), "id long, url string, blocked boolean").withColumn("tokens", u.tokens_of(F.col("url")))
    baskets = [(r.tokens, r.blocked) for r in df.select("tokens", "blocked").collect()]
    mined = u.mine(df, min_support=0.06)
    want = mined_by_hand([b for b in baskets if b[1] is not None], 0.06)
    assert rules_of(mined) == want and {label for _, label in want} == {True, False}
    for r in u.match(df, mined).collect():
        x = matched_by_hand(r.tokens, want)
        assert (r.confidence is None) == (x is None) and (x is None or abs(r.confidence - x) < 1e-8)


def test_unlisted_urls_get_both_verdicts_by_mined_rules(spark, tmp_path):
    rng = random.Random(2)
    urls = [f"https://{rng.choice(['www', 'm', 'ads'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(100)}" for _ in range(400)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [r for r in u.op5_association_urls(spark, str(tmp_path)).collect() if r.rule is None]
    assert {(r.verdict, r.mined is not None) for r in got} >= {("block", True), ("allow", True)}


DEEP = "https://a.b.c.example.com/" + "/".join(f"s{i}" for i in range(25)) + "/{}/x?" + "&".join(f"k{i}=1" for i in range(12))


def test_tokens_far_along_a_url_count(spark):
    urls = [DEEP.format("bad" if i % 2 else "good") for i in range(80)]
    df = spark.createDataFrame([(x, "/bad/" in x) for x in urls], "url string, blocked boolean").withColumn("tokens", u.tokens_of(F.col("url")))
    assert all(f"segment={x}" in r.tokens and "query=k11" in r.tokens for r, x in zip(df.collect(), ["good", "bad"] * 40, strict=True))
    mined = u.mine(df)
    assert rules_of(mined) == {(frozenset(["segment=bad"]), True): 1.0, (frozenset(["segment=good"]), False): 1.0}
    assert [r.mined for r in u.match(df, mined).orderBy("url").collect()] == ["segment=bad"] * 40 + ["segment=good"] * 40


def test_thirty_tokens_against_brute_force(spark):
    rng = random.Random(3)
    names = [f"t{i:02}" for i in range(30)]
    rows = []
    for _ in range(300):
        # t00 and the alias always come together; the label needs two or three tokens, with noise.
        own = [t for t in names if rng.random() < (0.75 if t < "t06" else 0.25)]
        own += ["alias"] * ("t00" in own)
        rows.append((own, {"t00", "t01", "t02"} <= set(own) and rng.random() < 0.93 or {"t04", "t05", "t07"} <= set(own)))
    rows += [(names, True)] * 3
    mined = u.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), min_support=0.1, longest=3)
    want = mined_by_hand(rows, 0.1, longest=3)
    assert want and {len(t) for t, _ in want} >= {2, 3}
    assert rules_of(mined) == want


def test_rules_where_most_rows_are_blocked(spark):
    rows = [(["tld=com", f"segment=s{i % 3}"], True) for i in range(240)] + [(["tld=org", "segment=ok"], False)] * 60
    got = rules_of(u.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean")))
    assert (frozenset(["tld=com"]), True) in got and (frozenset(["tld=org"]), False) in got


def test_a_very_long_url(spark, tmp_path):
    long = "http://example.com/" + "/".join(f"p{i}" for i in range(20_000)) + "/"
    spark.createDataFrame([(1, long), (2, "http://example.com/en/1"), (3, "http://example.net/de/1")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.path, r.verdict) for r in u.op5_association_urls(spark, str(tmp_path)).collect()}
    assert got[1][0] == long.removeprefix("http://example.com") and got[2][1] == "block" and got[3][1] == "allow"


def test_a_rule_on_five_tokens(spark):
    """All five tokens are blocked, any four of them allowed: only the longest rule says so."""
    names = [f"x{i}" for i in range(5)]
    rows = [(names, True)] * 50 + [([x for x in names if x != out], False) for out in names for _ in range(10)]
    mined = u.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"))
    assert rules_of(mined) == mined_by_hand(rows, 0.02, longest=5)
    urls = spark.createDataFrame([(1, names), (2, names[:4])], "id long, tokens array<string>")
    assert sorted((r.id, r.mined_blocks) for r in u.match(urls, mined).collect())[0] == (1, True)


def test_long_rules_against_brute_force(spark):
    """Rules of all lengths, redundant ones over gaps of several lengths among them."""
    rng = random.Random(9)
    names = [f"t{i}" for i in range(8)]
    rows = []
    for _ in range(400):
        own = [t for t in names if rng.random() < 0.8]
        rows.append((own, rng.random() < (0.98 if {"t0", "t1", "t2", "t3", "t4", "t5"} <= set(own) else 0.85 if {"t6", "t7"} <= set(own) else 0.1)))
    for gain in (0.0, 0.02, 0.2):
        mined = u.mine(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), min_lift=1.1, gain=gain)
        want = mined_by_hand(rows, 0.02, min_lift=1.1, gain=gain, longest=8)
        assert rules_of(mined) == want and (gain or max(len(t) for t, _ in want) > 4)


def test_equally_sure_rules(spark):
    """A tie goes to the greater support, then to block, then to the rule that sorts first."""
    rules = spark.createDataFrame([(["a"], "a", True, 0.9, 0.2), (["b"], "b", False, 0.9, 0.3), (["c"], "c", False, 0.9, 0.2), (["d"], "d", True, 0.9, 0.2)], "items array<string>, filed string, blocked boolean, confidence double, support double")
    items = spark.createDataFrame([(x, x) for x in "abcd"], "token string, item string")
    urls = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "a"]), (3, ["d", "a"]), (4, ["c", "d"])], "id long, tokens array<string>")
    assert sorted((r.id, r.mined) for r in u.match(urls, u.Rules(items, rules)).collect()) == [(1, "b"), (2, "a"), (3, "a"), (4, "d")]
