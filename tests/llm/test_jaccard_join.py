import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import bloom
from strandloom.llm import jaccard_join as j


def shingles(text):
    w = (text or "").split()
    return {tuple(w)} - {()} if len(w) < j.K else {tuple(w[i : i + j.K]) for i in range(len(w) - j.K + 1)}


def by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]):
                both = len(sets[a] & sets[b])
                if both / (len(sets[a]) + len(sets[b]) - both) >= j.THRESHOLD:
                    links[a].add(b)
    out = []
    for a, (doc_id, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((doc_id, min(rows[x][0] for x in seen) if doc_id is not None else None, len(links[a])))
    return out


def corpus():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(25):
        base = list(rng.choice(vocabulary, 60))
        for _ in range(rng.integers(1, 14)):
            words = list(base)
            for at in rng.choice(60, rng.integers(0, 4), replace=False):
                words[at] = str(rng.choice(vocabulary))
            rows.append(" ".join(words))
    rows += [None, "", "  ", "one two", "one two", "two one", rows[0], rows[0] + " " + rows[0]]
    return [*enumerate(rows), (None, rows[0])]


def test_posterior():
    assert j.least_matches(16, 0.8, 1e-5) < 8 and j.least_matches(80, 0.8, 1e-5) > 40 and j.least_matches(80, 0.8, 0.5) >= 63


def test_classes_and_links_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, rep string")
    for most in (128, 3):  # whole components, and blocks of about three
        got = sorted(((r.doc_id, r.class_id, r.n_links) for r in j.join_classes(docs, widest=most, narrowest=most).collect()), key=str)
        assert got == sorted(by_hand(rows), key=str)
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    heads = {c for _, c, _ in by_hand(rows)} - {None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(heads)


def test_blocks_of_buckets(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = j.sketches(docs).where("key is not null and doc_id is not null").selectExpr("doc_id as rep", "sig")
    one, many = ({frozenset((r.id, r.component)) for r in j.connected_components(j.candidate_edges(drawn, widest=m, narrowest=m)).collect()} for m in (800, 2))
    assert one == many


def test_large_groups_are_joined_as_small_ones(spark):
    rng = np.random.default_rng(8)
    rows = [(a, b) for a, b in corpus() if a is not None]
    base = [f"v{x}" for x in range(80)]
    for _ in range(2 * j.SIDE):  # more than are compared side by side
        words = list(base)
        for at in rng.choice(80, rng.integers(0, 4), replace=False):
            words[at] = f"u{rng.integers(0, 400)}"
        rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(by_hand(rows), key=str)
    for count, most in ((True, 2000), (False, 2000), (False, 3)):
        got = [(r.doc_id, r.class_id, r.n_links) for r in j.classified(docs, widest=most, narrowest=most, count=count).collect()]
        assert sorted((g if count else g[:2] for g in got), key=str) == sorted((w if count else w[:2] for w in want), key=str)


def test_forest_and_shared_sizes():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    a, b = (x.ravel() for x in np.indices((40, 40)))
    a, b = a[a < b], b[a < b]
    want = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)]
    assert j.shared_sizes(sets, a, b).tolist() == want
    few = np.array([0, 300, 700])
    assert j.shared_sizes(sets, a[few], b[few]).tolist() == [want[k] for k in few]
    linked = np.array([[len(np.intersect1d(x, y)) > 12 for y in sets] for x in sets])
    x, y = j.joined(40, lambda k, rows: rows[linked[k][rows]])
    low, whole = j._forest(40, x, y), j._forest(40, *np.nonzero(linked))
    assert (low == whole).all() and len(x) == 40 - len(set(low))


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 9000, 40_000)]
    near = list(base)
    near[::400] = ["new"] * len(near[::400])
    rows = [(1, " ".join(base)), (2, " ".join(near)), (2, " ".join(near)), (3, "a b c d e f"), (3, "a b c d e f"), (4, ""), (4, ""), (None, "a b c d e f"), (5, "a b c d e f")]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, _again string, row string, tkey long")
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in j.join_classes(docs).collect()), key=str) == sorted(by_hand([r for r in rows]), key=str)
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert j.join_classes(docs).count() == 0 and j.keep_one(docs).count() == 0


def test_pivots_join_what_all_pairs_join(spark):
    """Large buckets and components: near copies of two texts, chains that leave the pivot behind, and rows that link to a joined row only."""
    rng = np.random.default_rng(12)
    rows = []
    for g in range(2):
        base = [f"g{g}v{x}" for x in range(70)]
        for _ in range(60):
            words = list(base)
            for at in rng.choice(70, rng.integers(0, 4), replace=False):
                words[at] = f"u{rng.integers(0, 300)}"
            rows.append(" ".join(words))
    words = [f"c{x}" for x in range(80)]
    for k in range(40):  # each a little further from the first
        words[(2 * k) % 80] = f"d{k}"
        rows.append(" ".join(words))
    rng.shuffle(rows)
    numbered = list(enumerate(rows))
    docs = spark.createDataFrame(numbered, "doc_id long, text string")
    want = sorted((a, c) for a, c, _ in by_hand(numbered))
    for most in (5, 30):
        assert sorted((r.doc_id, r.class_id) for r in j.classified(docs, widest=most, narrowest=most, count=False).collect()) == want
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in j.join_classes(docs, widest=most, narrowest=most).collect()) == sorted(by_hand(numbered))


def test_the_filter_tests_alike_in_expressions_and_in_tasks(spark):
    rng = np.random.default_rng(13)
    known, asked = (rng.integers(-(1 << 63), (1 << 63) - 1, n) for n in (700, 5000))
    table = bloom.built(spark.createDataFrame([(int(x),) for x in known], "h long"))
    rows = spark.createDataFrame([(int(x), "k") for x in [*known, *asked]], "h long, _bloom string")
    want = bloom.inside(np.concatenate([known, asked]).view(np.uint64), table)
    got = bloom.passing(rows, F.col("h"), table)
    assert got.columns == rows.columns and got.count() == want.sum() and want[:700].all() and want.sum() < 900
    assert bloom.passing(rows, F.col("h"), table, False).count() == (~want).sum()
