import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import hard_negatives as hn

ROWS = "vec_id long, label int, embedding array<double>"


def by_hand(rows, every=100, share=Fraction(4, 5), k=5):
    known = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        if i not in known or (label, list(v)) < known[i]:
            known[i] = (label, list(v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in known.items()}
    out = []
    for a in whole:
        if a % every:
            continue
        label, q = whole[a]
        score = {i: sum(x * y for x, y in zip(q, w, strict=False)) for i, (_, w) in whole.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == label][:k]:
            fits = [i for i in order if whole[i][0] != label and share * score[p] <= score[i] <= score[p]][:k]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits, 1)]
    return Counter(out)


def mined(spark, rows, kind=ROWS, every=100, share=Fraction(4, 5), extra=None, **options):
    frame = spark.createDataFrame(rows, kind)
    old = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (old + 1) % 10).otherwise(old)
    return Counter(map(tuple, hn.mine(hn.usable(frame if extra is None else frame.withColumns(extra), label=label), F.col("vec_id") % every == 0, share=share, **options).collect()))


def gathered(rnd, n, dims, spots):
    """Vectors near some spots, whole blocks of copies among them, with ties."""
    at = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(spots)]
    rows = []
    for i in range(n):
        spot = rnd.randrange(spots)
        rows.append((i, spot % 4, [x + rnd.gauss(0, 0.05) for x in at[spot]] if rnd.random() < 0.7 else [float(x) for x in at[0]]))
    return rows


def test_against_all_pairs(spark):
    rows = gathered(random.Random(1), 1200, 6, 12)
    rows += [(None, 1, [1.0] * 6), (2000, None, [1.0] * 6), (2001, 1, None), (2002, 1, [1.0, None]), (2003, 1, [float("nan")] * 6), (2004, 2, [float("inf")] * 6)]
    rows += [(2100, 2, []), (2101, 2, [0.0] * 6), (2102, 2, [0.5] * 3), (2103, 1, [0.5] * 9), (2200, 1, [0.0] * 6), rows[100], (300, 3, [0.25] * 6), (-100, 1, [-0.1] * 6), (-7, 9, [0.2] * 6)]
    random.Random(2).shuffle(rows)
    expected = by_hand(rows, every=20)
    assert len(expected) > 300
    assert mined(spark, rows, every=20, extra={"score": F.lit("x"), "cluster": F.lit(1), "request": F.lit(0), "norm": F.lit(None).cast("double")}) == expected
    assert mined(spark, rows, every=20, group=7, block=50, cuts=(0.02, 0.2, 1.0), clusters=5) == expected


def test_other_shares_and_numbers(spark):
    rows = gathered(random.Random(3), 300, 4, 5)
    for share in (Fraction(1, 3), Fraction(1), Fraction(0), Fraction(29, 31)):
        assert mined(spark, rows, every=10, share=share) == by_hand(rows, every=10, share=share)
    assert mined(spark, rows, every=10, positives=2, negatives=2) == by_hand(rows, every=10, k=2)


def test_numbers_beyond_double_precision(spark):
    rnd = random.Random(4)
    rows = [(i, i % 2, [rnd.uniform(1, 2) * 2.0**19, 2.0**-8 * rnd.randrange(5)]) for i in range(60)]
    assert mined(spark, rows, every=10) == by_hand(rows, every=10)
    assert np.array_equal(hn.scores(np.array([[hn.LIMIT] * 3]), np.array([[hn.LIMIT] * 3, [-hn.LIMIT] * 3])), [[hn.MOST, hn.LEAST]])


def test_nothing_to_mine(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])])  # no anchor
    assert not mined(spark, [(100, 1, [1.0])])
    assert not mined(spark, [(100, 1, [1.0]), (101, 1, [-1.0]), (102, 2, [-1.0])])  # a negative score of the positive


@pytest.mark.parametrize("same", [True, False])
def test_a_walk_ends_early_and_loses_nothing(same):
    """Vectors gathered around spots: far fewer scores than pairs, and the same results as with all of them."""
    rnd = np.random.default_rng(5)
    at = rnd.normal(size=(30, 16))
    spot = rnd.integers(0, 30, 6000)
    x = np.floor(256 * (at[spot] + 0.02 * rnd.normal(size=(6000, 16))))
    label = rnd.integers(0, 3, 6000)
    index = hn.Index(hn.centres(x[:2000], 30))
    size = hn.norms(x)
    own = index.cosines(x, size).argmax(1)
    first = own == own[0]
    group = np.flatnonzero(first)[:40]
    index.reach = np.full(len(index.centres), np.arccos(index.cosines(x[group], size[group])[:, own[0]].min()) + 1e-7)
    bound = index.bounds(x)[:, own[0]]
    ids = np.arange(6000)
    anchor = {"x": x[group], "norm": size[group], "id": group, "label": label[group]}
    wants = {"at": np.arange(40), "low": np.full(40, hn.LEAST), "high": np.full(40, hn.MOST)}
    request, score, other, computed = hn.walked(anchor, wants, {"x": x, "bound": bound, "id": ids, "label": label}, 5, same, chunk=64)
    assert computed < 0.2 * 40 * 6000
    s = (x[group] @ x.T).astype(int)
    for k, a in enumerate(group):
        fits = [i for i in ids if (label[i] == label[a]) == same and i != a]
        best = sorted(fits, key=lambda i: (-s[k, i], i))[:5]
        assert [(v, i) for r, v, i in zip(request, score, other, strict=True) if r == k] == [(s[k, i], i) for i in best]


def test_bounds_hold():
    rnd = np.random.default_rng(6)
    x = np.floor(256 * rnd.normal(size=(400, 5)))
    x[7] = 0
    index = hn.Index(hn.centres(x, 6))
    size = hn.norms(x)
    cosine = index.cosines(x, size)
    own = cosine.argmax(1)
    index.reach = np.array([np.arccos(cosine[own == c, c].min()) for c in range(len(index.centres))])
    most = size[:, None] * index.bounds(x)[:, own].T
    assert (x @ x.T <= hn._above(most)).all()


def test_vectors_as_rows():
    lists = pa.array([[0.5], [], [1.0, -0.001, 1e300], [2.0]])
    assert hn.matrix(lists).tolist() == [[128, 0, 0], [0, 0, 0], [256, -1, hn.LIMIT], [512, 0, 0]]
    assert hn.matrix(lists.slice(2, 2)).tolist() == [[256, -1, hn.LIMIT], [512, 0, 0]]
