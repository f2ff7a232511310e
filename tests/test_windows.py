"""Windows, numbers and pairs against plain folds over random rows."""

import random
from itertools import combinations

import pytest

from strandloom import storage
from strandloom.operators import alignments as A
from strandloom.operators import architectures as R
from strandloom.operators.numbering import number_rows


def alignments(rng, reads=40, most=14):
    """line_no -> (qname, qstart, qend, ori, rname, rstart, rend), with short ones and ties."""
    out = {}
    for r in range(reads):
        for _ in range(rng.randrange(1, most)):
            a, b = rng.randrange(0, 600), rng.randrange(0, 900)
            size = rng.choice([20, 60, 99, 100, 101, 150, 300, 500])
            out[len(out)] = (f"q{r}", a, a + size, rng.choice("+-"), f"s{rng.randrange(2)}", b, b + size)
    return out


def folded(rows, m):
    """line_no -> cluster: the members of the current cluster decide."""
    out = {}
    for read in {v[0] for v in rows.values()}:
        cluster, members = -1, []
        for k, v in sorted(((k, v) for k, v in rows.items() if v[0] == read), key=lambda x: (x[1][1], x[1][2], -x[0])):
            if not any(min(v[2], e) - max(v[1], s) >= m for s, e in members):
                cluster, members = cluster + 1, []
            members.append((v[1], v[2]))
            out[k] = cluster
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "line_no long, qname string, qstart int, qend int, ori string, rname string, rstart int, rend int")


@pytest.mark.parametrize("m", [1, 100, 250])
def test_clusters_as_folded(spark, m):
    rows = alignments(random.Random(m))
    got = {r.line_no: r.cluster for r in A.multimap_clusters(frame(spark, rows), m).collect()}
    assert got == folded(rows, m) and len(set(got.values())) > 2


def grid_by_hand(rows, m, reach):
    out = []
    clusters = {}
    for k, c in folded(rows, m).items():
        clusters.setdefault((rows[k][0], c), []).append(k)
    for (read, c), own in clusters.items():
        if len(own) == 1:
            _, a, b, ori, ref, s, e = rows[own[0]]
            out.append((read, c, a, b, own[0], ori, ref, s, e, 1))
            continue
        values = sorted(x for k in own for x in rows[k][1:3])
        groups = [[values[0]]]
        for x in values[1:]:
            if x - groups[-1][-1] <= reach:
                groups[-1].append(x)
            else:
                groups.append([x])
        mean = {x: sum(g) // len(g) for g in groups for x in g}
        points = sorted(set(mean.values()))
        for a, b in zip(points, points[1:]):
            inside = [k for k in own if min(mean[rows[k][2]], b) - max(mean[rows[k][1]], a) > 0]
            for k in inside:
                _, qs, qe, ori, ref, s, e = rows[k]
                out.append((read, c, a, b, k, ori, ref, *(int((e - s) * (x - qs) / (qe - qs) + s) for x in (a, b)), len(inside)))
    return sorted(out)


def test_grid_as_by_hand(spark):
    rows = alignments(random.Random(9))
    for reach in (0, 30, 100):
        got = A.multimap_intervals(frame(spark, rows), 100, reach).select("qname", "cluster", "istart", "iend", "line_no", "ori", "rname", "rstart", "rend", "n_aln")
        assert sorted(map(tuple, got.collect())) == grid_by_hand(rows, 100, reach)


def test_regions_chained_over_bins(spark):
    rng = random.Random(4)
    spans = [(f"s{rng.randrange(2)}", a, a + rng.choice([1, 5, 20, 200])) for a in (rng.randrange(0, 3000) for _ in range(200))] + [("s0", 7, 7), ("s0", 7, 7)]
    want = [("s0", 7, 7)]
    for ref in ("s0", "s1"):
        chain = None
        for _, a, b in sorted(x for x in spans if x[0] == ref and x[1] < x[2]):
            if chain and chain[1] > a:
                chain[1] = max(chain[1], b)
            else:
                chain = [a, b]
                want.append((ref, chain))
    want = sorted((r, *c) if isinstance(c[0], int) else (r, *c) for r, *c in [(w[0], *w[1]) if isinstance(w[1], list) else w for w in want])
    for width in (8, 64, 1 << 14):
        got = A.canonical_regions(spark.createDataFrame(spans, "rname string, rstart int, rend int"), width=width)
        assert sorted(map(tuple, got.collect())) == want


def test_numbers_within_groups_and_of_equal_rows(spark):
    rows = [(g, x % 5) for g in ("a", "b", None) for x in range(300)] + [("c", 1)] * 2000
    got = number_rows(spark.createDataFrame(rows, "g string, x int").repartition(5), ["x"], "n", within=("g",)).collect()
    assert len(got) == len(rows)
    for g in ("a", "b", "c", None):
        mine = sorted((r.n, r.x) for r in got if r.g == g)
        assert [n for n, _ in mine] == list(range(len(mine))) and [x for _, x in mine] == sorted(x for _, x in mine)


def test_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)
    names = [f"n{k:02}" for k in range(40)]
    got = R.all_pairwise(spark.createDataFrame([(n,) for n in names * 2], "name string"), "name")
    assert sorted(map(tuple, got.collect())) == list(combinations(names, 2))
    assert R.all_pairwise(spark.createDataFrame([], "name string"), "name").count() == 0


def test_released_tables_are_gone(spark):
    table = storage.materialize(spark.range(5))
    assert table.count() == 5
    storage.release(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist|NOT_EXIST"):
        spark.read.parquet(table.table_path).count()


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_small_tables_are_spread(spark):
    assert storage.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(9)
    assert storage.spread(many).rdd.getNumPartitions() == 9
