"""Queries over small tables, against plain Python: no row, step or letter may be left out."""

import glob
import random
from collections import Counter
from datetime import date

from strandloom.functions.sequences import CODONS
from strandloom.operators import architectures as R
from strandloom.plans import files
from strandloom.plans.queries import QUERIES


def rows(df):
    return Counter(tuple(r) for r in df.collect())


TEXTS = [(1, "a", "Tah " * 40 + "gc, t!"), (2, "a", "acg"), (3, "b", "T"), (4, "b", "c-Gh" * 33), (5, "c", ""), (6, "d", "xyz" * 9)]


def letters(text):
    return "".join("ACGT"[(ord(x) - 97) % 4] for x in text.lower() if "a" <= x <= "z")


def documents(spark, folder):
    spark.createDataFrame(TEXTS, "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_residues_of_whole_and_short_sequences(spark, tmp_path):
    d = documents(spark, tmp_path)
    nodes = [("abcd".index(f) + 1, i, k, x) for i, f, t in TEXTS for k, x in enumerate(letters(t)) if x != "T"]
    assert rows(QUERIES["msa_nodes"](spark, d)) == Counter(nodes)
    counts = Counter((g, k, x) for g, _, k, x in nodes)
    assert rows(QUERIES["seq_node_coverage"](spark, d)) == Counter((*c, 1, n) for c, n in counts.items())
    pairs = Counter((a[0], a[2], a[3], b[2], b[3]) for a, b in zip(nodes, nodes[1:]) if a[1] == b[1])
    assert rows(QUERIES["seq_edge_coverage"](spark, d)) == Counter((*c, n) for c, n in pairs.items())


PARTS = [(i, f"Brand#{i % 3}", f"part {i}", "x" * (10 + i % 5), 1 + i * 7 % 50) for i in range(1, 120)]
LINES = [(o, k, (o * o + 5 * k * o + k) % 119 + 1, "OF"[(o + k) % 2]) for o in range(1, 25) for k in range(1, 1 + o % 8)]


def orders(spark, folder):
    spark.createDataFrame(PARTS, "p_partkey long, p_brand string, p_name string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    lines = [(o, k, p, 1, 1.0, date(2020, 1, 1), 1.0, 0.0, 0.0, s) for o, k, p, s in LINES]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date, l_quantity double, l_discount double, l_tax double, l_linestatus string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(o,) for o in range(1, 25)], "o_orderkey long").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def steps_of():
    """name -> [(id, ori)]"""
    out = {}
    for o, _, p, s in sorted(LINES):
        kind = PARTS[p - 1][3]
        out.setdefault(f"r{o}", []).append((len(kind) + ord("x") % 7, "+" if s == "O" else "-"))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def norm(a, b):
    return min(edits(a, b), edits(a, b[::-1]), edits(a[::-1], b), edits(a[::-1], b[::-1])) / min(len(a), len(b)) if set(a) & set(b) else 1.0


def test_distances_of_paths_of_any_length(spark, tmp_path):
    d = orders(spark, tmp_path)
    named = dict(enumerate(sorted({tuple(i for i, _ in p) for p in steps_of().values()}, key=lambda x: ",".join(map(str, x)))))
    assert {1, 2, 5, 7} <= {len(x) for x in named.values()}
    pairs = [(a, b) for a in named if a % 20 == 0 for b in named if a != b]
    assert rows(QUERIES["path_edit_distance"](spark, d)) == Counter((a, b, edits(named[a], named[b])) for a, b in pairs)
    far = {(a, b): round(norm(named[a], named[b]), 6) for a, b in pairs}
    assert rows(QUERIES["path_norm_distance"](spark, d)) == Counter((*p, x) for p, x in far.items())
    whole = far | {(a, a): 0.0 for a in named if a % 20 == 0}
    assert rows(QUERIES["path_distance_matrix"](spark, d)) == Counter((*p, x) for p, x in whole.items())


def test_distances_in_many_blocks(spark, monkeypatch):
    rng = random.Random(4)
    named = {k: [rng.randrange(30) for _ in range(rng.randrange(1, 12))] for k in range(60)}
    monkeypatch.setattr(R, "BLOCK", 7)
    monkeypatch.setattr(R, "CELLS", 100)
    got = R.path_distances(spark.createDataFrame(list(named.items()), "id long, ids array<int>"))
    want = {(a, b): (edits(named[a], named[b]), round(norm(named[a], named[b]), 9)) for a in named for b in named if a < b}
    assert {(r.a, r.b): (r.edits, round(r.distance, 9)) for r in got.collect()} == want and got.count() == len(want)
    whole = spark.createDataFrame(list(named.items()), "id long, ids array<int>")
    some = R.path_distances(whole, whole.where("id % 20 = 0"))
    want = {(a, b): (edits(named[a], named[b]), round(norm(named[a], named[b]), 9)) for a in (0, 20, 40) for b in named if a != b}
    assert {(r.a, r.b): (r.edits, round(r.distance, 9)) for r in some.collect()} == want and some.count() == len(want)
    matrix = {(r.a, r.b): r.distance for r in R.distance_matrix(got, whole).collect()}
    assert len(matrix) == 60 * 60 and all(matrix[b, a] == x and (a != b or x == 0) for (a, b), x in matrix.items())


def test_labels_of_every_path(spark, tmp_path):
    want = Counter()
    for name, path in steps_of().items():
        for k in range(1, len(path)):
            want[name, str(path[k - 1][0]), str(path[k][0]) + (path[k][1] if k == len(path) - 1 else "")] += 1
    got = QUERIES["generate_labels"](spark, orders(spark, tmp_path))
    assert rows(got.select("name", "source", "target")) == want and len({n for n, _, _ in want}) > 3


def genes_of():
    """id -> (ref, gstart, gend, ori)"""
    slot, out = Counter(), {}
    for i, ref, _, _, size in PARTS:
        at = slot[ref] * 60
        out[i], slot[ref] = (ref, at, at + 20 + size, "-+"[i % 2 == 0]), slot[ref] + 1
    return out


def inside(genes, ref, start, end):
    """Genes that reach into a span, without those at its ends that are covered by less than half."""
    found = sorted((a, b, i) for i, (r, a, b, _) in genes.items() if r == ref and a < end and b > start)
    poor = {(a, b, i) for a, b, i in {found[0], found[-1]} if (min(end, b) - max(start, a)) / (b - a + 1) < 0.5} if found else set()
    return [i for a, b, i in found if (a, b, i) not in poor]


def test_anchors_and_windows_of_every_gene(spark, tmp_path):
    d, genes = orders(spark, tmp_path), genes_of()
    want, same = Counter(), Counter()
    for i, (ref, a, _, _) in genes.items():
        if i + 25 not in genes or genes[i + 25][0] == ref:
            continue
        other, b = genes[i + 25][:2]
        for q in inside(genes, ref, a, a + 200):
            ps, pe = (int(210 * (x - a) / 200 + b) for x in genes[q][1:3])
            hits = inside(genes, other, ps, pe)
            want.update((i, q, g) for g in hits)
            same.update((i, q, g) for g in hits if all(genes[x][3] == genes[q][3] for x in hits))
    assert len({i for i, _, _ in want}) > 50
    assert rows(QUERIES["syntenic_anchors"](spark, d)) == want
    assert rows(QUERIES["syntenic_anchors_same_ori"](spark, d)) == same
    windows = {(r, a, a + 300) for r, a, _, _ in genes.values()}
    held = [(i, r, a, b, w, e) for i, (r, a, b, _) in genes.items() for x, w, e in windows if x == r and w <= a and e + 1 >= b]
    assert rows(QUERIES["gff_contained"](spark, d)) == Counter((i, r, w, e) for i, r, _, _, w, e in held)
    assert rows(QUERIES["gff_contained_normalized"](spark, d)) == Counter((i, f"{r}_{w}_{e}", a - w, b - w) for i, r, a, b, w, e in held)


def test_whole_sequences_genes_and_windows(spark, tmp_path):
    d, seqs = documents(spark, tmp_path), {i: letters(t) for i, _, t in TEXTS}
    spark.createDataFrame([(i,) for i in seqs], "doc_id long").write.parquet(f"{d}/labels.parquet")
    assert rows(QUERIES["family_sequences"](spark, d)) == Counter((i % 7, i, len(x), x) for i, x in seqs.items())
    windows = [(i, k, (x + x)[k : k + min(25, len(x))]) for i, x in seqs.items() for k in range(0, len(x), 25)]
    assert rows(QUERIES["fetch_subsequences"](spark, d)) == Counter(windows)
    genes = Counter()
    for i, x in seqs.items():
        cuts = sorted({0, *range(i % 40, max(len(x), i % 40), 90)} - {len(x)})
        for a, b in zip(cuts, [*cuts[1:], len(x)]):
            fna = x[a:b]
            read = fna if i % 2 == 0 else fna[::-1].translate(str.maketrans("ACGT", "TGCA"))
            genes[f"{i}_{a}", fna, "".join(CODONS[read[k : k + 3]] for k in range(0, len(read) - 2, 3)).replace("_", "")] += 1
    assert rows(QUERIES["extract_genes"](spark, d)) == genes
    assert sum(len(x) for _, x, _ in genes) == sum(map(len, seqs.values()))


def test_all_names_of_an_architecture(spark, tmp_path):
    d = orders(spark, tmp_path)
    shown = {r.id: (r.n, r.first_name) for r in QUERIES["path_architectures"](spark, d).collect()}
    named = {}
    for r in QUERIES["path_architecture_names"](spark, d).collect():
        named.setdefault(r.id, []).append(r.name)
    assert {k: (len(x), min(x)) for k, x in named.items()} == shown
    assert sorted(x for names in named.values() for x in names) == sorted(steps_of())
    (tmp_path / "x.gfa").write_text("H\tx\nS\t1\t\tFC:i:4\nS\t2\t\tFC:i:3\nL\t1\t+\t2\t+\t\tFC:i:2\nL\t2\t+\t1\t+\t\tFC:i:1\nP\tb\t1+,2+\t9\nP\ta\t2-,1-\t9\nP\tc\t1+\t9\nP\td\t1+,2+\t3\n")
    files.path_metrics(spark, f"{tmp_path}/x.gfa", f"{tmp_path}/out", min_length=5)
    got = [x for f in sorted(glob.glob(f"{tmp_path}/out/architectures/part-*")) for x in open(f).read().splitlines()]
    assert got == ["ID\tPath\tSingleOri\tCount\tNames", "0\t1+,2+\t0\t2\ta,b", "1\t1+\t0\t1\tc"]
