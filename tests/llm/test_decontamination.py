import re

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import decontamination as d


def by_hand(p, t, shortest):
    """Greedy string tiling as first published: words covered in the pattern."""
    mp, mt, total = set(), set(), 0
    while True:
        best = []
        longest = shortest
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and i + k not in mp and j + k not in mt:
                    k += 1
                if k > longest:
                    best, longest = [(i, j)], k
                elif k == longest:
                    best.append((i, j))
        if not best:
            return total
        for i, j in best:
            if not any(i + k in mp or j + k in mt for k in range(longest)):
                mp |= set(range(i, i + longest))
                mt |= set(range(j, j + longest))
                total += longest


@given(st.lists(st.integers(1, 4), max_size=14), st.lists(st.integers(1, 4), max_size=20), st.integers(1, 3))
@settings(max_examples=300, deadline=None)
def test_tiles_as_by_hand(p, t, shortest):
    found = d.tiles(np.array(p, np.uint64), np.array(t, np.uint64), shortest)
    assert sum(s for *_, s in found) == by_hand(p, t, shortest)
    for a, b, s in found:
        assert s >= shortest and p[a : a + s] == t[b : b + s]
    assert len({x for a, _, s in found for x in range(a, a + s)}) == len({x for _, b, s in found for x in range(b, b + s)}) == sum(s for *_, s in found)


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(6)] + [(6, None), (7, "Éa b!"), (8, "")]
    docs = []
    for k in range(60):
        words = list(rng.choice(vocabulary, 30))
        if k % 2:
            item = items[k % 6][1].split()
            parts = [item[6:], item[:6]] if k % 4 == 1 else [item[: 5 + k % 8]]
            for part in parts:
                words[5:5] = part
        docs.append((k, " ".join(words).upper() if k % 5 == 0 else ", ".join(words), 1))
    docs += [(100, None, 1), (101, "", 1), (102, "x éA B y", 1), (1, docs[1][1], 1)]
    spark.createDataFrame(docs, "doc_id long, text string, item_id int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.doc_id, r.item_id, round(r.coverage, 6)) for r in d.op10_string_tiling(spark, str(tmp_path)).collect())
    want = []
    for doc_id, text, _ in docs:
        for item_id, item in items:
            p, t = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (item, text))
            if p and (c := by_hand(p, t, min(5, len(p))) / len(p)) >= 0.5:
                want.append((doc_id, item_id, round(c, 6)))
    assert got == sorted(want) and any(c < 1 for *_, c in got)
    whole = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = d.decontaminate(whole, spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    assert kept.columns == whole.columns and {r.doc_id for r in kept.collect()} == {x[0] for x in docs} - {w[0] for w in want}


def words_of(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").casefold())


def test_words_of_any_script_against_brute_force(spark):
    items = [(1, "the river “ran” quietly past our old mill"), (2, "ПРИВЕТ Мир это строка для ПРОВЕРКИ слов"), (3, "Σοφός ΟΔΟΣ καλός άνθρωπος και φίλος όλων"), (4, "Straße über GROẞE Flüsse im İstanbul Tal")]
    docs = [
        (1, "x the\u00a0“river” ‘ran’\u2003quietly — past\u00a0our «old» mill. y"),
        (2, "а привет, МИР! ЭТО строка… Для\u00a0проверки слов б"),
        (3, "σοφόσ οδος ΚΑΛΌΣ ΆΝΘΡΩΠΟΣ ΚΑΙ φίλος; ΌΛΩΝ"),
        (4, "STRASSE ÜBER große flüsse IM i\u0307stanbul TAL"),
        (5, "theriver ran quietly"), (6, "приветмир это"), (7, "the river ran quietly, but nothing else of it"),
    ]
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(i, k): c for i, t in docs for k, x in items if (c := by_hand(words_of(x), words_of(t), 5) / len(words_of(x))) >= 0.5}
    assert {(r.doc_id, r.item_id): r.coverage for r in got} == want and {(k, k) for k in (1, 2, 3, 4)} == set(want)


def test_runs_whose_hashes_agree_are_compared(monkeypatch):
    d._points()  # cached with its own hashes
    monkeypatch.setattr(d, "mix", lambda x: np.zeros_like(x))
    assert d.tiles(np.array([1, 2, 3], np.uint64), np.array([3, 1, 2], np.uint64), 2) == [(0, 1, 2)]
    assert d.tiles(np.array([1, 2], np.uint64), np.array([3, 4], np.uint64), 1) == []


def test_long_texts_many_copies_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    words = [f"v{x}" for x in rng.integers(0, 5000, 60_000)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = " ".join(words[:30_000]) + " " + item + " " + " ".join(words[30_000:])
    rows = [(1, long, "a", "b"), (2, " ".join(words), "a", "b")] + [(3 + i % 50, "intro " + item, "a", "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, _fragment string")
    bench = spark.createDataFrame([(1, item), (2, item.upper()), (3, " ".join(words[100:112]))], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect())
    assert found == sorted([(1, 1), (1, 2), (1, 3), (2, 3)] + [(3 + i % 50, k) for i in range(200) for k in (1, 2)])
    kept = d.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]


def test_frequent_seeds_left_out_lose_no_pair(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["a", "b", "c"]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 25)))) for i in range(25)]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 40)))) for i in range(40)]
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), coverage=0.7).collect()
    want = {(i, k) for i, t in docs for k, x in items if by_hand(x.split(), t.split(), min(5, len(x.split()))) >= 0.7 * len(x.split())}
    assert {(r.doc_id, r.item_id) for r in got} == want and want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs, items).count() == 0 and d.decontaminate(docs, items).count() == 0
    assert d.contaminated(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).count() == 0
