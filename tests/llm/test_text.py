import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import text as X
from strandloom.llm.jaccard_join import shingle_sets

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t 😀", max_size=12)), max_size=6)
WORD = r"[^\x20\x09-\x0D]+"


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_and_lines(texts):
    t = X.Texts.of(pa.array(texts, pa.string()))
    words = t.words()
    got = [(d, t.data[a:b].tobytes().decode()) for d, a, b in zip(words.doc, words.start, words.end, strict=True)]
    want = [(i, w) for i, x in enumerate(texts) for w in re.findall(WORD, x or "")]
    assert got == want and words.per_doc.tolist() == [len(re.findall(WORD, x or "")) for x in texts]
    hashes = dict(zip([w for _, w in got], words.hashes().tolist(), strict=True))
    assert len(set(hashes.values())) == len(hashes) and all(hashes[w] == h for (_, w), h in zip(got, words.hashes().tolist(), strict=True))
    start, end, doc = X.lines(t)
    assert [(d, t.data[a:b].tobytes().decode()) for a, b, d in zip(start, end, doc, strict=True)] == [(i, y) for i, x in enumerate(texts) for y in (x or "").split("\n") if y]
    points, offsets = X.code_points(t)
    assert ["".join(map(chr, points[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [x or "" for x in texts]


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3)), max_size=20))
@settings(max_examples=200, deadline=None)
def test_repeated_within_a_text(rows):
    rows.sort(key=lambda r: r[0])
    doc, keys = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint64)
    twice, later = X.repeated(keys, doc)
    assert twice.tolist() == [rows.count(r) > 1 for r in rows] and later.tolist() == [r in rows[:i] for i, r in enumerate(rows)]


@given(TEXTS, st.integers(1, 20), st.integers(1, 3))
@settings(max_examples=100, deadline=None)
def test_slices_cover_all_rows_once(texts, limit, rows):
    column = pa.array([None, *texts], pa.string()).slice(1)
    seen = [(a, b, [t.text(i).decode() for i in range(t.n)]) for a, b, t in X.slices(column, limit, rows)]
    assert [x for *_, part in seen for x in part] == [x or "" for x in texts]
    assert [a for a, *_ in seen] == [0, *(b for _, b, _ in seen)][: len(seen)] and all(b - a <= rows for a, b, _ in seen)


@given(st.lists(st.text(alphabet="abc ", max_size=30), max_size=4))
@settings(max_examples=200, deadline=None)
def test_shingle_sets(texts):
    grams, offsets = shingle_sets(X.Texts.of(pa.array(texts, pa.string())))
    for x, n in zip(texts, np.diff(offsets), strict=True):
        w = x.split()
        assert n == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else bool(w))
    by_set = {}
    for x, s in zip(texts, np.split(grams, offsets[1:-1]), strict=True) if texts else []:
        w = x.split()
        key = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        assert by_set.setdefault(key, set(s.tolist())) == set(s.tolist())
