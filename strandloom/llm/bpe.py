"""Byte-level BPE by published ranks: encoding with offsets, and decoding.

Pre-tokenisation follows the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
without running a regular expression over the text. Every code point gets a class (letter, number,
other, space). Read left to right, the pattern is an automaton whose step on a code point is either
constant (a class change, which starts a run wherever the automaton was) or the identity (the run
goes on); such functions compose associatively, "the last constant wins", so one prefix scan
(``maximum.accumulate`` over the places of the constants) gives each code point its run, and one
suffix scan each white space the end of its run. Boundaries follow from runs and their neighbours.

The slices between boundaries go through pair merging, cached by slice. Offsets of tokens in the
text's bytes are kept, so that tokens can be traced back; decoding compares them with the tokens' sizes.

Defined results: null counts as empty; an empty text has no tokens and decodes to no bytes; a very long text is
encoded whole, as is a very long slice of it; of equally low pairs the first is merged first; repeated rows are
encoded each on its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread
from .text import Texts, give_back, members, slices, spans_hash

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
CACHE_SLICES, CACHE_BYTES, SHORT = 200_000, 48, 64


@lru_cache(1)
def point_classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the regex module."""
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[members(pattern)] = kind
    return out


def boundaries(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where slices start and end, and the text each one is in."""
    if not len(texts.data):
        return (np.zeros(0, np.int64),) * 3
    lead = np.flatnonzero((texts.data & 0xC0) != 0x80)
    points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    kind = point_classes()[points]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(lead, texts.offsets)] = True
    new = first[:-1].copy()  # constant steps: the run starts here, whatever came before
    new[1:] |= kind[1:] != kind[:-1]
    place = np.arange(n)
    white = kind == SPACE
    start = new & ~white
    # A run that follows a blank takes the blank as its own first code point.
    blank = np.zeros(n, bool)
    blank[:-1] = (points[:-1] == 0x20) & start[1:] & ~first[1:-1]
    joined = np.zeros(n, bool)
    joined[1:] = blank[:-1]
    # Prefix scan: the place of the last constant step is the start of the run that each code point is in.
    run = np.maximum.accumulate(np.where(new, place, 0))
    # Of white space before other text, the last code point stands alone or joins what follows; the rest is one slice.
    before_text = np.zeros(n, bool)
    before_text[:-1] = white[:-1] & ~white[1:] & ~first[1:-1]
    cut = (new & white) | before_text | (start & ~joined)
    # Contractions: an apostrophe that starts its slice and a following ending.
    quote = np.flatnonzero(start & ~joined & (points == 0x27))
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        alone = np.concatenate([first, np.ones(2, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        in1, in2 = ~alone[quote + 1], ~alone[quote + 1] & ~alone[quote + 2]
        single = in1 & np.isin(one, [ord(c) for c in "stmd"])
        double = in2 & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        # The letters' run starts right after a quote that is a run of one code point only.
        single &= run[np.minimum(quote + 1, n - 1)] == quote + 1
        double &= run[np.minimum(quote + 1, n - 1)] == quote + 1
        ends = np.concatenate([quote[single] + 2, quote[double] + 3])
        cut[np.concatenate([quote[single], quote[double]]) + 1] = False
        ends = ends[ends < n]
        # What stands after the ending starts a slice, unless it starts one of its own already or is a blank handled above.
        cut[ends[kind[ends] == LETTER]] = True
    at = lead[cut]
    return at, np.append(at[1:], len(texts.data)), np.searchsorted(texts.offsets, at, side="right") - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merges the adjacent pair of lowest rank (the first of equals) until none is left."""
    if piece in ranks:
        return (ranks[piece],)
    cuts = _cuts(piece, ranks) if len(piece) <= SHORT else _cuts_heap(piece, ranks)
    return tuple([ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])])  # noqa: B905


def _cuts(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Bounds of the tokens of a short slice: the lowest pair is looked for anew after each merge."""
    get, none = ranks.get, len(ranks)
    cuts = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
    return cuts


def _cuts_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a long slice, in n log n steps."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once merged away
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, m, e = heapq.heappop(heap)
        if end[i] != m or m >= n or end[m] != e:
            continue
        end[i], end[m] = e, 0
        if e < n:
            prev[e] = i
            if (r := ranks.get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, e, end[e]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, i, e))
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(end[cuts[-1]])
    return cuts


class _Cache(dict):
    """Token ids by slice; bounded in slices and in the length of a slice."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = merge(piece, self.ranks)
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_SLICES:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(2)
def _coder(path: str) -> tuple[_Cache, np.ndarray, np.ndarray, np.ndarray]:
    """The cache, and all tokens' bytes with their offsets and sizes, once per worker."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    size = np.array([len(t) for t in tokens], np.int64)
    return _Cache(ranks), np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for size[0] values, then the same for the next."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def distinct(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each group of equal slices, and each slice's group. Grouped by hash, then compared byte by byte."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, kind = np.unique(spans_hash(data, start, stop), return_index=True, return_inverse=True)
    size = stop - start
    head = first[kind]
    if (size == size[head]).all() and (data[_ranges(start, size)] == data[_ranges(start[head], size)]).all():
        return first, kind
    return np.arange(len(start)), np.arange(len(start))  # two slices share a hash: each stands for itself


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, ids, ends): ids of a text's tokens, and where each ends in the text's bytes. The cache lives as long as a task."""
    cache, _, _, size = _coder(path)
    for batch in batches:
        for a, b, texts in slices(batch.column(1), 1 << 20):
            start, stop, doc = boundaries(texts)
            first, kind = distinct(texts.data, start, stop)
            data = texts.data.tobytes()
            found = [cache[data[i:j]] for i, j in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
            own = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(own.sum()))
            count = own[kind]
            ids = flat[_ranges((np.cumsum(own) - own)[kind], count)]
            per_doc = np.bincount(doc, weights=count, minlength=texts.n).astype(np.int64) if len(doc) else np.zeros(texts.n, np.int64)
            offsets = np.concatenate([[0], np.cumsum(per_doc)])
            ends = np.cumsum(size[ids]) - np.repeat(texts.offsets[:-1], per_doc)
            off = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(off, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(off, pa.array(ends, pa.int32()))], ["doc_id", "ids", "ends"])
    cache.clear()
    give_back()


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, ends) to (doc_id, ids, bytes). Offsets that do not fit the tokens are an error; without the column ends, none are compared."""
    _, body, at, size = _coder(path)
    for batch in batches:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy()[offsets[0] : offsets[-1]]
        n = size[ids]
        cum = np.concatenate([[0], np.cumsum(n)])
        bounds = cum[offsets - offsets[0]]
        if batch.num_columns > 2:
            ends = batch.column(2)
            held = ends.values.to_numpy()[ends.offsets[0].as_py() : ends.offsets[-1].as_py()]
            if not np.array_equal(held, cum[1:] - np.repeat(bounds[:-1], np.diff(offsets))):
                raise ValueError("offsets do not fit the tokens")
        data = body[np.repeat(at[ids] - cum[:-1], n) + np.arange(cum[-1])]
        text = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, text], ["doc_id", "ids", "bytes"])


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, ends of every row of docs."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: encode_batches(it, path), "doc_id bigint, ids array<int>, ends array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes of every row of tokens (doc_id, ids and, if its offsets are to be compared with the tokens, ends)."""

    def run(batches):
        for batch in decode_batches(batches, path):
            yield batch.select(["doc_id", "bytes"])

    return tokens.select("doc_id", "ids", *(["ends"] if "ends" in tokens.columns else [])).mapInArrow(run, "doc_id bigint, bytes binary")


def encode_and_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, ends of every row of docs, and decoded_sha256, the digest of what they decode to, by their offsets too."""

    def run(batches):
        for batch in encode_batches(batches, path):
            (decoded,) = decode_batches(iter([batch]), path)
            data = Texts.of(decoded.column(2))
            digest = [hashlib.sha256(data.data[i:j]).hexdigest() for i, j in pairwise(data.offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest, pa.string())], [*batch.schema.names, "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, ends array<int>, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every row and decodes it again, by its offsets too, in one pass: digests of ids and of the decoded bytes."""

    def digest(batches):
        for batch in decode_batches(encode_batches(batches, path), path):
            lists, data = batch.column(1), Texts.of(batch.column(2))
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy().astype("<u4")
            hashed = [hashlib.sha256(ids[i:j]).hexdigest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            decoded = [hashlib.sha256(data.data[i:j]).hexdigest() for i, j in zip(data.offsets[:-1], data.offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return round_trip(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), ranks_path())
