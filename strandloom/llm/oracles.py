"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from itertools import permutations

from .chat import CONTROL, END, PROBE, START
from .quality_rules import N_CLASSES
from .sharding import Tree, tree_of

WHITE = r"[\x20\x09-\x0D]+"


def _words(columns: str, where: str = "true") -> str:
    """A row per word of documents: columns, w, i (from 1)."""
    return f"""SELECT {columns}, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM
 (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '{WHITE}'), lambda x: x <> '') AS ws FROM d WHERE {where})"""


JACCARD = f"""WITH RECURSIVE d AS (SELECT * FROM documents WHERE doc_id IS NOT NULL),
w AS ({_words("doc_id")}),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, i, n, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS s FROM w JOIN n USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE i <= greatest(n - 4, 1)),
k AS (SELECT doc_id, count(*) AS k, md5(string_agg(s, chr(10) ORDER BY s)) AS m FROM g GROUP BY 1),
c AS (SELECT m, min(doc_id) AS rep, count(*) AS copies, any_value(k) AS k FROM k GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id WHERE a.doc_id IN (SELECT rep FROM c) AND b.doc_id IN (SELECT rep FROM c) GROUP BY 1, 2),
e AS (SELECT a, b, y.copies FROM p JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE 10 * shared >= 8 * (x.k + y.k - shared)),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
least AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY 1),
links AS (SELECT a AS rep, sum(copies) AS n FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(c.copies - 1 + coalesce(links.n, 0), 0) AS BIGINT) AS n_links, coalesce(c.copies, 1) AS copies
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (m) LEFT JOIN least USING (rep) LEFT JOIN links USING (rep)
UNION ALL SELECT NULL, NULL, 0, 1 FROM documents WHERE doc_id IS NULL"""

# Character classes as counts of what a pattern leaves of a text.
_LATIN, _LETTERS, _HIGH = r"[\x{80}-\x{24F}]", r"[\x{250}-\x{1FFF}]", r"[\x{2000}-\x{10FFFF}]"
_CLASSES = ["[a-z]", "[A-Z]", "[0-9]", " ", r"[\x09-\x0D]", r"[.,;:''\x22()-]", "[!?]", "[#*$%&|<>]", None, _LATIN, _LETTERS, _HIGH]


def _count(pattern: str, text: str = "t") -> str:
    return f"length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g'))"


_COUNTED = [_count(p) if p else None for p in _CLASSES]
_COUNTED[8] = "length(t) - (" + " + ".join(f"({c})" for c in _COUNTED if c) + ")"
assert len(_COUNTED) == N_CLASSES


def _distance(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2)"
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END) / 2"


RULES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS ({_words("r, lang")}),
per AS (SELECT r, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars FROM w GROUP BY 1),
gram AS (SELECT r, i, hash(w) AS h, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS s, lead(i, 4) OVER o AS last FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM gram WHERE last IS NOT NULL),
again AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) t(k) WHERE n > 1 GROUP BY 1),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT r, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2) GROUP BY 1),
base AS (SELECT r, doc_id, lang, text, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST({_count("[#*$%&|<>]", "text")} AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
 FROM d LEFT JOIN per USING (r) LEFT JOIN dup USING (r) LEFT JOIN again USING (r)),
cc AS (SELECT r, lang, unnest([{", ".join(f"CAST({c} AS BIGINT)" for c in _COUNTED)}]) AS n, unnest(range({N_CLASSES})) AS k FROM (SELECT r, lang, text AS t FROM d)),
cref AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cc WHERE lang IS NOT NULL GROUP BY 1, 2),
langs AS (SELECT DISTINCT lang FROM cref),
cdist AS (SELECT r, b.lang, sqrt(greatest(sum({_distance("p", "q")}), 0)) AS x FROM (SELECT r, k, n / nullif(sum(n) OVER (PARTITION BY r), 0) AS p FROM cc) a JOIN cref b USING (k) WHERE p IS NOT NULL GROUP BY 1, 2),
f AS (SELECT r, lang, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM w),
wall AS (SELECT lang, w, count(*) AS n FROM f WHERE lang IS NOT NULL GROUP BY 1, 2),
wsum AS (SELECT lang, sum(n) AS n FROM wall GROUP BY 1),
common AS (SELECT lang, w, wall.n / wsum.n AS q FROM wall JOIN wsum USING (lang) WHERE wall.n >= 0.01 * wsum.n),
rest AS (SELECT lang, 1 - coalesce(sum(q), 0) AS q FROM langs LEFT JOIN common USING (lang) GROUP BY 1),
own AS (SELECT r, c.lang, c.w, count(*) AS n, any_value(c.q) AS q FROM f JOIN common c ON c.w = f.w GROUP BY 1, 2, 3),
bins AS (SELECT p.r, c.lang, c.q, coalesce(o.n, 0) / p.n_words AS p FROM per p CROSS JOIN common c LEFT JOIN own o ON o.r = p.r AND o.lang = c.lang AND o.w = c.w
 UNION ALL SELECT p.r, rest.lang, rest.q, 1 - coalesce((SELECT sum(n) FROM own o WHERE o.r = p.r AND o.lang = rest.lang), 0) / p.n_words FROM per p CROSS JOIN rest),
wdist AS (SELECT r, lang, sqrt(greatest(sum({_distance("p", "q")}), 0)) AS x FROM bins GROUP BY 1, 2),
far AS (SELECT base.*, langs.lang AS ref, coalesce(cdist.x, 0) AS char_distance, coalesce(wdist.x, 0) AS word_distance,
 row_number() OVER (PARTITION BY base.r ORDER BY CASE WHEN base.lang = langs.lang THEN 0 ELSE 1 END, coalesce(cdist.x, 0) + coalesce(wdist.x, 0), langs.lang) AS best
 FROM base CROSS JOIN langs LEFT JOIN cdist ON cdist.r = base.r AND cdist.lang = langs.lang LEFT JOIN wdist ON wdist.r = base.r AND wdist.lang = langs.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (length(text) >= 120 AND char_distance > 0.28 OR n_words >= 40 AND word_distance > 0.40) AS kept,
 round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM far WHERE best = 1"""


def _place(tree: Tree) -> str:
    """The tree's descent as nested CASE expressions over the column key."""

    def least(children: dict[str, float], then) -> str:
        names = list(children)
        if len(names) == 1:
            return then(names[0])
        draws = {n: f"(-ln((('0x' || substr(md5(key || '/{n}'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / {children[n]!r})" for n in names}
        return "CASE " + " ".join(f"WHEN {draws[n]} <= least({', '.join(draws.values())}) THEN {then(n)}" for n in names) + " END"

    weights: dict[str, dict[str, dict[str, float]]] = {}
    for region, rack, shard, weight in tree:
        weights.setdefault(region, {}).setdefault(rack, {})[f"shard{shard}"] = weight

    def rack_of(region: str) -> str:
        return least({r: sum(s.values()) for r, s in weights[region].items()}, lambda rack: least(weights[region][rack], lambda s: s.removeprefix("shard")))

    return least({g: sum(sum(s.values()) for s in r.values()) for g, r in weights.items()}, rack_of)


_STEPS = "range(256)"
for _ in range(8):
    _STEPS = f"list_transform({_STEPS}, lambda c: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
SHARDS = f"""WITH t AS (SELECT {_STEPS} AS crc_table),
b AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, key, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, v: xor(crc_table[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM b, t),
s AS (SELECT *, CAST({_place(tree_of(16))} AS INT) AS shard, CAST({_place(tree_of(17))} AS INT) AS grown_shard, ('0x' || substr(md5(concat_ws('/', doc_id::VARCHAR, text_crc32::VARCHAR, size::VARCHAR)), 1, 8))::BIGINT AS draw FROM x)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY draw, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s"""

_escaped = "(length({0}) + (length({0}) - length(replace({0}, '\\', ''))) + " + " + ".join("(length({0}) - length(replace({0}, '" + c + "', ''))) // " + str(len(c)) for c in CONTROL) + ")"
CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({len(START) + len(END) + 2} + {_escaped.format("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped.format("text")}) AS BIGINT) AS formatted_chars, false AS rewrites
FROM t GROUP BY conv_id"""

_STEPS_OF_ORDERS = ", ".join(f"('{''.join(o)}', {k + 1}, {1 << 'ABCDE'.index(o[k])}, {sum(1 << 'ABCDE'.index(x) for x in o[:k])})" for o in permutations("ABCDE") for k in range(5))
AUDIT = f"""WITH l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{WHITE}'), lambda x: x <> '') AS ws FROM documents),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
 (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT + 4 * (100 * ({_count("[A-Z]")}) > 10 * length(t))::INT
 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS failed FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
o AS (SELECT * FROM (VALUES {_STEPS_OF_ORDERS}) o(filter_order, step, own, run)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN failed & (run | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed & run = 0 AND failed & own > 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN failed & run > 0 AND failed & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN failed & run = 0 AND failed & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failed & run = 0 AND failed & own > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c CROSS JOIN o GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
 CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""

_FIVE = "('0x' || substr(h, 1 + 5 * i, 5))::INT"
_BASE32 = "list_aggregate(list_transform(range(8), lambda i: " + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({_FIVE} >> {bits}) & 31), 1)" for bits in (15, 10, 5, 0)) + "), 'string_agg', '')"
WARC = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), q AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to, true AS intact FROM q"""

NEGATIVES = """WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, embedding FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, coalesce(CAST(list_sum(list_transform(list_zip(a.q, b.q, true), lambda z: z[1] * z[2])) AS BIGINT), 0) AS score
 FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5"""

ORACLES = {"op1_bayes_jaccard": JACCARD, "op6_divergence_rules": RULES, "op8_hash_tree_shards": SHARDS, "op9_incremental_chat": CHAT, "op11_shared_lists": NEGATIVES, "op12_zip_warc": WARC, "op13_failing_ids": AUDIT}
