"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

VIEWS = {
    "genes": """SELECT CAST(p_partkey AS INT) AS id, p_brand AS ref,
 CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) * 60 AS INT) AS gstart,
 CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) * 60 + 20 + p_size AS INT) AS gend,
 CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS ori, p_name AS description, concat('P', CAST(p_partkey AS VARCHAR)) AS gene_id FROM part""",
    "aln": """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS line_no,
 concat('r', CAST(l_orderkey AS VARCHAR)) AS qname, 1300 AS query_length,
 CAST((l_linenumber - 1) * 150 + l_partkey % 50 AS INT) AS qstart,
 CAST((l_linenumber - 1) * 150 + l_partkey % 50 + 100 + CAST(l_quantity AS INT) * 4 AS INT) AS qend,
 CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS ori, g.ref AS rname,
 CAST(greatest(0, g.gstart - l_suppkey % 40) AS INT) AS rstart,
 CAST(greatest(0, g.gstart - l_suppkey % 40) + 100 + CAST(l_quantity AS INT) * 4 AS INT) AS rend,
 CAST((l_partkey * 7 + l_suppkey) % 61 AS INT) AS mapq, CAST(100 + CAST(l_quantity AS INT) * 4 AS INT) AS align_length
 FROM lineitem JOIN genes g ON g.id = l_partkey""",
    "kept": "SELECT * FROM aln WHERE mapq >= 10",
    "homology": """SELECT CAST(a.p_partkey AS INT) AS q, CAST(b.p_partkey AS INT) AS r, CAST(20 + a.p_size AS INT) AS qlength, CAST(20 + b.p_size AS INT) AS rlength,
 CASE WHEN (a.p_partkey + b.p_partkey) % 3 = 0 THEN '-' ELSE '+' END AS ori, CASE WHEN (a.p_partkey + b.p_partkey) % 5 = 0 THEN 1e-3 ELSE 1e-10 END AS eval,
 CAST(30 + (a.p_partkey + b.p_partkey) % 100 AS DOUBLE) AS bitscore
 FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey""",
    "alike": "SELECT * FROM homology WHERE q <> r AND least(qlength / rlength::DOUBLE, rlength / qlength::DOUBLE) > 0.75 AND eval < 1e-6 AND bitscore > 50",
    "pairs": "SELECT s.* FROM alike s JOIN genes a ON a.id = s.q JOIN genes b ON b.id = s.r WHERE a.ref <> b.ref",
    "sym": "SELECT q AS a, r AS b FROM pairs UNION SELECT r, q FROM pairs",
    "reach": "SELECT a AS n, a AS m FROM sym UNION SELECT reach.n, sym.b FROM reach JOIN sym ON sym.a = reach.m",
    "fam": "SELECT n AS id, min(m) AS canonical FROM reach GROUP BY n",
    "read_steps": """SELECT concat('r', CAST(l_orderkey AS VARCHAR)) AS name,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS INT) AS pos,
 CAST(length(p_type) + ascii(p_type) % 7 AS INT) AS id, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS ori
 FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "pe": """SELECT * FROM (SELECT name, pos, id AS src, ori AS src_ori, lead(id) OVER w AS dst, lead(ori) OVER w AS dst_ori FROM read_steps WINDOW w AS (PARTITION BY name ORDER BY pos)) WHERE dst IS NOT NULL""",
    "lists": "SELECT name, list(id ORDER BY pos) AS ids, list(ori ORDER BY pos) AS oris FROM read_steps GROUP BY name",
    "turned": "SELECT name, ids, oris, list_reverse(ids) AS rids, list_transform(list_reverse(oris), lambda o: CASE o WHEN '+' THEN '-' ELSE '+' END) AS roris, len(list_distinct(oris)) AS k FROM lists",
    "canon": """SELECT name, CASE WHEN back THEN rids ELSE ids END AS ids, CASE WHEN back THEN roris ELSE oris END AS oris FROM
 (SELECT *, CASE WHEN k = 1 THEN oris[1] = '-' ELSE rids < ids END AS back FROM turned)""",
    "dna": """SELECT CAST(doc_id AS INT) AS id, source AS family,
 translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents""",
    "msa": "SELECT dense_rank() OVER (ORDER BY family) AS gene_id, id AS seqname, translate(seq, 'T', '-') AS aligned FROM dna",
    "residues": "SELECT * FROM (SELECT gene_id, seqname, CAST(unnest(range(length(aligned))) AS INT) AS seq_id, unnest(string_split(aligned, '')) AS aa FROM msa WHERE aligned <> '') WHERE aa <> '-'",
    "wins": "SELECT ref, gstart AS wstart, CAST(gstart + 300 AS INT) AS wend FROM genes",
    "proj": "SELECT a.*, g.id AS g_id, g.gstart AS g_start, g.gend AS g_end, g.ori AS g_ori FROM kept a JOIN genes g ON g.ref = a.rname AND g.gstart < a.rend + 1 AND g.gend > a.rstart",
    "ranked": """SELECT *, (least(rend + 1, g_end) - greatest(rstart, g_start)) / (g_end - g_start + 1)::DOUBLE AS cov,
 row_number() OVER (PARTITION BY line_no ORDER BY g_start, g_end, g_id) AS up, row_number() OVER (PARTITION BY line_no ORDER BY g_start DESC, g_end DESC, g_id DESC) AS down FROM proj""",
    "isl": """SELECT qname, min(qstart) AS qstart, max(qend) AS qend FROM (SELECT *, sum(fresh) OVER (PARTITION BY qname ORDER BY qstart, qend) AS g FROM
 (SELECT *, CASE WHEN max(qend) OVER (PARTITION BY qname ORDER BY qstart, qend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= qstart THEN 0 ELSE 1 END AS fresh FROM kept)) GROUP BY qname, g""",
    "o": "SELECT *, row_number() OVER (PARTITION BY qname ORDER BY qstart, qend, line_no DESC) AS rn FROM kept",
    "w": """SELECT qname, rn, line_no, 0 AS cid, qend AS mx FROM o WHERE rn = 1 UNION ALL
 SELECT o.qname, o.rn, o.line_no, CASE WHEN least(o.qend, w.mx) - o.qstart >= 100 THEN w.cid ELSE w.cid + 1 END,
 CASE WHEN least(o.qend, w.mx) - o.qstart >= 100 THEN greatest(w.mx, o.qend) ELSE o.qend END FROM w JOIN o ON o.qname = w.qname AND o.rn = w.rn + 1""",
    "cl": "SELECT k.*, w.cid AS cluster, count(*) OVER (PARTITION BY k.qname, w.cid) AS nc FROM kept k JOIN w ON w.qname = k.qname AND w.line_no = k.line_no",
    "ev": "SELECT qname, cluster, qstart AS v FROM cl WHERE nc > 1 UNION ALL SELECT qname, cluster, qend FROM cl WHERE nc > 1",
    "eg": "SELECT *, sum(f) OVER (PARTITION BY qname, cluster ORDER BY v) AS g FROM (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY qname, cluster ORDER BY v) <= 100 THEN 0 ELSE 1 END AS f FROM ev)",
    "ec": "SELECT DISTINCT qname, cluster, v, CAST(trunc(sum(v) OVER (PARTITION BY qname, cluster, g) / count(*) OVER (PARTITION BY qname, cluster, g)) AS INT) AS c FROM eg",
    "cells": "SELECT * FROM (SELECT qname, cluster, c AS istart, lead(c) OVER (PARTITION BY qname, cluster ORDER BY c) AS iend FROM (SELECT DISTINCT qname, cluster, c FROM ec)) WHERE iend IS NOT NULL",
    "grid": """SELECT qname, cluster, qstart AS istart, qend AS iend, line_no, ori, rname, rstart, rend FROM cl WHERE nc = 1 UNION ALL
 SELECT k.qname, k.cluster, i.istart, i.iend, k.line_no, k.ori, k.rname,
 CAST(trunc((k.rend - k.rstart)::DOUBLE * (i.istart - k.qstart) / (k.qend - k.qstart) + k.rstart) AS INT),
 CAST(trunc((k.rend - k.rstart)::DOUBLE * (i.iend - k.qstart) / (k.qend - k.qstart) + k.rstart) AS INT)
 FROM cl k JOIN ec a ON a.qname = k.qname AND a.cluster = k.cluster AND a.v = k.qstart JOIN ec b ON b.qname = k.qname AND b.cluster = k.cluster AND b.v = k.qend
 JOIN cells i ON i.qname = k.qname AND i.cluster = k.cluster AND least(b.c, i.iend) - greatest(a.c, i.istart) > 0 WHERE k.nc > 1""",
    "gridn": "SELECT *, count(*) OVER (PARTITION BY qname, cluster, istart, iend) AS n_aln FROM grid",
    "between": """SELECT a.id AS line_no, a.ref AS qref, a.gstart AS qstart, a.gstart + 200 AS qend, b.ref AS rname, b.gstart AS rstart, b.gstart + 210 AS rend
 FROM genes a JOIN genes b ON b.id - 25 = a.id WHERE a.ref <> b.ref""",
    "own": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY gstart, gend, id) AS up, row_number() OVER (PARTITION BY line_no ORDER BY gstart DESC, gend DESC, id DESC) AS down,
 (least(qend, gend) - greatest(qstart, gstart)) / (gend - gstart + 1)::DOUBLE AS cov FROM between JOIN genes g ON g.ref = qref AND g.gstart < qend AND g.gend > qstart) WHERE NOT ((up = 1 OR down = 1) AND cov < 0.5)""",
    "moved": """SELECT line_no, rname, id AS q_id, ori AS q_ori, CAST(trunc((rend - rstart)::DOUBLE * (gstart - qstart) / (qend - qstart) + rstart) AS INT) AS ps,
 CAST(trunc((rend - rstart)::DOUBLE * (gend - qstart) / (qend - qstart) + rstart) AS INT) AS pe FROM own""",
    "anchors": """SELECT line_no, q_id, id AS g_id, q_ori, ori FROM (SELECT *, row_number() OVER (PARTITION BY line_no, q_id ORDER BY gstart, gend, id) AS up, row_number() OVER (PARTITION BY line_no, q_id ORDER BY gstart DESC, gend DESC, id DESC) AS down,
 (least(pe, gend) - greatest(ps, gstart)) / (gend - gstart + 1)::DOUBLE AS cov FROM moved JOIN genes g ON g.ref = rname AND g.gstart < pe AND g.gend > ps) WHERE NOT ((up = 1 OR down = 1) AND cov < 0.5)""",
    "gsteps": "SELECT ref AS name, row_number() OVER (PARTITION BY ref ORDER BY gstart, gend, g.id) - 1 AS pos, coalesce(canonical, g.id) AS id, ori FROM genes g LEFT JOIN fam ON fam.id = g.id",
}
NEEDS = {
    "aln": ["genes"], "kept": ["aln"], "alike": ["homology"], "pairs": ["alike", "genes"], "sym": ["pairs"], "reach": ["sym"], "fam": ["reach"], "pe": ["read_steps"], "lists": ["read_steps"],
    "turned": ["lists"], "canon": ["turned"], "msa": ["dna"], "residues": ["msa"], "wins": ["genes"], "proj": ["kept", "genes"], "ranked": ["proj"], "isl": ["kept"], "o": ["kept"], "w": ["o"], "cl": ["w", "kept"],
    "ev": ["cl"], "eg": ["ev"], "ec": ["eg"], "cells": ["ec"], "grid": ["cl", "ec", "cells"], "gridn": ["grid"], "between": ["genes"], "own": ["between", "genes"], "moved": ["own"], "anchors": ["moved", "genes"], "gsteps": ["genes", "fam"],
}


def _sql(body: str, *views: str) -> str:
    """The body behind the views it needs, in an order in which each stands before its users."""
    done: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, []):
            add(n)
        if v not in done:
            done.append(v)

    for v in views:
        add(v)
    return ("WITH RECURSIVE " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in done) + "\n" if done else "") + body


_GFF = "SELECT ref, gstart, gend, ori, description, gene_id FROM genes"
_KEYS = """(SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(description), '[^a-z0-9_]'), lambda x: x <> '')) AS t FROM genes)"""
_MATCH = f"""SELECT id, line FROM {_KEYS} JOIN (VALUES ('red', ['red']), ('small,ring', ['small', 'ring']), ('blue bolt', ['blue', 'bolt'])) k(line, ks) ON list_has_all(t, ks)"""
_PATH = "array_to_string(list_transform(list_zip({0}, {1}), lambda z: concat(z[1], z[2])), ',')"
_FWD = _PATH.format("ids", "oris")
_MULTI = """SELECT s.qname, greatest(s.qstart, t.qstart) AS a, least(s.qend, t.qend) AS b, s.* EXCLUDE (qname) FROM kept s JOIN kept t ON s.qname = t.qname
 AND (s.qstart, s.qend, s.rname, s.ori, s.rstart, s.rend, s.mapq) IS DISTINCT FROM (t.qstart, t.qend, t.rname, t.ori, t.rstart, t.rend, t.mapq) AND least(s.qend, t.qend) - greatest(s.qstart, t.qstart) > 0"""
_CODON = "CASE substr(seq, CAST(3 * i + 1 AS INT), 3) " + " ".join(
    f"WHEN '{a}{b}{c}' THEN '{aa}'" for (a, b, c), aa in zip(((a, b, c) for a in "TCAG" for b in "TCAG" for c in "TCAG"), "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG", strict=True) if aa != "_"
) + " ELSE '' END"
_PROTEIN = f"coalesce((SELECT string_agg({_CODON}, '' ORDER BY i) FROM range(CAST(length(seq) // 3 AS BIGINT)) t(i)), '')"
_RC = "translate(regexp_replace(reverse({0}), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')"
# Genes of 90 bases, end to end from the place k % 40, with shorter ones at both ends.
_SPANS = """SELECT k, s, e, upper(substr(seq, CAST(s + 1 AS INT), CAST(e - s AS INT))) AS fna FROM (SELECT k, seq, s, CASE WHEN s < k % 40 THEN least(k % 40, length(seq)) ELSE least(s + 90, length(seq)) END AS e
 FROM (SELECT id AS k, seq, unnest(list_distinct(list_prepend(0, range(id % 40, length(seq), 90)))) AS s FROM dna) WHERE s < length(seq))"""
_STEPS = """SELECT qname AS name, row_number() OVER (PARTITION BY qname ORDER BY qstart, qend, line_no, CASE WHEN ori = '+' THEN g_start ELSE -g_end END, CASE WHEN ori = '+' THEN g_id ELSE -g_id END) - 1 AS pos, g_id AS id FROM ({0})"""
_EDGES = """SELECT src, dst, count(*) AS coverage FROM (SELECT id AS src, lead(id) OVER (PARTITION BY name ORDER BY pos) AS dst FROM ({0})) WHERE dst IS NOT NULL GROUP BY 1, 2"""
_GRIDPROJ = """SELECT * FROM (SELECT *, (least(rend + 1, g_end) - greatest(rstart, g_start)) / (g_end - g_start + 1)::DOUBLE AS cov,
 row_number() OVER (PARTITION BY qname, line_no, qstart ORDER BY g_start, g_end, g_id) AS up, row_number() OVER (PARTITION BY qname, line_no, qstart ORDER BY g_start DESC, g_end DESC, g_id DESC) AS down FROM
 (SELECT a.qname, a.istart AS qstart, a.iend AS qend, a.line_no, a.ori, a.rstart, a.rend, g.id AS g_id, g.gstart AS g_start, g.gend AS g_end FROM gridn a JOIN genes g ON g.ref = a.rname AND g.gstart < a.rend + 1 AND g.gend > a.rstart WHERE a.n_aln = 1)) WHERE NOT ((up = 1 OR down = 1) AND cov < 0.5)"""
_BOTH = "SELECT src, dst, sum(n)::BIGINT AS coverage FROM (SELECT src, dst, count(*) AS n FROM ({0}) GROUP BY 1, 2 UNION ALL SELECT dst, src, count(*) FROM ({0}) GROUP BY 1, 2) GROUP BY 1, 2"
_TURN = "CASE WHEN ori = '+' THEN {0} ELSE {1} END"

ORACLES = {
    "paf_mapq_filter": _sql("SELECT * FROM kept", "kept"),
    "gff_feature_filter": _sql(_GFF + " WHERE id % 3 <> 0", "genes"),
    "gff_parse": _sql(_GFF, "genes"),
    "paf_parse": _sql("SELECT qname, query_length, qstart, qend, ori, rname, 0 AS ref_length, rstart, rend, align_length, mapq FROM aln", "aln"),
    "blast_parse": _sql("SELECT q, qlength, r, rlength, ori, least(qlength, rlength) AS alength, 90.0::DOUBLE AS identity, eval::DOUBLE AS eval, bitscore FROM homology", "homology"),
    "homology_pair_filter": _sql("SELECT q, r, qlength, rlength, ori, eval::DOUBLE AS eval, bitscore FROM alike", "alike"),
    "homology_pair_filter_dna": _sql("SELECT q, r, qlength, rlength, ori, eval::DOUBLE AS eval, bitscore FROM homology WHERE least(qlength / rlength::DOUBLE, rlength / qlength::DOUBLE) > 0.75", "homology"),
    "homology_cross_ref": _sql("SELECT q, r, qlength, rlength, ori, eval::DOUBLE AS eval, bitscore FROM pairs", "pairs"),
    "homology_split_ori": _sql("SELECT s.q, s.r, s.qlength, s.rlength, s.ori, s.eval::DOUBLE AS eval, s.bitscore FROM pairs s JOIN genes a ON a.id = s.q JOIN genes b ON b.id = s.r WHERE (s.ori = '+') = (a.ori = b.ori)", "pairs"),
    "exclude_sequences": _sql("SELECT line_no, qname FROM kept WHERE qname NOT IN (SELECT concat('r', CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderkey % 10 = 0)", "kept"),
    "boundary_cov_filter": _sql("SELECT rname, count(*) AS n, sum(g_id)::BIGINT AS sum_id FROM ranked WHERE NOT ((up = 1 OR down = 1) AND cov < 0.75) GROUP BY rname", "ranked"),
    "path_min_length": _sql(f"SELECT name, {_FWD} AS path, CAST(len(ids) AS INT) AS size FROM lists WHERE len(ids) >= 3", "lists"),
    "keyword_match": _sql(_MATCH, "genes"),
    "keyword_match_mapped": _sql(f"SELECT DISTINCT coalesce(canonical, m.id) AS id FROM ({_MATCH}) m LEFT JOIN fam ON fam.id = m.id", "genes", "fam"),
    "generate_labels": _sql("""SELECT name, CASE WHEN final - 1 = pos THEN src::VARCHAR ELSE src::VARCHAR END AS source, CASE WHEN final - 1 = pos THEN concat(dst, dst_ori) ELSE dst::VARCHAR END AS target
 FROM (SELECT *, max(pos + 1) OVER (PARTITION BY name) AS final FROM pe)""", "pe"),
    "unmapped_reads": _sql("SELECT concat('r', CAST(o_orderkey AS VARCHAR)) AS qname FROM orders WHERE concat('r', CAST(o_orderkey AS VARCHAR)) NOT IN (SELECT qname FROM kept)", "kept"),
    "first_orientation": _sql("SELECT q, r, ori FROM homology WHERE q <> r", "homology"),
    "project_genes": _sql("SELECT line_no, g_id FROM proj", "proj"),
    "project_genes_filtered": _sql("SELECT line_no, g_id FROM ranked WHERE NOT ((up = 1 OR down = 1) AND cov < 0.5)", "ranked"),
    "syntenic_anchors": _sql("SELECT line_no, q_id, g_id FROM anchors", "anchors"),
    "syntenic_anchors_same_ori": _sql("SELECT line_no, q_id, g_id FROM (SELECT *, max(CASE WHEN ori <> q_ori THEN 1 ELSE 0 END) OVER (PARTITION BY line_no, q_id) AS odd FROM anchors) WHERE odd = 0", "anchors"),
    "gff_contained": _sql("SELECT id, g.ref, wstart, wend FROM genes g JOIN wins w ON w.ref = g.ref AND wstart <= gstart AND wend + 1 >= gend", "wins"),
    "gff_contained_normalized": _sql("SELECT id, concat(g.ref, '_', wstart, '_', wend) AS name, gstart - wstart AS gstart, gend - wstart AS gend FROM genes g JOIN wins w ON w.ref = g.ref AND wstart <= gstart AND wend + 1 >= gend", "wins"),
    "multimapping_report": _sql(f"""SELECT qname, a AS ostart, b AS oend, rname AS ref,
 CASE WHEN a = qstart AND b <> qend THEN CASE WHEN ori = '+' THEN rstart ELSE rend - (b - a + 1) END WHEN a <> qstart AND b = qend THEN CASE WHEN ori = '+' THEN rend - (b - a + 1) ELSE rstart END WHEN a = qstart AND b = qend THEN rstart ELSE rstart + a - 1 END AS rstart,
 CASE WHEN a = qstart AND b <> qend THEN CASE WHEN ori = '+' THEN rstart + (b - a + 1) ELSE rend END WHEN a <> qstart AND b = qend THEN CASE WHEN ori = '+' THEN rend ELSE rstart + (b - a + 1) END WHEN a = qstart AND b = qend THEN rend ELSE b END AS rend,
 b - a + 1 AS osize FROM ({_MULTI})""", "kept"),
    "pair_orientation": _sql("SELECT h.q, h.r, coalesce(k.ori, '+') AS known FROM homology h LEFT JOIN homology k ON k.q = h.q AND k.r = h.r AND k.bitscore < 80", "homology"),
    "all_pairwise": _sql("SELECT a.ref AS a, b.ref AS b FROM (SELECT DISTINCT ref FROM genes) a JOIN (SELECT DISTINCT ref FROM genes) b ON a.ref < b.ref", "genes"),
    "multimap_intervals": _sql("SELECT * FROM gridn", "gridn"),
    "family_sequences": _sql("SELECT CAST(doc_id % 7 AS INT) AS family_no, id, length(seq) AS n, seq FROM labels JOIN dna ON id = doc_id", "dna"),
    "node_coverage": _sql("SELECT id, count(*) AS coverage FROM read_steps GROUP BY id", "read_steps"),
    "edge_coverage_directed": _sql("SELECT src, dst, count(*) AS coverage FROM pe GROUP BY src, dst", "pe"),
    "edge_coverage_undirected": _sql(_BOTH.format("SELECT src, dst FROM pe"), "pe"),
    "gene_graph_edges": _sql("SELECT DISTINCT src, dst FROM pe WHERE src <> dst", "pe"),
    "gene_graph_edges_undirected": _sql("SELECT src, dst FROM pe UNION SELECT dst, src FROM pe", "pe"),
    "gene_graph_nodes": _sql("SELECT DISTINCT id FROM read_steps", "read_steps"),
    "graph_totals": _sql("SELECT (SELECT count(DISTINCT id) FROM read_steps) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM pe WHERE src <> dst)) AS n_edges", "pe"),
    "homology_graph": _sql("SELECT a AS src, b AS dst FROM sym", "sym"),
    "connected_components_sizes": _sql("SELECT canonical AS component, count(*) AS n FROM fam GROUP BY 1", "fam"),
    "connected_components": _sql("SELECT id, canonical FROM fam", "fam"),
    "canonical_ids": _sql("SELECT id, canonical FROM fam", "fam"),
    "homology_connectivity": _sql("""SELECT fam.id, round(d.n / s.n::DOUBLE, 6) AS n_degree, s.n AS cc_size FROM fam JOIN (SELECT canonical, count(*) AS n FROM fam GROUP BY 1) s ON s.canonical = fam.canonical
 JOIN (SELECT a, count(*) AS n FROM sym GROUP BY 1) d ON d.a = fam.id""", "fam"),
    "cc_summary": _sql("SELECT count(*) AS n_components, round(avg(n), 6) AS mean_size FROM (SELECT canonical, count(*) AS n FROM fam GROUP BY 1)", "fam"),
    "genome_paths": _sql("SELECT name, CAST(pos AS INT) AS pos, id, ori FROM gsteps", "gsteps"),
    "path_architectures": _sql(f"SELECT row_number() OVER (ORDER BY n DESC, path) - 1 AS id, path, single_ori, n, first_name FROM (SELECT {_FWD} AS path, CAST(len(list_distinct(oris)) - 1 AS INT) AS single_ori, count(*) AS n, min(name) AS first_name FROM canon GROUP BY 1, 2)", "canon"),
    "edge_labels": _sql("SELECT src, src_ori, dst, dst_ori, name FROM pe UNION SELECT dst, dst_ori, src, src_ori, name FROM pe", "pe"),
    "seq_node_coverage": _sql("SELECT gene_id, seq_id, aa, 1 AS coverage, count(*) AS n_sequences FROM residues GROUP BY 1, 2, 3", "residues"),
    "seq_edge_coverage": _sql("""SELECT gene_id, seq_id AS src, aa AS src_aa, n AS dst, b AS dst_aa, count(*) AS coverage FROM (SELECT *, lead(seq_id) OVER w AS n, lead(aa) OVER w AS b FROM residues WINDOW w AS (PARTITION BY gene_id, seqname ORDER BY seq_id)) WHERE n IS NOT NULL GROUP BY ALL""", "residues"),
    "seq_lengths": _sql("SELECT id, length(seq) AS n FROM dna", "dna"),
    "genome_sizes": _sql("SELECT family, sum(length(seq))::BIGINT AS size FROM dna GROUP BY family", "dna"),
    "mapped_pct": _sql("SELECT round((SELECT count(DISTINCT qname) FROM kept) / (SELECT count(*) FROM orders)::DOUBLE * 100, 6) AS pct", "kept"),
    "path_edges": _sql("SELECT * FROM pe", "pe"),
    "merged_intervals": _sql("SELECT * FROM isl", "isl"),
    "breakpoint_clusters": _sql("""SELECT DISTINCT qname, v AS value, CAST(trunc(sum(v) OVER (PARTITION BY qname, g) / count(*) OVER (PARTITION BY qname, g)) AS INT) AS canonical FROM
 (SELECT *, sum(f) OVER (PARTITION BY qname ORDER BY v) AS g FROM (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY qname ORDER BY v) <= 20 THEN 0 ELSE 1 END AS f FROM (SELECT qname, qstart AS v FROM kept UNION ALL SELECT qname, qend FROM kept)))""", "kept"),
    "multimap_clusters": _sql("SELECT qname, line_no, cid AS cluster FROM w", "w"),
    "paf_read_groups": _sql("SELECT qname, row_number() OVER (PARTITION BY qname ORDER BY first_line) - 1 AS run, n_aln, first_line FROM (SELECT qname, g, count(*) AS n_aln, min(line_no) AS first_line FROM (SELECT *, sum(f) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN lag(qname) OVER (ORDER BY line_no) = qname THEN 0 ELSE 1 END AS f FROM kept)) GROUP BY qname, g)", "kept"),
    "unaligned_regions": _sql("""SELECT qname, qstart, qend, qend - qstart + 1 AS size FROM (SELECT qname, 1 AS qstart, min(qstart) AS qend FROM isl GROUP BY qname HAVING min(qstart) <> 0
 UNION ALL SELECT qname, max(qend) + 1, 1300 FROM isl GROUP BY qname HAVING 1300 - max(qend) <> 0
 UNION ALL SELECT qname, qend + 1, n - 1 FROM (SELECT *, lead(qstart) OVER (PARTITION BY qname ORDER BY qstart) AS n FROM isl) WHERE n - qend - 1 <> 0)""", "isl"),
    "alignment_breakpoints": _sql(f"""SELECT qname, ref, position FROM (
 SELECT qname, rname AS ref, {_TURN.format('rstart', 'rend')} AS position FROM o WHERE rn > 1
 UNION ALL SELECT qname, rname, {_TURN.format('rend', 'rstart')} FROM (SELECT *, max(rn) OVER (PARTITION BY qname) AS mr FROM o) WHERE rn < mr
 UNION ALL SELECT qname, rname, {_TURN.format('rstart', 'rend')} FROM o WHERE rn = 1 AND qstart >= 300
 UNION ALL SELECT qname, rname, {_TURN.format('rend', 'rstart')} FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY qend DESC, qstart, line_no DESC) AS k FROM kept) WHERE k = 1 AND query_length - qend + 1 >= 300)""", "o"),
    "multimap_fraction": _sql("""SELECT qname, run, line_no FROM (SELECT *, count(*) OVER (PARTITION BY qname, run) AS n FROM (SELECT qname, line_no, CAST(sum(f) OVER (PARTITION BY qname ORDER BY qstart, qend, line_no ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM
 (SELECT *, CASE WHEN s IS NOT NULL AND least(qend, e) - greatest(qstart, s) >= 0 AND (least(qend, e) - greatest(qstart, s)) / greatest(qend - qstart + 1, e - s + 1)::DOUBLE >= 0.3 THEN 0 ELSE 1 END AS f FROM
 (SELECT *, lag(qstart) OVER w AS s, lag(qend) OVER w AS e FROM kept WINDOW w AS (PARTITION BY qname ORDER BY qstart, qend, line_no))))) WHERE n > 1""", "kept"),
    "canonical_regions": _sql("""SELECT rname, min(rstart) AS rstart, max(rend) AS rend FROM (SELECT *, sum(f) OVER (PARTITION BY rname ORDER BY rstart, rend) AS g FROM
 (SELECT *, CASE WHEN max(rend) OVER (PARTITION BY rname ORDER BY rstart, rend ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > rstart THEN 0 ELSE 1 END AS f FROM kept)) GROUP BY rname, g""", "kept"),
    "assign_gene_ids": _sql("SELECT ref, gstart, gend, gene_id, row_number() OVER (ORDER BY ref, gstart, gend, gene_id) - 1 AS number FROM genes", "genes"),
    "alignment_sizes": _sql("SELECT line_no, qname, rname, rstart, rend, rend - rstart + 1 AS size, mapq, round((qend - qstart + 1) / query_length::DOUBLE, 2) AS align_cov FROM kept", "kept"),
    "interval_algebra": _sql("SELECT line_no, qend - qstart + 1 AS size, least(qend, rend) - greatest(qstart, rstart) AS overlap, qstart <= rstart AND qend >= rend AS contains, round((least(qend, rend) - greatest(qstart, rstart)) / (qend - qstart + 1)::DOUBLE, 6) AS coverage FROM aln", "aln"),
    "normalize_position": _sql("SELECT line_no, CAST(trunc((rend - rstart)::DOUBLE * mapq / (qend - qstart) + rstart) AS INT) AS position FROM aln", "aln"),
    "orient_paths": _sql(f"SELECT name, {_PATH.format('rids', 'roris')} AS path FROM turned", "turned"),
    "canonical_path": _sql(f"SELECT name, {_FWD} AS path FROM canon", "canon"),
    "reverse_complement": _sql(f"SELECT id, {_RC.format('seq')} AS seq FROM dna", "dna"),
    "dna2protein": _sql(f"SELECT id, {_PROTEIN} AS protein FROM dna", "dna"),
    "fetch_subsequences": _sql("""SELECT id, CAST(s AS INT) AS start, CASE WHEN s + w <= n THEN substr(seq, s + 1, w) ELSE concat(substr(seq, s + 1), substr(seq, 1, s + w - n)) END AS seq
 FROM (SELECT id, seq, length(seq) AS n, least(25, length(seq)) AS w, unnest(range(0, length(seq), 25)) AS s FROM dna)""", "dna"),
    "extract_genes": _sql(f"""SELECT id, fna, {_PROTEIN} AS faa FROM (SELECT concat(k, '_', s) AS id, fna, CASE WHEN k % 2 = 0 THEN fna ELSE {_RC.format('fna')} END AS seq FROM ({_SPANS}))""", "dna"),
    "msa_nodes": _sql("SELECT gene_id, seqname, seq_id, aa FROM residues", "residues"),
    "gfa_to_csv": _sql("SELECT id, CAST(count(*) AS INT) AS weight, 'None' AS label FROM read_steps GROUP BY id", "read_steps"),
    "gfa_edges_to_csv": _sql("SELECT src AS source, dst AS target, CAST(count(*) AS INT) AS weight FROM pe GROUP BY src, dst", "pe"),
    "gfa_paths": _sql(f"SELECT name, {_FWD} AS path, CAST(len(ids) AS INT) AS size FROM lists", "lists"),
    "graph_alignment_as_is": _sql(_EDGES.format(_STEPS.format("SELECT * FROM ranked WHERE NOT ((up = 1 OR down = 1) AND cov < 0.5)")), "ranked"),
    "graph_alignment_edges": _sql(_EDGES.format(_STEPS.format(_GRIDPROJ)), "gridn", "genes"),
    "graph_family_edges": _sql(_BOTH.format("SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY name ORDER BY pos) AS dst FROM gsteps) WHERE dst IS NOT NULL"), "gsteps"),
    "whole_genome_graph": _sql("SELECT src, dst FROM e UNION SELECT dst, src FROM e".replace("FROM e", "FROM (SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY name ORDER BY pos) AS dst FROM (SELECT name, id, min(pos) AS pos FROM gsteps GROUP BY name, id)) WHERE dst IS NOT NULL)"), "gsteps"),
    "native_gene_graph": _sql("SELECT src, dst FROM e UNION SELECT dst, src FROM e".replace("FROM e", "FROM (SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY ref ORDER BY gstart, gend, id) AS dst FROM genes) WHERE dst IS NOT NULL)"), "genes"),
}

# Edit distances: ids are single bytes here, so DuckDB's distance over bytes is the one over ids. Every one against all others.
_NUMBERED = "SELECT row_number() OVER (ORDER BY array_to_string(ids, ',')) - 1 AS id, ids, array_to_string(list_transform(ids, lambda x: chr(CAST(x + 60 AS INT))), '') AS s FROM (SELECT DISTINCT ids FROM lists)"
_DISTANCE = f"""SELECT a.id AS a, b.id AS b, CAST(levenshtein(a.s, b.s) AS INT) AS edits, round(CASE WHEN list_has_any(a.ids, b.ids) THEN least(levenshtein(a.s, b.s), levenshtein(a.s, reverse(b.s))) / least(len(a.ids), len(b.ids))::DOUBLE ELSE 1.0 END, 6) AS distance
 FROM ({_NUMBERED}) a JOIN ({_NUMBERED}) b ON a.id <> b.id"""
ORACLES["path_edit_distance"] = _sql(f"SELECT a, b, edits FROM ({_DISTANCE})", "lists")
ORACLES["path_norm_distance"] = _sql(f"SELECT a, b, distance FROM ({_DISTANCE})", "lists")
ORACLES["path_distance_matrix"] = _sql(f"SELECT a, b, distance FROM ({_DISTANCE}) UNION ALL SELECT id, id, 0.0 FROM ({_NUMBERED})", "lists")

# Files written and read back, or put through commands.
_MORE = {
    "alike_dna": "SELECT * FROM homology WHERE q <> r AND least(qlength / rlength::DOUBLE, rlength / qlength::DOUBLE) > 0.75",
    "pairs_dna": "SELECT s.* FROM alike_dna s JOIN genes a ON a.id = s.q JOIN genes b ON b.id = s.r WHERE a.ref <> b.ref",
    "alike_split": "SELECT s.q, s.r, coalesce(k.ori, '+') AS known FROM alike s LEFT JOIN homology k ON k.q = s.q AND k.r = s.r AND k.bitscore < 80",
    "pairs_split": "SELECT s.* FROM alike_split s JOIN genes a ON a.id = s.q JOIN genes b ON b.id = s.r WHERE a.ref <> b.ref AND (known = '+') = (a.ori = b.ori)",
}
VIEWS |= _MORE
NEEDS |= {"alike_dna": ["homology"], "pairs_dna": ["alike_dna", "genes"], "alike_split": ["alike"], "pairs_split": ["alike_split", "genes"]}
for _kind in ("dna", "split"):
    VIEWS |= {k + "_" + _kind: VIEWS[k].replace("FROM pairs", f"FROM pairs_{_kind}").replace("sym", f"sym_{_kind}").replace("reach", f"reach_{_kind}") for k in ("sym", "reach", "fam")}
    NEEDS |= {f"sym_{_kind}": [f"pairs_{_kind}"], f"reach_{_kind}": [f"sym_{_kind}"], f"fam_{_kind}": [f"reach_{_kind}"]}


def _table(name: str) -> str:
    """The SQL of another query, as a table."""
    return f"({ORACLES[name]})"


_RANKED = "SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM genes"
_DNA = "(SELECT id, coalesce(seq, '') AS seq FROM dna)"
_TAB = "chr(9)"


def _row(*columns: str) -> str:
    return f"concat_ws({_TAB}, {', '.join(columns)})"


_GFF_LINE = _row("{0}", "'x'", "{1}", "{2}", "{3}", "'0.5'", "'+'", "'2'", "concat('ID=', id)")
_PLACED = f"""(SELECT *, length(seq) AS n, unnest([{{'feature': 'tRNA', 'a': length(seq) // 3 + 1, 'b': length(seq) // 2 + 1}}, {{'feature': 'CDS', 'a': 1, 'b': length(seq) // 3 + 1}}, {{'feature': 'exon', 'a': length(seq) - length(seq) // 5, 'b': length(seq)}}], recursive := true) FROM {_DNA})"""
_WINDOWS = f"""(SELECT id, seq, n, w.s AS s, w.e AS e FROM (SELECT id, seq, n, unnest(CASE WHEN id % 3 = 1 THEN [{{'s': n // 4, 'e': n // 4 + n // 2 + 1}}]
 ELSE [{{'s': 0, 'e': (n + 1) // 2}}, {{'s': n - greatest(1, n // 3), 'e': n + n // 4}}] END) AS w FROM (SELECT *, length(seq) AS n FROM {_DNA}) WHERE id % 3 > 0 AND n > 0))"""
_REPORTS = {
    "read_length": ("(SELECT concat('r', o_orderkey) AS qname FROM orders)", ["qname", "1300"]),
    "alignment_sizes": (_table("alignment_sizes"), ["qname", "rname", "rstart", "rend", "size", "mapq", "align_cov"]),
    "breakpoints": (_table("alignment_breakpoints"), ["qname", "ref", "position"]),
    "multimapping": (_table("multimapping_report"), ["qname", "ostart", "oend", "ref", "rstart", "rend", "osize"]),
    "unmapped_reads": (_table("unmapped_reads"), ["qname", "1300"]),
    "unaligned": (_table("unaligned_regions"), ["qname", "qstart", "qend", "size"]),
}
ORACLES |= {
    "path_architecture_names": _sql(f"SELECT a.id, c.name FROM {_table('path_architectures')} a JOIN (SELECT name, {_FWD} AS path FROM canon) c ON c.path = a.path", "canon"),
    "text_lines_numbered": _sql("SELECT row_number() OVER (ORDER BY id) AS line_no, gene_id AS value FROM genes", "genes"),
    "fasta_files": _sql(f"SELECT CAST(id AS VARCHAR) AS name, seq FROM {_DNA}", "dna"),
    "fastq_files": _sql(f"SELECT CAST(id AS VARCHAR) AS name, seq FROM {_DNA}", "dna"),
    "gff_file_list": _sql("SELECT CAST(row_number() OVER (ORDER BY id % 2, id) - 1 AS INT) AS id, ref, gstart, gend, ori, description, gene_id FROM genes", "genes"),
    "description_files": _sql("SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS id, ref, CAST(gstart + 1 AS INT) AS gstart, gend, ori, description, gene_id FROM genes", "genes"),
    "gene_family_files": _sql("SELECT CAST(id % 7 AS INT) AS family, id AS gene FROM genes", "genes"),
    "label_files": _sql("SELECT DISTINCT CAST(id % 50 AS INT) AS id, description AS label FROM genes", "genes"),
    "mapping_files": _sql("SELECT CAST(id AS VARCHAR) AS old, concat('new', id) AS new FROM genes", "genes"),
    "family_files": _sql("SELECT id, canonical FROM fam", "fam"),
    "family_graph_files": _sql("SELECT src AS source, dst AS target, CAST(coverage AS INT) AS weight FROM (" + _BOTH.format("SELECT * FROM (SELECT id AS src, lead(id) OVER (PARTITION BY name ORDER BY pos) AS dst FROM gsteps) WHERE dst IS NOT NULL") + ")", "gsteps"),
    "family_connectivity_files": f"SELECT n_degree, cc_size FROM {_table('homology_connectivity')}",
    "family_paf_files": _sql("SELECT id, canonical FROM fam_dna", "fam_dna"),
    "family_split_files": _sql("SELECT id, canonical FROM fam_split", "fam_split"),
    "graph_files": _sql(f"""SELECT CAST(a.k AS INT) AS source, CAST(b.k AS INT) AS target, CAST(coverage AS INT) AS weight FROM {_table('graph_alignment_edges')} e JOIN ({_RANKED}) a ON a.id = e.src JOIN ({_RANKED}) b ON b.id = e.dst WHERE src <> dst""", "genes"),
    "path_metrics_files": _sql(f"""SELECT CAST(row_number() OVER (ORDER BY n DESC, path) - 1 AS INT) AS "ID", path AS "Path", single_ori AS "SingleOri", CAST(n AS INT) AS "Count", names AS "Names" FROM
 (SELECT {_FWD} AS path, CAST(len(list_distinct(oris)) - 1 AS INT) AS single_ori, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM canon GROUP BY 1, 2)""", "canon"),
    "gfa_converter_files": _sql("""SELECT 'nodes' AS file, 'Id;Weight;Label' AS value UNION ALL SELECT 'edges', 'Source;Target;Weight'
 UNION ALL SELECT 'nodes', concat(id, ';', count(*), ';"', CASE WHEN id % 2 = 0 THEN concat('label ', id) ELSE 'None' END, '"') FROM read_steps GROUP BY id
 UNION ALL SELECT 'edges', concat(src, ';', dst, ';', count(*)) FROM pe GROUP BY src, dst""", "pe"),
    "extract_gene_files": _sql(f"""SELECT CAST(n AS VARCHAR) AS id, fna, {_PROTEIN} AS faa FROM (SELECT n, fna, CASE WHEN k % 2 = 0 THEN fna ELSE {_RC.format('fna')} END AS seq FROM (SELECT *, row_number() OVER (ORDER BY k, s) - 1 AS n FROM ({_SPANS})))""", "dna"),
    "fetch_sequence_files": _sql(f"""SELECT CAST(id AS VARCHAR) AS name, seq FROM {_DNA} WHERE id % 3 = 0 OR seq = ''
 UNION ALL SELECT concat_ws('_', id, s, e), concat(substr(seq, s + 1, least(e, n) - s), substr(seq, 1, greatest(e - n, 0))) FROM {_WINDOWS}""", "dna"),
    "fetch_gff_files": _sql(f"""SELECT {_GFF_LINE.format("CAST(id AS VARCHAR)", "feature", "a", "b")} AS value FROM {_PLACED} WHERE id % 3 = 0 OR n = 0
 UNION ALL SELECT {_GFF_LINE.format("concat_ws('_', p.id, s, e)", "feature", "a - s", "b - s").replace("concat('ID=', id)", "concat('ID=', p.id)")} FROM {_PLACED} p JOIN {_WINDOWS} w ON w.id = p.id WHERE a >= s AND b <= e + 1""", "dna"),
    "fetch_key_files": _sql(f"SELECT DISTINCT id FROM ({_MATCH})", "genes"),
    "sequence_store_files": _sql(f"SELECT id, seq FROM {_DNA}", "dna"),
    "sequence_graph_files": _sql(f"""SELECT DISTINCT concat('S', {_TAB}, gene_id, '_', seq_id, '_', aa, {_TAB}, {_TAB}, 'FC:i:1') AS value FROM residues
 UNION ALL SELECT concat('L', {_TAB}, gene_id, '_', src, '_', src_aa, {_TAB}, '+', {_TAB}, gene_id, '_', dst, '_', dst_aa, {_TAB}, '+', {_TAB}, {_TAB}, 'FC:i:', coverage) FROM {_table('seq_edge_coverage')}""", "residues"),
    "alignment_metrics_files": " UNION ALL ".join(f"SELECT '{name}' AS report, {_row(*columns)} AS value FROM {table}" for name, (table, columns) in _REPORTS.items()),
    "genbank_gene_files": _sql(f"""SELECT {_row("concat('D', id)", "'.'", "'CDS'", "CASE WHEN n < 4 THEN 1 WHEN id % 8 = 2 THEN 1 + 3 * n // 4 ELSE 1 + n // 4 END", "CASE WHEN n < 4 THEN n WHEN id % 8 IN (0, 1, 5) THEN 1 + 3 * n // 4 WHEN id % 8 = 2 THEN n + 1 + n // 4 ELSE n END", "'.'", "CASE WHEN n >= 4 AND id % 8 IN (1, 3, 4) THEN '-' ELSE '+' END", "'.'", "concat('protein_id=D', id, '_0;product=p ', id)")} AS value
 FROM (SELECT *, length(seq) AS n FROM {_DNA}) WHERE n > 0""", "dna"),
    "genbank_sequence_files": _sql(f"SELECT concat('D', id) AS name, seq FROM {_DNA}", "dna"),
    "genbank_protein_files": _sql(f"SELECT concat('D', id, '_0') AS name, 'MKL' AS seq FROM {_DNA} WHERE seq <> ''", "dna"),
}
ORACLES |= {"graph_single_file": ORACLES["graph_files"], "spilled_edge_coverage": ORACLES["edge_coverage_directed"], "fasta_source_files": ORACLES["fasta_files"]}
