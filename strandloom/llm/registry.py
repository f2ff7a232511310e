"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from . import bpe, chat, decontamination, filter_audit, hard_negatives, jaccard_join, language_id, quality_gam, quality_rules, sharding, toxicity, url_rules, warc_archives
from .oracles import ORACLES

QUERIES = {
    "op1_bayes_jaccard": jaccard_join.op1_bayes_jaccard,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op7_ngram_language": language_id.op7_ngram_language,
    "op3_additive_quality": quality_gam.op3_additive_quality,
    "op4_boosted_toxicity": toxicity.op4_boosted_toxicity,
    "op5_association_urls": url_rules.op5_association_urls,
    "op6_divergence_rules": quality_rules.op6_divergence_rules,
    "op8_hash_tree_shards": sharding.op8_hash_tree_shards,
    "op9_incremental_chat": chat.op9_incremental_chat,
    "op10_string_tiling": decontamination.op10_string_tiling,
    "op11_shared_lists": hard_negatives.op11_shared_lists,
    "op12_zip_warc": warc_archives.op12_zip_warc,
    "op13_failing_ids": filter_audit.op13_failing_ids,
}

__all__ = ["ORACLES", "QUERIES"]
