"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import corpus_pipeline
from adkpi.llm import (
    exact_dedup,
    license_scan,
    line_dedup,
    merkle_manifest,
    minhash_dedup,
    packing,
    pivot_search,
    quality_model,
    quality_rules,
    source_mix,
    spelling_groups,
    suffix_dedup,
    token_codec,
)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_source_mix": source_mix.op2_source_mix,
    "op3_token_codec": token_codec.op3_token_codec,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_quality_model": quality_model.op7_quality_model,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_pivot_search": pivot_search.op9_pivot_search,
    "op10_packing": packing.op10_packing,
    "op11_exact_dedup": exact_dedup.op11_exact_dedup,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_spelling_variants": spelling_groups.op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

# The others are tested against brute force: SQL has no tokenizer, coder or trees.
ORACLE = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_source_mix": source_mix.ORACLE,
    "op6_license_scan": license_scan.ORACLE,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_merkle_manifest": merkle_manifest.ORACLE,
    "op13_spelling_variants": spelling_groups.ORACLE,
}
