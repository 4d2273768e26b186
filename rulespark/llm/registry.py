"""The queries of this subpackage and the SQL of those that SQL can express."""

from . import bpe, compression_quality, decontaminate, divergence, html_extract, jaccard_join, license_scan, line_dedup, quality_rules, secret_scan, spelling, substring_dedup, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_compression_quality": compression_quality.op5_compression_quality,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_mincut_text": html_extract.op11_mincut_text,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op12_spelling_variants": spelling.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
