"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from framewright.llm import chosen_path, context_tree, decontamination, mixing, quality_classifier, quality_rules, sharding, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_context_tree": context_tree.query,
    "op4_toxicity": toxicity.query,
    "op5_sharding": sharding.query,
    "op6_url_filter": url_filter.query,
    "op7_mixing": mixing.query,
    "op8_quality_rules": quality_rules.query,
    "op9_chosen_path": chosen_path.query,
    "op10_decontamination": decontamination.query,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op6_url_filter": url_filter.SQL,
    "op7_mixing": mixing.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op9_chosen_path": chosen_path.SQL,
    "op10_decontamination": decontamination.SQL,
}
