"""Queries of the training-data operators, and the SQL of those whose result SQL can state."""

from __future__ import annotations

from skyledger.llm import archives, filter_audit, language_masks, line_rules, markov, mixing, periodic_runs, phrase_index, prefix_tree, repeats, suffix_sort, toxicity, urls

QUERIES = {
    "op1_arc_to_warc": archives.query,
    "op2_markov_model": markov.query,
    "op3_phrase_index": phrase_index.query,
    "op4_line_rules": line_rules.query,
    "op5_source_mix": mixing.query,
    "op6_language_masks": language_masks.query,
    "op7_prefix_tree": prefix_tree.query,
    "op8_repeated_spans": repeats.query,
    "op9_toxicity": toxicity.query,
    "op10_url_filter": urls.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_filter_audit": filter_audit.query,
    "op13_suffix_sort": suffix_sort.query,
}
SQL = {
    "op1_arc_to_warc": archives.SQL,
    "op3_phrase_index": phrase_index.SQL,
    "op4_line_rules": line_rules.SQL,
    "op5_source_mix": mixing.SQL,
    "op7_prefix_tree": prefix_tree.SQL,
    "op8_repeated_spans": repeats.SQL,
    "op10_url_filter": urls.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
