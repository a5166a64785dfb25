"""Queries of this subpackage and their SQL, for the driver's entry file."""

from __future__ import annotations

from respondex.llm import bpe, decontaminate, html_text, jaccard_join, language, licenses, periodic_runs, quality, rules, simhash, spelling, token_counts, url_filter

QUERIES = {
    "op1_bpe": bpe.op1,
    "op2_language": language.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_url_filter": url_filter.op4,
    "op5_token_counts": token_counts.op5,
    "op6_quality": quality.op6,
    "op7_html_text": html_text.op7,
    "op8_jaccard_join": jaccard_join.op8,
    "op9_quality_rules": rules.op9,
    "op10_license_scan": licenses.op10,
    "op11_spelling": spelling.op11,
    "op12_simhash": simhash.op12,
    "op13_periodic_runs": periodic_runs.op13,
}

SQL: dict[str, str] = {
    "op3_decontaminate": decontaminate.SQL,
    "op4_url_filter": url_filter.SQL,
    "op8_jaccard_join": jaccard_join.SQL,
    "op9_quality_rules": rules.SQL,
    "op11_spelling": spelling.SQL,
    "op13_periodic_runs": periodic_runs.SQL,
}
