"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from lucidframe.llm import decontaminate, edit_counts, license_scan, line_rules, ngram_join, packing, personal_data, quality_model, url_filter, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_line_rules": line_rules.op2_line_rules,
    "op3_warc": warc.op3_warc,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_quality_model": quality_model.op5_quality_model,
    "op6_personal_data": personal_data.op6_personal_data,
    "op7_edit_counts": edit_counts.op7_edit_counts,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_packing": packing.op10_packing,
}
ORACLES = {
    "op1_license_scan": license_scan.ORACLE,
    "op2_line_rules": line_rules.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op8_ngram_join": ngram_join.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
}
