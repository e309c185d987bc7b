"""The queries of this subpackage, and DuckDB text for those that SQL can say."""

from __future__ import annotations

from eventide.llm import collocations, exact_substrings, language_id, licenses, mixing, near_duplicates, neighbours, packing, periodic_runs, private_data, quality, url_filters, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_url_filter": url_filters.op3_url_filter,
    "op4_language_id": language_id.op4_language_id,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_exact_substrings": exact_substrings.op6_exact_substrings,
    "op7_near_duplicates": near_duplicates.op7_near_duplicates,
    "op8_private_data": private_data.op8_private_data,
    "op9_nearest_neighbours": neighbours.op9_nearest_neighbours,
    "op10_source_mixing": mixing.op10_source_mixing,
    "op11_collocations": collocations.op11_collocations,
    "op12_warc": warc.op12_warc,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op1_license_scan": licenses.OP1_SQL,
    "op3_url_filter": url_filters.OP3_SQL,
    "op10_source_mixing": mixing.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_periodic_runs": periodic_runs.OP13_SQL,
}
