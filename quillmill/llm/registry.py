"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from quillmill.llm import decontaminate, html, langid, lines, matroska, mixing, near, passages, quality, warc

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_line_dedup": lines.query,
    "op3_near_dedup": near.query,
    "op4_language_id": langid.query,
    "op5_source_mixing": mixing.query,
    "op6_substring_dedup": passages.query,
    "op7_decontamination": decontaminate.query,
    "op8_matroska_packets": matroska.query,
    "op9_warc_zstd": warc.query,
    "op10_html_extraction": html.query,
}
ORACLES = {
    "op2_line_dedup": lines.SQL,
    "op3_near_dedup": near.SQL,
    "op5_source_mixing": mixing.sql(),
    "op7_decontamination": decontaminate.SQL,
    "op9_warc_zstd": warc.SQL,
}
