"""Queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, ann_forest, bpe_replay, decontamination, html_text, packing, quality, range_join, shingle_join, spelling, token_files, toxicity, warc

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_shingle_join": shingle_join.query,
    "op3_ann_forest": ann_forest.query,
    "op4_quality": quality.query,
    "op5_warc": warc.query,
    "op6_packing": packing.query,
    "op7_html_text": html_text.query,
    "op8_toxicity": toxicity.query,
    "op9_range_join": range_join.query,
    "op10_bpe_replay": bpe_replay.query,
    "op11_alignment": alignment.query,
    "op12_decontamination": decontamination.query,
    "op13_spelling": spelling.query,
}
ORACLES: dict[str, str] = {"op2_shingle_join": shingle_join.ORACLE, "op5_warc": warc.ORACLE, "op9_range_join": range_join.ORACLE, "op12_decontamination": decontamination.ORACLE}
