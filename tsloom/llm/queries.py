"""Queries of the training-data operators and the SQL that expresses them."""

from __future__ import annotations

from tsloom.llm import chat, decontaminate, html_layout, media_ts, quality, sentencepiece_viterbi, sharding, simhash, toxicity, url_filters
from tsloom.session import ship

_MODULES = {
    "op1_toxicity": toxicity,
    "op2_quality": quality,
    "op3_url_filters": url_filters,
    "op4_sentencepiece": sentencepiece_viterbi,
    "op5_decontamination": decontaminate,
    "op6_simhash": simhash,
    "op7_sharding": sharding,
    "op8_html_layout": html_layout,
    "op9_media_ts": media_ts,
    "op10_chat_formatting": chat,
}


def _query(module):
    return lambda spark, sf_dir: module.query(ship(spark), sf_dir)


QUERIES = {name: _query(module) for name, module in _MODULES.items()}
ORACLES = {name: module.ORACLE for name, module in _MODULES.items() if hasattr(module, "ORACLE")}
