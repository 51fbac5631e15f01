"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import (
    decontamination,
    exact_dedup,
    line_dedup,
    pieces,
    pii,
    sharding,
    simhash,
    token_files,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_simhash": simhash.op3_simhash,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_token_output": token_files.op5_token_output,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_pii": pii.op8_pii,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_sharding": sharding.op10_sharding,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
}
