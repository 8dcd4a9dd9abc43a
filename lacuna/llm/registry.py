"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from lacuna.llm.ann import op8_ann
from lacuna.llm.bpe import op1_bpe
from lacuna.llm.chat import OP10_SQL, op10_chat_formatting
from lacuna.llm.decontaminate import OP4_SQL, op4_decontamination
from lacuna.llm.quality import op9_quality
from lacuna.llm.sharding import OP3_SQL, op3_sharding
from lacuna.llm.simhash import op7_simhash
from lacuna.llm.tokencount import op6_token_counts
from lacuna.llm.toxicity import op2_toxicity
from lacuna.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_ann": op8_ann,
    "op9_quality": op9_quality,
    "op10_chat_formatting": op10_chat_formatting,
}

ORACLE_SQL = {
    "op3_sharding": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op10_chat_formatting": OP10_SQL,
}
