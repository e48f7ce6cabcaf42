"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from corpusmill.llm import chat, decontam, licenses, minhash, packing, quality, substrings, tokens, toxicity, urls

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_packing": packing.op3_packing,
    "op4_url_filter": urls.op4_url_filter,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_minhash": minhash.op9_minhash,
    "op10_chat_format": chat.op10_chat_format,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op4_url_filter": urls.ORACLE_SQL,
    "op9_minhash": minhash.ORACLE_SQL,
    "op10_chat_format": chat.ORACLE_SQL,
}
