"""The registered queries of this subpackage: name to (query, checking SQL)."""

from __future__ import annotations

import corpus_pipeline
from testpulse.llm import (
    bpe, chat, decontamination, linededup, neighbours, packing, quality, resampling, sharding, simhash,
    toxicity, whitening, wrappers,
)

QUERIES = {
    "op1_neighbours": (neighbours.op1_neighbours, None),
    "op2_packing": (packing.op2_packing, None),
    "op3_quality_rules": (quality.op3_quality_rules, quality.sql()),
    "op4_toxicity": (toxicity.op4_toxicity, None),
    "op5_chat_format": (chat.op5_chat_format, chat.sql()),
    "op6_main_text": (wrappers.op6_main_text, None),
    "op7_simhash": (simhash.op7_simhash, None),
    "op8_sharding": (sharding.op8_sharding, None),
    "op9_line_dedup": (linededup.op9_line_dedup, None),
    "op10_byte_bpe": (bpe.op10_byte_bpe, None),
    "op11_resampling": (resampling.op11_resampling, resampling.sql()),
    "op12_decontamination": (decontamination.op12_decontamination, decontamination.sql()),
    "op13_whitening": (whitening.op13_whitening, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
