"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from palaver.llm import ann, chat, media, mixing, neardup, pii, quality, spm, toxicity, warc

QUERIES = {
    "op1_minhash_near_dedup": neardup.op1_minhash_near_dedup,
    "op2_media_columns": media.op2_media_columns,
    "op3_warc": warc.op3_warc,
    "op4_chat_format": chat.op4_chat_format,
    "op5_sentencepiece": spm.op5_sentencepiece,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_pii": pii.op8_pii,
    "op9_ann": ann.op9_ann,
    "op10_mix": mixing.op10_mix,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op3_warc": warc.OP3_SQL, "op4_chat_format": chat.OP4_SQL}
