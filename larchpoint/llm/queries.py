"""Queries of the training-data operators, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from larchpoint.llm import ann, bpe, chat, langid, minhash, packing, pii, suffixdedup, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": chat.op1_chat,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_ann": ann.op3_ann,
        "op4_pii": pii.op4_pii,
        "op5_suffix_dedup": suffixdedup.op5_suffix_dedup,
        "op6_langid": langid.op6_langid,
        "op7_minhash": minhash.op7_minhash,
        "op8_topk": topk.op8_topk,
        "op9_bpe": bpe.op9_bpe,
        "op10_packing": packing.op10_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat.OP1_SQL, "op3_ann": ann.OP3_SQL, "op7_minhash": minhash.OP7_SQL, "op8_topk": topk.OP8_SQL}
