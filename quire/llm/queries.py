"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact, fingerprint, followups, licenses, mixing, neardup, ppm, quality, repair, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_lm_score": ppm.op3_lm_score,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_top_k": topk.op5_top_k,
        "op6_quality": quality.op6_quality,
        "op7_near_dedup": neardup.op7_near_dedup,
        "op8_chat_format": chat.op8_chat_format,
        "op9_fingerprints": fingerprint.op9_fingerprints,
        "op10_warc": warc.op10_warc,
        "op11_missing_followups": followups.op11_missing_followups,
        "op12_exact_dedup": exact.op12_exact_dedup,
        "op13_conversation_repair": repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    own = {"op1_mixing": mixing, "op5_top_k": topk, "op7_near_dedup": neardup, "op8_chat_format": chat, "op10_warc": warc}
    own |= {"op11_missing_followups": followups, "op12_exact_dedup": exact, "op13_conversation_repair": repair}
    return {name: module.SQL for name, module in own.items()}
