"""The corpus queries and their SQL."""

from __future__ import annotations

from . import chat, langid, linededup, mixing, neardup, packing, quality, secrets, substring, topk
from .shared import table


def _on(name, apply):
    return lambda spark, sf_dir: apply(table(spark, sf_dir, name))


QUERIES = {
    "op1_mixing": _on("documents", mixing.op1),
    "op2_line_dedup": _on("documents", linededup.op2),
    "op3_language_id": _on("documents", langid.op3),
    "op4_substring_dedup": _on("documents", substring.op4),
    "op5_near_dedup": _on("documents", neardup.op5),
    "op6_chat_format": _on("conversations", chat.op6),
    "op7_quality_rules": _on("documents", quality.op7),
    "op8_secret_scans": _on("documents", secrets.op8),
    "op9_packing": _on("documents", packing.op9),
    "op10_top_k": _on("embeddings", topk.op10),
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op2_line_dedup": linededup.SQL,
    "op4_substring_dedup": substring.SQL,
    "op5_near_dedup": neardup.SQL,
    "op7_quality_rules": quality.SQL,
    "op10_top_k": topk.SQL,
}
