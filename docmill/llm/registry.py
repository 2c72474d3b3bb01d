"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from docmill.llm import bpe, chat, decontam, langid, linededup, neardup, pii, substrings, topk, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_chat": chat.op2_chat,
        "op3_near_duplicates": neardup.op3_near_duplicates,
        "op4_bpe": bpe.op4_bpe,
        "op5_decontamination": decontam.op5_decontamination,
        "op6_topk": topk.op6_topk,
        "op7_language_id": langid.op7_language_id,
        "op8_pii": pii.op8_pii,
        "op9_repeats": substrings.op9_repeats,
        "op10_line_dedup": linededup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op2_chat": chat.OP2_SQL, "op6_topk": topk.OP6_SQL}
