"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import brown, decontaminate, fillmiddle, langid, maintext, mixing, orderminhash, quality, ranked, sanitize, suffixdedup, tokencount, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_brown_lm": brown.op1,
        "op2_decontaminate": decontaminate.op2,
        "op3_entropy_mix": mixing.op3,
        "op4_token_counts": tokencount.op4,
        "op5_language_id": langid.op5,
        "op6_sanitize": sanitize.op6,
        "op7_toxicity": toxicity.op7,
        "op8_quality_rules": quality.op8,
        "op9_suffix_dedup": suffixdedup.op9,
        "op10_order_minhash": orderminhash.op10,
        "op11_fill_in_middle": fillmiddle.op11,
        "op12_ranked_search": ranked.op12,
        "op13_main_text": maintext.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": fillmiddle.OP11_SQL, "op12_ranked_search": ranked.OP12_SQL}
