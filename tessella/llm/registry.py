"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, exact_dedup, html_text, language, minhash, packing, quality, sentencepieces, toxicity, url_filter


def queries() -> dict:
    found = [
        minhash.op1_minhash_dedup,
        packing.op2_packing,
        language.op3_language_id,
        url_filter.op4_url_filter,
        quality.op5_quality_rules,
        toxicity.op6_toxicity,
        html_text.op7_html_text,
        chat.op8_chat_format,
        exact_dedup.op9_exact_dedup,
        sentencepieces.op10_sentencepiece,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": minhash.OP1_SQL,
        "op4_url_filter": url_filter.OP4_SQL,
        "op5_quality_rules": quality.OP5_SQL,
        "op8_chat_format": chat.OP8_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
    }
