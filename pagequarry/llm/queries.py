"""The corpus operators as registered queries, and their SQL where SQL can state them."""

from __future__ import annotations

from pagequarry.llm import bpe, decontaminate, html_text, jaccard, language, lm, quality, secrets, token_counts, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_jaccard_join": jaccard.op2_jaccard_join,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_bpe": bpe.op5_bpe,
        "op6_language_id": language.op6_language_id,
        "op7_secrets": secrets.op7_secrets,
        "op10_lm_scoring": lm.op10_lm_scoring,
        "op8_html_text": html_text.op8_html_text,
        "op9_decontamination": decontaminate.op9_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op9_decontamination": decontaminate.OP9_SQL}
