"""The queries of this subpackage and their SQL, for the driver's entry."""

from __future__ import annotations

from sparkvec.llm import chat, decontaminate, html_template, line_crf, line_dedup, packing, quality_rules, secrets, simhash, toxicity

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_packing": packing.op6_packing,
    "op7_chat": chat.op7_chat,
    "op8_html_template": html_template.op8_html_template,
    "op9_simhash": simhash.op9_simhash,
    "op10_line_crf": line_crf.op10_line_crf,
}

ORACLE_SQL = {"op1_secrets": secrets.OP1_SQL, "op2_decontaminate": decontaminate.OP2_SQL, "op4_line_dedup": line_dedup.OP4_SQL, "op7_chat": chat.OP7_SQL}
