"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm import decontaminate, html_text, jaccard_join, lexical, licenses, lm, merkle, mixing, near_dup, quality, substring_dup, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_mixture": mixing.op1_mixture,
    "op2_quality": quality.op2_quality,
    "op3_lm": lm.op3_lm,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_topk": topk.op7_topk,
    "op8_substring_dup": substring_dup.op8_substring_dup,
    "op9_licenses": licenses.op9_licenses,
    "op10_html_text": html_text.op10_html_text,
    "op11_lexical": lexical.op11_lexical,
    "op12_manifest": merkle.op12_manifest,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mixture": mixing.OP1_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op7_topk": topk.OP7_SQL,
    "op8_substring_dup": substring_dup.OP8_SQL,
    "op9_licenses": licenses.OP9_SQL,
    "op11_lexical": lexical.OP11_SQL,
    "op12_manifest": merkle.OP12_SQL,
    "op13_jaccard_join": jaccard_join.OP13_SQL,
}
