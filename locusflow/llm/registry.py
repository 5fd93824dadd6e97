"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locusflow.llm import bpe, decontaminate, divergence, language, licenses, mixing, pii, quality, repair, rules, simhash, substrings, tokens

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_language": language.op2_language,
        "op3_mixing": mixing.op3_mixing,
        "op4_substrings": substrings.op4_substrings,
        "op5_rules": rules.op5_rules,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_tokens": tokens.op7_tokens,
        "op8_pii": pii.op8_pii,
        "op9_quality": quality.op9_quality,
        "op10_licenses": licenses.op10_licenses,
        "op11_repair": repair.op11_repair,
        "op12_divergence": divergence.op12_divergence,
        "op13_bpe": bpe.op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.OP3_SQL,
        "op5_rules": rules.OP5_SQL,
        "op10_licenses": licenses.OP10_SQL,
        "op11_repair": repair.OP11_SQL,
        "op12_divergence": divergence.OP12_SQL,
    }
