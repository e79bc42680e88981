"""Queries of the training-data operators by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, neardup, packing, pii, substrings, tiff, token_files, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neardup": neardup.query,
        "op2_token_files": token_files.query,
        "op3_pii": pii.query,
        "op4_repeated_substrings": substrings.query,
        "op5_language_id": language.query,
        "op6_warc_revisits": warc.query,
        "op7_tiff_pages": tiff.query,
        "op8_toxicity": toxicity.query,
        "op9_decontaminate": decontaminate.query,
        "op10_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_revisits": warc.ORACLE, "op9_decontaminate": decontaminate.ORACLE}
