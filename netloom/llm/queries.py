"""The corpus operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, html_text, language, line_dedup, mixing, neighbours, packing, passages, quality, simhash, spelling, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": html_text.op1_html_text,
        "op2_language_id": language.op2_language_id,
        "op3_quality": quality.op3_quality,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_passages": passages.op6_passages,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_nearest": neighbours.op8_nearest,
        "op9_mixing": mixing.op9_mixing,
        "op10_simhash": simhash.op10_simhash,
        "op11_packing": packing.op11_packing,
        "op12_spelling": spelling.op12_spelling,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": line_dedup.OP7_SQL, "op9_mixing": mixing.OP9_SQL}
