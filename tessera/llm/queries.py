"""Queries of this subpackage: op1 to op10, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, gif, langid, lm, minhash, quality, secrets, suffixes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffixes": suffixes.query,
        "op2_minhash": minhash.query,
        "op3_langid": langid.query,
        "op4_warc": warc.query,
        "op5_decontaminate": decontaminate.query,
        "op6_gif": gif.query,
        "op7_secrets": secrets.query,
        "op8_quality": quality.query,
        "op9_bpe": bpe.query,
        "op10_lm": lm.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash": minhash.SQL,
        "op4_warc": warc.SQL,
        "op5_decontaminate": decontaminate.SQL,
    }
