"""Strict audit of address columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.base58 import base58_decode
from vitrine.functions.scalar import is_pubkey


def key_audit(df: DataFrame, column: str) -> DataFrame:
    """Add ``verdict``: ok, empty, bad_shape, or not_32_bytes.

    Only texts of the right shape are decoded, each distinct one once."""
    c = F.col(column)
    shaped = df.where(is_pubkey(c)).select(column).distinct()
    lengths = shaped.withColumn("_bytes", F.length(base58_decode(c)))
    verdict = (F.when(c.isNull() | (c == ""), "empty").when(~is_pubkey(c), "bad_shape")
               .when(F.col("_bytes") == 32, "ok").otherwise("not_32_bytes"))
    return df.join(lengths, column, "left").withColumn("verdict", verdict).drop("_bytes")


def key_audit_counts(df: DataFrame, column: str) -> DataFrame:
    return key_audit(df, column).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
