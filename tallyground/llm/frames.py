"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: str) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def size_of(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and UTF-8 bytes of the texts, one small job."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text)))).first()
    return row[0], row[1] or 0


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
