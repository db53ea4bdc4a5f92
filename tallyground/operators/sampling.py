"""Repeatable sample per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyground.settings import cut_lineage


def _draw(seed: int, row_id: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def sample_per_type(df: DataFrame, by: str, row_id: str, n: int | None = 10000, seed: int = 42) -> DataFrame:
    """The ``n`` rows per group whose seeded hash comes first; groups below ``n`` stay whole.

    A window over the raw rows would pull a hot group into one task. Instead each group's rows are
    counted by the magnitude of the hash, which names the smallest power of two that still leaves at
    least ``n`` rows below it. About ``n`` to ``2n`` rows per group pass that filter and reach the window.
    """
    if n is None:
        return df
    drawn = df.withColumn("draw", _draw(seed, row_id))
    # 60 bits of the hash as a number; its magnitude never falls as the hash grows, and halves the rows
    # with each step down.
    bits = F.coalesce(F.floor(F.log2(F.conv(F.substring("draw", 1, 15), 16, 10).cast("double"))), F.lit(-1))
    drawn = drawn.withColumn("bits", bits)
    sizes = drawn.groupBy(by, "bits").agg(F.count("*").alias("rows"))
    below = F.sum("rows").over(Window.partitionBy(by).orderBy("bits"))
    cutoffs = (
        sizes.withColumn("below", below)
        .groupBy(F.col(by).alias("group"))
        .agg(F.coalesce(F.min(F.when(F.col("below") >= n, F.col("bits"))), F.max("bits")).alias("cutoff"))
    )
    candidates = drawn.join(
        cut_lineage(cutoffs), F.col(by).eqNullSafe(F.col("group")), "inner"
    ).filter(F.col("bits") <= F.col("cutoff"))
    first = Window.partitionBy(by).orderBy("draw", row_id)
    return (
        candidates.withColumn("position", F.row_number().over(first))
        .filter(F.col("position") <= n)
        .drop("draw", "bits", "group", "cutoff", "position")
    )
