"""Incremental merge of a new batch into the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anti_join_new(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not stored. Rows without a key always pass, and stay out of the shuffle.

    The stored keys are first reduced to those the batch asks for, so that a hot stored key costs one row.
    """
    stored_key = F.col(key).cast("string").alias("stored_key")
    keyed = new.filter(F.col(key).isNotNull())
    stored = existing.select(stored_key).join(keyed.select(stored_key), "stored_key", "left_semi").distinct()
    unseen = keyed.join(stored, F.col(key).cast("string") == F.col("stored_key"), "left_anti")
    return unseen.unionByName(new.filter(F.col(key).isNull()))


def concat_batches(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def dedup_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key combination: the last in ``order``, which must not tie. NULL keys form a group.

    An aggregate, not a window: each task first reduces its own rows, so a hot key shuffles one row per task.
    """
    rest = [name for name in df.columns if name not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return df.groupBy(*keys).agg(last).select(*[name if name in keys else f"last.{name}" for name in df.columns])


def merge_incremental(
    existing: DataFrame | None, batch: DataFrame, key: str, dedup_keys: list[str], row_order: list[str]
) -> DataFrame:
    """Stored rows plus the unseen rows of the batch, the later row winning per ``dedup_keys``.

    The batch is reduced to its own winners first; within each side ``row_order`` decides, and stored rows rank below
    new ones. A row that lost within its batch therefore stays out when the batch comes again.
    """
    batch = dedup_keep_last(batch, dedup_keys, row_order)
    if existing is None:
        return batch
    return later_wins(existing, anti_join_new(batch, existing, key), dedup_keys, row_order)


def later_wins(existing: DataFrame, unseen: DataFrame, dedup_keys: list[str], row_order: list[str]) -> DataFrame:
    """One row per ``dedup_keys`` of both tables; new rows rank above stored ones."""
    both = concat_batches(existing.withColumn("source_rank", F.lit(0)), unseen.withColumn("source_rank", F.lit(1)))
    return dedup_keep_last(both, dedup_keys, ["source_rank", *row_order]).drop("source_rank")


def sort_by_date(df: DataFrame, ts: str, tie_break: str | None = None) -> DataFrame:
    """Range-partitioned total order for display; stored tables sort within their partitions instead."""
    return df.orderBy(*[name for name in (ts, tie_break) if name])
