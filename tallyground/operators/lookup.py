"""Joining incidents with the offense code lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def offense_lookup_join(
    incidents: DataFrame,
    codes: DataFrame,
    code: str,
    lookup_code: str,
    name: str,
    offense_type: str = "offense_type",
    on_duplicate: str = "fanout",
) -> DataFrame:
    """Incidents with the name of their code; rows without a name are dropped.

    A repeated code multiplies rows (``fanout``) unless ``on_duplicate`` is ``first``, which keeps
    its smallest name. A NULL code never matches. Spark broadcasts a small lookup by its own
    estimate; otherwise the join is shuffled and AQE splits a hot code.
    """
    if on_duplicate not in ("fanout", "first"):
        raise ValueError(f"on_duplicate must be 'fanout' or 'first', not {on_duplicate!r}")
    named = codes.select(F.col(lookup_code).alias("CODE"), F.col(name).alias(offense_type)).filter(
        F.col("CODE").isNotNull() & F.col(offense_type).isNotNull()
    )
    if on_duplicate == "first":
        named = named.groupBy("CODE").agg(F.min(offense_type).alias(offense_type))
    joined = incidents.join(named, incidents[code] == named["CODE"], "inner")
    taken = "code" in [column.lower() for column in incidents.columns]
    return joined.drop(named["CODE"]) if taken else joined


def drop_null_offense(df: DataFrame, offense_type: str) -> DataFrame:
    return df.dropna(subset=[offense_type])


def unmatched_codes(incidents: DataFrame, codes: DataFrame, code: str, lookup_code: str, name: str) -> DataFrame:
    """One row ``unmatched BIGINT``: rows that the lookup join drops. Codes are counted before they are joined."""
    per_code = incidents.groupBy(F.col(code).alias("CODE")).agg(F.count("*").alias("n"))
    named = codes.filter(F.col(name).isNotNull()).select(F.col(lookup_code).alias("CODE"))
    return per_code.join(named, "CODE", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("unmatched")
    )
