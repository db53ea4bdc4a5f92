"""Clean incidents and give them their offense type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.functions.coerce import coerce_integer
from tallyground.operators.clean import clean_incidents
from tallyground.operators.lookup import offense_lookup_join


def enrich(raw: DataFrame, codes: DataFrame, on_duplicate: str = "fanout") -> DataFrame:
    """Raw text incidents and raw lookup → typed rows with coordinates and ``OFFENSE_TYPE``."""
    typed_codes = codes.withColumn("LOOKUP_CODE", coerce_integer(F.col("CODE"))).select("LOOKUP_CODE", "NAME")
    return offense_lookup_join(
        clean_incidents(raw), typed_codes, "OFFENSE_CODE", "LOOKUP_CODE", "NAME", "OFFENSE_TYPE", on_duplicate
    )
