"""Hotspots of every offense type in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyground.operators import hotspots as ops
from tallyground.settings import HotspotSettings, cut_lineage
from tallyground.sources import store


@dataclass(frozen=True)
class HotspotResult:
    clustered: DataFrame
    counts: DataFrame
    forecast: DataFrame
    status: DataFrame


def hotspots(
    df: DataFrame, by: str, ts: str, lat: str, lon: str, row_id: str, settings: HotspotSettings = HotspotSettings()
) -> HotspotResult:
    """Cluster, rank and forecast; ``df`` holds typed incidents with ``row_id`` unique over the table."""
    clustered = cut_lineage(ops.type_hotspots(df, by, lat, lon, row_id, settings))
    forecast = ops.cluster_forecast(clustered, by, ts, settings)
    counts = ops.cluster_rank(ops.cluster_counts(clustered, by), by)
    return HotspotResult(clustered, counts, forecast, ops.hotspot_status(df, clustered, forecast, by))


def save(result: HotspotResult, by: str, clusters: str, forecast: str) -> None:
    """Write the ranked clusters and the forecast of every type below the given paths."""
    store.write_series_outputs(result.counts, clusters, by)
    store.write_series_outputs(result.forecast, forecast, by)
