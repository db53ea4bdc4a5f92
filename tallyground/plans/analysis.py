"""The whole analysis of typed incidents: districts first, then offense types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.operators.metrics import status_counts, summary_report
from tallyground.plans.daily import daily
from tallyground.plans.forecast import CLOSED_FORM, ForecastResult, Model, forecast
from tallyground.plans.hotspots import HotspotResult, hotspots
from tallyground.settings import ForecastSettings, HotspotSettings, cut_lineage


@dataclass(frozen=True)
class Analysis:
    """Both halves, the averages over all districts, and a status per district and type."""

    districts: ForecastResult
    types: HotspotResult
    summary: DataFrame
    status: DataFrame
    status_counts: DataFrame


def analyse(
    df: DataFrame, ts: str, district: str, offense_type: str, lat: str, lon: str, row_id: str,
    forecast_settings: ForecastSettings = ForecastSettings(), hotspot_settings: HotspotSettings = HotspotSettings(), model: Model = CLOSED_FORM,
) -> Analysis:
    """Forecast every district, then cluster and forecast every offense type, and sum both up.

    A district or type that cannot be forecast is named with its reason and holds up none of the others.
    """
    districts = forecast(cut_lineage(daily(df, ts, district)), [district], forecast_settings, model)
    types = hotspots(df, offense_type, ts, lat, lon, row_id, hotspot_settings)
    of = lambda part, frame, name: frame.select(F.lit(part).alias("part"), F.col(name).cast("string").alias("name"), "status", "reason")
    status = cut_lineage(of("district", districts.status, district).unionByName(of("type", types.status, offense_type)))
    return Analysis(districts, types, summary_report(districts.metrics, district), status, status_counts(status))
