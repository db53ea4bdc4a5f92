"""Ranking, describing and forecasting the clusters of every offense type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyground.functions.geo import web_mercator_x, web_mercator_y
from tallyground.operators.additive import fit_additive_sql, predict_components
from tallyground.operators.clean import valid_coordinates
from tallyground.operators.density import NOISE, dbscan_clusters
from tallyground.operators.sampling import sample_per_type
from tallyground.operators.series import daily_counts_dense
from tallyground.settings import HotspotSettings

# Colours of the ranks on a map.
RANK_COLOURS = ["red", "blue", "green", "purple", "orange"]


def drop_noise(clustered: DataFrame) -> DataFrame:
    return clustered.filter(F.col("cluster") != NOISE)


def cluster_counts(clustered: DataFrame, by: str) -> DataFrame:
    """Rows per type and cluster, noise left out."""
    return drop_noise(clustered).groupBy(by, F.col("cluster").alias("cluster_id")).agg(F.count("*").alias("count"))


def cluster_rank(counts: DataFrame, by: str) -> DataFrame:
    """Rank 1 is the largest cluster of its type; equal counts go by cluster id."""
    order = Window.partitionBy(by).orderBy(F.desc("count"), "cluster_id")
    return counts.withColumn("cluster_rank", F.row_number().over(order).cast("bigint"))


def top_clusters(counts: DataFrame, by: str, n: int = 5) -> DataFrame:
    return cluster_rank(counts, by).filter(F.col("cluster_rank") <= n)


def largest_cluster(counts: DataFrame, by: str) -> DataFrame:
    """The largest cluster per type, as an aggregate."""
    best = F.min_by(F.struct("cluster_id", "count"), F.struct(-F.col("count"), F.col("cluster_id")))
    return counts.groupBy(by).agg(best.alias("best")).select(by, "best.*")


def top_cluster_points(clustered: DataFrame, by: str, n: int = 5) -> DataFrame:
    """Rows of the ``n`` largest clusters per type with rank and map colour."""
    ranked = top_clusters(cluster_counts(clustered, by), by, n).select(
        by, F.col("cluster_id").alias("cluster"), "cluster_rank"
    )
    colours = F.array(*[F.lit(c) for c in RANK_COLOURS])
    position = F.pmod(F.col("cluster_rank") - 1, F.lit(len(RANK_COLOURS))).cast("int")
    return clustered.join(ranked, [by, "cluster"]).withColumn("colour", F.get(colours, position))


def cluster_centroid(clustered: DataFrame, by: str, lat: str, lon: str) -> DataFrame:
    """Mean position of the clustered rows per type."""
    return drop_noise(clustered).groupBy(by).agg(F.avg(lat).alias("centre_lat"), F.avg(lon).alias("centre_lon"))


def cluster_bounds(clustered: DataFrame, by: str, lat: str, lon: str, padding: float = 1000.0) -> DataFrame:
    """Box of the clustered rows per type in Web Mercator metres, padded; only boxes with an area."""
    x, y = web_mercator_x(F.col(lon)), web_mercator_y(F.col(lat))
    return (
        drop_noise(clustered)
        .groupBy(by)
        .agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))
        .filter("max_x > min_x AND max_y > min_y")
        .withColumns(
            {
                "min_x": F.col("min_x") - padding,
                "min_y": F.col("min_y") - padding,
                "max_x": F.col("max_x") + padding,
                "max_y": F.col("max_y") + padding,
            }
        )
    )


def cluster_membership_filter(clustered: DataFrame, wanted: list[int]) -> DataFrame:
    return clustered.filter(F.col("cluster").isin(wanted))


def valid_cluster_intersect(wanted: DataFrame, clustered: DataFrame) -> DataFrame:
    """Requested cluster ids that exist."""
    return wanted.select("cluster").intersect(clustered.select("cluster"))


def type_counts(df: DataFrame, offense_type: str) -> DataFrame:
    return df.groupBy(offense_type).agg(F.count("*").alias("count"))


def top_types(df: DataFrame, offense_type: str, n: int = 10) -> DataFrame:
    return type_counts(df, offense_type).orderBy(F.desc("count"), offense_type).limit(n)


def types_with_clusters(df: DataFrame, clusters: DataFrame, offense_type: str) -> DataFrame:
    """Types that have a cluster, most rows first."""
    found = clusters.filter(F.col("count") > 0).select(offense_type).distinct()
    return type_counts(df, offense_type).join(found, offense_type, "left_semi").orderBy(F.desc("count"), offense_type)


def heat_grid(df: DataFrame, by: list[str], lat: str, lon: str, step: float) -> DataFrame:
    """Rows per grid square, the square named by its south-west index."""
    row, column = F.floor(F.col(lat) / F.lit(step)), F.floor(F.col(lon) / F.lit(step))
    return df.groupBy(*by, row.alias("lat_index"), column.alias("lon_index")).agg(F.count("*").alias("count"))


def type_hotspots(
    df: DataFrame, by: str, lat: str, lon: str, row_id: str, settings: HotspotSettings = HotspotSettings()
) -> DataFrame:
    """Sampled rows of every type with their cluster. The sample is drawn before coordinates are checked."""
    sample = sample_per_type(df, by, row_id, settings.sample_size, settings.seed)
    return dbscan_clusters(
        valid_coordinates(sample, lat, lon), lat, lon, row_id, by, settings.eps, settings.min_samples
    )


def cluster_forecast(
    clustered: DataFrame, by: str, ts: str, settings: HotspotSettings = HotspotSettings(), interval_width: float = 0.8
) -> DataFrame:
    """Forecast of the largest cluster per type: its own days and ``forecast_days`` more.

    Days are dense. Series shorter than ``min_days_weekly`` are left out; yearly effects need ``min_days_yearly``.
    """
    largest = largest_cluster(cluster_counts(clustered, by), by).select(by, F.col("cluster_id").alias("cluster"))
    rows = clustered.join(largest, [by, "cluster"])
    dense = daily_counts_dense(rows, ts, [by, "cluster"])
    days = F.count("*").over(Window.partitionBy(by, "cluster"))
    models = fit_additive_sql(
        dense.withColumn("days", days).filter(F.col("days") >= settings.min_days_weekly),
        [by, "cluster"],
        yearly=F.col("days") >= settings.min_days_yearly,
        holidays=False,
    )
    return predict_components(
        models, F.col("t0"), F.date_add("last_day", settings.forecast_days), interval_width
    )


# Why a type has no forecast, in the order in which the reasons are tried.
NO_POSITION = "no row has a usable position"
ALL_NOISE = "every row is noise"
TOO_FEW_DAYS = "the largest cluster has too few days"


def hotspot_status(sample: DataFrame, clustered: DataFrame, forecast: DataFrame, by: str) -> DataFrame:
    """One row per type: success, or skipped with the reason."""
    points = clustered.groupBy(by).agg(
        F.count("*").alias("points"), F.count_if(F.col("cluster") != NOISE).alias("grouped")
    )
    days = forecast.groupBy(by).agg(F.count("*").alias("forecast_days"))
    reason = (
        F.when(F.col("points").isNull(), NO_POSITION)
        .when(F.col("grouped") == 0, ALL_NOISE)
        .when(F.col("forecast_days").isNull(), TOO_FEW_DAYS)
    )
    return (
        sample.select(by).distinct().join(points, by, "left").join(days, by, "left")
        .select(by, reason.alias("reason"))
        .withColumn("status", F.when(F.col("reason").isNull(), "success").otherwise("skipped"))
    )
