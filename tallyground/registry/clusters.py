"""Sampling, clustering, ranking and forecasting of positions."""

from pyspark.sql import functions as F

from tallyground.operators import density, hotspots, sampling
from tallyground.plans import hotspots as plan
from tallyground.plans.analysis import analyse
from tallyground.registry.catalog import query, rounded, rounds
from tallyground.registry.forecasting import STATUS_SQL
from tallyground.registry.inputs import CTES, oracle, view
from tallyground.settings import HotspotSettings, scratch_path
from tallyground.sources import store

EPS = 0.0001
PER_LABEL = HotspotSettings(min_samples=5)
SAMPLE = 1000


@query(
    "sample_per_type",
    oracle(f"""SELECT event_id, offense FROM (SELECT *, row_number() OVER (
               PARTITION BY offense ORDER BY md5(concat('42:', event_id)), event_id) AS r FROM {{ev}}) WHERE r <= {SAMPLE}"""),
)
def sample_per_type(spark, sf_dir):
    return sampling.sample_per_type(view(spark, sf_dir, "ev"), "offense", "event_id", SAMPLE).select("event_id", "offense")


def _points(spark, sf_dir):
    return density.cut_lineage(
        density.grid_points(view(spark, sf_dir, "geo"), F.lit(0), "lat", "lon", "vec_id", EPS)
    )


@query(
    "neighbor_join",
    oracle("""SELECT p AS vec_id, CASE WHEN count(*) < 20 THEN count(*) END AS neighbours, count(*) >= 20 AS is_core
              FROM {all_near} GROUP BY p"""),
)
def neighbor_join(spark, sf_dir):
    counts = density.neighbour_counts(_points(spark, sf_dir), EPS, 20)
    return counts.select(F.col("point").alias("vec_id"), "neighbours", "is_core")


@query("dbscan_core_points", oracle("SELECT p AS vec_id FROM {all_core}"))
def dbscan_core_points(spark, sf_dir):
    return density.core_points(_points(spark, sf_dir), EPS, 20).select(F.col("point").alias("vec_id"))


@query("dbscan_clusters", oracle("SELECT point AS vec_id, cluster FROM {all_label}"))
def dbscan_clusters(spark, sf_dir):
    rows = density.dbscan_clusters(view(spark, sf_dir, "geo"), "lat", "lon", "vec_id", None, EPS, 20)
    return rows.select("vec_id", "cluster")


@query("type_hotspots", oracle("SELECT label, vec_id, cluster FROM {hot_rows}"))
def type_hotspots(spark, sf_dir):
    rows = hotspots.type_hotspots(view(spark, sf_dir, "geo"), "label", "lat", "lon", "vec_id", PER_LABEL)
    return rows.select("label", "vec_id", "cluster")


# The operators below take any clustered table; the grid has one row per line item.


@query("drop_noise", oracle("SELECT row_id, type, cluster FROM {grid} WHERE cluster <> -1"))
def drop_noise(spark, sf_dir):
    return hotspots.drop_noise(view(spark, sf_dir, "grid")).select("row_id", "type", "cluster")


@query("cluster_counts", oracle('SELECT type, cluster_id, "count" FROM {grid_counts}'))
def cluster_counts(spark, sf_dir):
    return hotspots.cluster_counts(view(spark, sf_dir, "grid"), "type")


@query("cluster_rank", oracle('SELECT type, cluster_id, "count", cluster_rank FROM {grid_rank}'))
def cluster_rank(spark, sf_dir):
    return hotspots.cluster_rank(hotspots.cluster_counts(view(spark, sf_dir, "grid"), "type"), "type")


@query("top_clusters", oracle('SELECT type, cluster_id, "count", cluster_rank FROM {grid_rank} WHERE cluster_rank <= 5'))
def top_clusters(spark, sf_dir):
    return hotspots.top_clusters(hotspots.cluster_counts(view(spark, sf_dir, "grid"), "type"), "type")


@query("largest_cluster", oracle('SELECT type, cluster_id, "count" FROM {grid_rank} WHERE cluster_rank = 1'))
def largest_cluster(spark, sf_dir):
    return hotspots.largest_cluster(hotspots.cluster_counts(view(spark, sf_dir, "grid"), "type"), "type")


@query(
    "top_cluster_points",
    oracle("""SELECT row_id, g.type, g.cluster, cluster_rank,
              ['red', 'blue', 'green', 'purple', 'orange'][cluster_rank] AS colour
              FROM {grid} g JOIN {grid_rank} r ON g.type = r.type AND g.cluster = r.cluster_id WHERE cluster_rank <= 5"""),
)
def top_cluster_points(spark, sf_dir):
    points = hotspots.top_cluster_points(view(spark, sf_dir, "grid"), "type")
    return points.select("row_id", "type", "cluster", "cluster_rank", "colour")


@query(
    "cluster_centroid",
    oracle(f"""SELECT type, {rounds('centre_lat', 'centre_lon')} FROM (
               SELECT type, avg(lat) AS centre_lat, avg(lon) AS centre_lon FROM {{grid}} WHERE cluster <> -1 GROUP BY type)"""),
)
def cluster_centroid(spark, sf_dir):
    return rounded(hotspots.cluster_centroid(view(spark, sf_dir, "grid"), "type", "lat", "lon"))


@query(
    "cluster_bounds",
    oracle(f"""SELECT type, {rounds('min_x', 'min_y', 'max_x', 'max_y', digits=3)} FROM (
               SELECT type, min(x) - 1000 AS min_x, min(y) - 1000 AS min_y, max(x) + 1000 AS max_x, max(y) + 1000 AS max_y
               FROM (SELECT type, 6378137.0 * radians(lon) AS x, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y
                     FROM {{grid}} WHERE cluster <> -1) GROUP BY type HAVING max(x) > min(x) AND max(y) > min(y))"""),
)
def cluster_bounds(spark, sf_dir):
    return rounded(hotspots.cluster_bounds(view(spark, sf_dir, "grid"), "type", "lat", "lon"), 3)


@query("cluster_membership_filter", oracle("SELECT row_id, cluster FROM {grid} WHERE cluster IN (1, 3, 99)"))
def cluster_membership_filter(spark, sf_dir):
    return hotspots.cluster_membership_filter(view(spark, sf_dir, "grid"), [1, 3, 99]).select("row_id", "cluster")


@query("valid_cluster_intersect", oracle("SELECT DISTINCT s_suppkey AS cluster FROM supplier WHERE s_suppkey IN (SELECT cluster FROM {grid})"))
def valid_cluster_intersect(spark, sf_dir):
    wanted = view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cluster"))
    return hotspots.valid_cluster_intersect(wanted, view(spark, sf_dir, "grid"))


@query("type_counts", oracle('SELECT offense, count(*) AS "count" FROM {ev} GROUP BY offense'))
def type_counts(spark, sf_dir):
    return hotspots.type_counts(view(spark, sf_dir, "ev"), "offense")


@query("distinct_types", "SELECT DISTINCT p_type FROM part ORDER BY p_type")
def distinct_types(spark, sf_dir):
    from tallyground.operators.series import distinct_values

    return distinct_values(view(spark, sf_dir, "part"), "p_type")


@query(
    "top_types",
    """SELECT p_type, count(*) AS "count" FROM part JOIN lineitem ON p_partkey = l_partkey
       GROUP BY p_type ORDER BY "count" DESC, p_type LIMIT 10""",
)
def top_types(spark, sf_dir):
    parts = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return hotspots.top_types(view(spark, sf_dir, "lineitem").join(parts, "l_partkey"), "p_type")


@query(
    "types_with_clusters",
    oracle("""SELECT o_orderstatus AS type, count(*) AS "count" FROM orders
              WHERE o_orderstatus IN (SELECT l_linestatus FROM lineitem GROUP BY 1) GROUP BY 1"""),
)
def types_with_clusters(spark, sf_dir):
    orders = view(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("type"))
    clusters = view(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("type")).agg(F.count("*").alias("count"))
    return hotspots.types_with_clusters(orders, clusters, "type")


@query(
    "heat_grid",
    oracle("""SELECT type, CAST(floor(lat / 0.01) AS BIGINT) AS lat_index, CAST(floor(lon / 0.01) AS BIGINT) AS lon_index,
              count(*) AS "count" FROM {grid} GROUP BY ALL"""),
)
def heat_grid(spark, sf_dir):
    return hotspots.heat_grid(view(spark, sf_dir, "grid"), ["type"], "lat", "lon", 0.01)


HOT_FORECAST = f"SELECT label, cluster, ds, {rounds('trend', 'weekly', 'yearly', 'yhat', 'yhat_lower', 'yhat_upper')} FROM {{hot_scored}}"


def _hotspots(spark, sf_dir):
    return plan.hotspots(view(spark, sf_dir, "geo"), "label", "occurred", "lat", "lon", "vec_id", PER_LABEL)


@query("cluster_forecast", oracle(HOT_FORECAST))
def cluster_forecast(spark, sf_dir):
    forecast = _hotspots(spark, sf_dir).forecast
    return rounded(
        forecast.select("label", "cluster", "ds", "trend", "weekly", "yearly", "yhat", "yhat_lower", "yhat_upper")
    )


# Beside the types of the table three that must be skipped: one without positions, one whose rows lie far from each other, and one
# whose rows share a place and a week.
SKIPPED = """
    SELECT CAST(100 AS INT) AS label, -vec_id - 1 AS vec_id, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, occurred FROM {geo}
    WHERE vec_id < 50
    UNION ALL SELECT CAST(101 AS INT), -vec_id - 1001, CAST(40 + vec_id * 0.1 AS DOUBLE), CAST(-70 AS DOUBLE), occurred FROM {geo} WHERE vec_id < 50
    UNION ALL SELECT CAST(102 AS INT), -vec_id - 2001, CAST(41 AS DOUBLE), CAST(-72 AS DOUBLE), CAST('1995-03-06' AS DATE) FROM {geo} WHERE vec_id < 200
"""


@query(
    "hotspot_status",
    oracle(f"""SELECT t.label, CASE WHEN c.label IS NULL THEN '{hotspots.ALL_NOISE}'
                                    WHEN f.label IS NULL THEN '{hotspots.TOO_FEW_DAYS}' END AS reason,
              CASE WHEN c.label IS NULL OR f.label IS NULL THEN 'skipped' ELSE 'success' END AS status
              FROM (SELECT DISTINCT label FROM {{geo}}) t LEFT JOIN (SELECT DISTINCT label FROM {{hot_counts}}) c
              ON t.label = c.label LEFT JOIN (SELECT DISTINCT label FROM {{hot_fit_rows}}) f ON t.label = f.label
              UNION ALL SELECT 100, '{hotspots.NO_POSITION}', 'skipped' UNION ALL SELECT 101, '{hotspots.ALL_NOISE}', 'skipped'
              UNION ALL SELECT 102, '{hotspots.TOO_FEW_DAYS}', 'skipped'"""),
)
def hotspot_status(spark, sf_dir):
    geo = view(spark, sf_dir, "geo")
    skipped = spark.sql(SKIPPED, geo=geo)
    rows = geo.select(*skipped.columns).unionByName(skipped)
    return plan.hotspots(rows, "label", "occurred", "lat", "lon", "vec_id", PER_LABEL).status


@query(
    "generate_crime_type_analyses",
    oracle(f"""SELECT 'cluster' AS output, label, cluster AS cluster_id, n AS "count",
              row_number() OVER (PARTITION BY label ORDER BY n DESC, cluster) AS cluster_rank, NULL AS ds, NULL AS yhat FROM {{hot_counts}}
              UNION ALL SELECT 'forecast', label, cluster, NULL, NULL, ds, yhat FROM ({HOT_FORECAST})
              UNION ALL SELECT CASE WHEN c.label IS NULL OR f.label IS NULL THEN 'skipped' ELSE 'success' END, t.label, NULL, NULL, NULL, NULL, NULL
              FROM (SELECT DISTINCT label FROM {{geo}}) t LEFT JOIN (SELECT DISTINCT label FROM {{hot_counts}}) c
              ON t.label = c.label LEFT JOIN (SELECT DISTINCT label FROM {{hot_fit_rows}}) f ON t.label = f.label"""),
)
def generate_crime_type_analyses(spark, sf_dir):
    return rounded(_analyses(_hotspots(spark, sf_dir)))


def _analyses(result):
    """All outputs per type in one table: ranked clusters, the forecast, the status."""
    empty = {"cluster_id": "long", "count": "long", "cluster_rank": "long", "ds": "date", "yhat": "double"}

    def part(output, df, **names):
        columns = [F.col(names[c]).cast(kind).alias(c) if c in names else F.lit(None).cast(kind).alias(c) for c, kind in empty.items()]
        return df.select(output.alias("output"), "label", *columns)

    counts = part(F.lit("cluster"), result.counts, cluster_id="cluster_id", count="count", cluster_rank="cluster_rank")
    ahead = part(F.lit("forecast"), result.forecast, cluster_id="cluster", ds="ds", yhat="yhat")
    return counts.unionByName(ahead).unionByName(part(F.col("status"), result.status))


# The results of every type, saved and read back.
@query(
    "write_type_outputs",
    oracle(f"""SELECT 'cluster' AS output, CAST(label AS VARCHAR) AS label, cluster AS cluster_id, n AS "count", NULL AS ds, NULL AS yhat
              FROM {{hot_counts}} UNION ALL SELECT 'forecast', CAST(label AS VARCHAR), cluster, NULL, ds, yhat FROM ({HOT_FORECAST})"""),
)
def write_type_outputs(spark, sf_dir):
    result = _hotspots(spark, sf_dir)
    paths = {name: scratch_path(spark, name) for name in ("clusters", "forecast")}
    plan.save(result, "label", **paths)
    saved = {name: store.load_series_outputs(spark, path) for name, path in paths.items()}
    counts = saved["clusters"].select(
        F.lit("cluster").alias("output"), "label", "cluster_id", "count", F.lit(None).cast("date").alias("ds"), F.lit(None).cast("double").alias("yhat")
    )
    ahead = saved["forecast"].select(
        F.lit("forecast").alias("output"), "label", F.col("cluster").alias("cluster_id"), F.lit(None).cast("long").alias("count"), "ds", "yhat"
    )
    return rounded(counts.unionByName(ahead))


GEO_DAILY = "(SELECT CAST(label % 3 AS VARCHAR) AS district, CAST(occurred AS DATE) AS ds, count(*) AS y FROM {geo} GROUP BY ALL)"
GEO_STATUS = STATUS_SQL.replace("{split}", f"({CTES['split']})").replace("{daily}", GEO_DAILY)


# Both halves from one table: the status of every district and type, and over how many districts the summary averages.
@query(
    "forecast_main",
    oracle(f"""SELECT 'district' AS part, district AS name, status, reason FROM ({GEO_STATUS})
              UNION ALL SELECT 'type', CAST(t.label AS VARCHAR), CASE WHEN c.label IS NULL OR f.label IS NULL THEN 'skipped' ELSE 'success' END,
                  CASE WHEN c.label IS NULL THEN '{hotspots.ALL_NOISE}' WHEN f.label IS NULL THEN '{hotspots.TOO_FEW_DAYS}' END
              FROM (SELECT DISTINCT label FROM {{geo}}) t LEFT JOIN (SELECT DISTINCT label FROM {{hot_counts}}) c
              ON t.label = c.label LEFT JOIN (SELECT DISTINCT label FROM {{hot_fit_rows}}) f ON t.label = f.label
              UNION ALL SELECT 'summary', CAST(count(*) AS VARCHAR), NULL, NULL FROM ({GEO_STATUS}) WHERE status = 'success'"""),
)
def forecast_main(spark, sf_dir):
    rows = view(spark, sf_dir, "geo").withColumn("district", (F.col("label") % 3).cast("string"))
    result = analyse(rows, "occurred", "district", "label", "lat", "lon", "vec_id", hotspot_settings=PER_LABEL)
    none = F.lit(None).cast("string")
    series = result.summary.select(F.lit("summary").alias("part"), F.col("series").cast("string").alias("name"), none.alias("status"), none.alias("reason"))
    return result.status.unionByName(series)
