"""Landed files, the stored table, and the incremental merge."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyground import schemas
from tallyground.operators import merge, quality
from tallyground.operators.clean import coerce_timestamps
from tallyground.operators.hotspots import cluster_counts
from tallyground.plans import update as plan
from tallyground.registry.catalog import query
from tallyground.registry.inputs import filled_incidents, oracle, table, typed_incidents, view
from tallyground.settings import scratch_path
from tallyground.sources import landing, store

PAGE = 500
EV = "event_id, ts, district, offense, user_id, value"
MERGE_KEYS = ["hour", "district", "offense"]
RECORD = (
    T.StructType()
    .add("event_id", T.LongType())
    .add("ts", T.StringType())
    .add("district", T.StringType())
    .add("offense", T.StringType())
    .add("value", T.DoubleType())
)


def _landed_pages(spark, sf_dir):
    """Events as landed page envelopes; every seventh page is a failed call."""
    page = F.col("page")
    records = F.sort_array(F.collect_list(F.struct("event_id", F.col("ts").cast("string").alias("ts"), "district", "offense", "value")))
    text = F.concat(F.lit("page "), page.cast("string"), F.lit(" refused"))
    nested = F.concat(F.lit('{"message":"'), text, F.lit('"}'))
    error = F.when(page % 2 == 0, nested).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    good = page % 7 != 6
    body = F.when(good, F.to_json(F.struct("records"))).otherwise(F.lit("null"))
    line = F.concat(
        F.lit('{"offset":'), (page * PAGE).cast("string"), F.lit(',"success":'), good.cast("string"),
        F.lit(',"error":'), F.when(good, F.lit("null")).otherwise(error), F.lit(',"result":'), body, F.lit("}"),
    )
    path = scratch_path(spark, "pages")
    (
        view(spark, sf_dir, "ev")
        .groupBy(F.expr(f"event_id div {PAGE}").alias("page"))
        .agg(records.alias("records"))
        .select(line.alias("value"))
        .write.text(path)
    )
    return landing.read_pages(spark, path, RECORD)


# An empty field of the file is a missing value.
@query("scan_incidents_csv", oracle("SELECT nullif(COLUMNS(*), '') FROM {inc}"))
def scan_incidents_csv(spark, sf_dir):
    rows = view(spark, sf_dir, "inc")
    path = scratch_path(spark, "incidents-csv")
    rows.write.options(header=True, encoding="ISO-8859-1", escape='"').csv(path)
    return landing.scan_incidents_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in rows.columns]))


@query("scan_code_lookup", oracle("SELECT CAST(code AS VARCHAR) AS code, name FROM {codes}"))
def scan_code_lookup(spark, sf_dir):
    path = scratch_path(spark, "codes-csv")
    view(spark, sf_dir, "codes").select(F.col("code").alias("CODE"), F.col("name").alias("NAME")).write.option(
        "header", True
    ).csv(path)
    return landing.scan_code_lookup(spark, path).select(F.col("CODE").alias("code"), F.col("NAME").alias("name"))


@query(
    "scan_api_pages",
    oracle(f"""SELECT event_id, ts, district, offense, value, (event_id // {PAGE}) * {PAGE} + row_number() OVER (
                   PARTITION BY event_id // {PAGE} ORDER BY event_id) - 1 AS row_seq
               FROM {{ev}} WHERE (event_id // {PAGE}) % 7 <> 6"""),
)
def scan_api_pages(spark, sf_dir):
    return coerce_timestamps(landing.scan_api_pages(_landed_pages(spark, sf_dir)), ts="ts")


@query(
    "api_page_errors",
    oracle(f"""SELECT DISTINCT (event_id // {PAGE}) * {PAGE} AS page_offset,
               concat('page ', event_id // {PAGE}, ' refused') AS error_message
               FROM {{ev}} WHERE (event_id // {PAGE}) % 7 = 6"""),
)
def api_page_errors(spark, sf_dir):
    errors = landing.api_page_errors(_landed_pages(spark, sf_dir))
    return errors.withColumnRenamed("offset", "page_offset")


@query(
    "json_envelope",
    oracle(f"""SELECT (event_id // {PAGE}) * {PAGE} AS page_offset, (event_id // {PAGE}) % 7 <> 6 AS success,
               CASE WHEN (event_id // {PAGE}) % 7 <> 6 THEN count(*) ELSE 0 END AS records
               FROM {{ev}} GROUP BY event_id // {PAGE}"""),
)
def json_envelope(spark, sf_dir):
    return _landed_pages(spark, sf_dir).select(
        F.col("offset").alias("page_offset"),
        "success",
        F.coalesce(F.size("result.records"), F.lit(0)).cast("bigint").alias("records"),
    )


@query(
    "pages_until_short",
    oracle(f"""SELECT event_id, ts, district, offense, value, event_id // {PAGE} <= (
                   SELECT coalesce(min(page), 999999999) FROM (
                       SELECT event_id // {PAGE} AS page, count(*) AS n FROM {{ev}} GROUP BY 1)
                   WHERE page % 7 = 6 OR n < {PAGE}) AS complete
               FROM {{ev}} WHERE (event_id // {PAGE}) % 7 <> 6"""),
)
def pages_until_short(spark, sf_dir):
    return coerce_timestamps(landing.pages_until_short(_landed_pages(spark, sf_dir), PAGE), ts="ts")


# The pull starts at the latest stored time.
@query("incremental_pull", oracle(f"SELECT {EV} FROM {{ev}} WHERE ts > (SELECT max(ts) FROM {{existing}}) ORDER BY ts, event_id"))
def incremental_pull(spark, sf_dir):
    path = scratch_path(spark, "incidents")
    store.write_incidents(view(spark, sf_dir, "existing"), path, "ts", "district", "event_id")
    start = F.lit(store.latest_stored(spark, path).first()[0]).cast("timestamp_ntz")
    return landing.incremental_pull(view(spark, sf_dir, "ev"), "ts", start, tie_break="event_id")


@query(
    "standardize_columns",
    oracle("SELECT event_id AS incident_number, ts AS occurred_on_date, user_id, event_type AS offense, value, props "
           "FROM events"),
)
def standardize_columns(spark, sf_dir):
    names = {"event_id": "incident_number", "ts": "occurred_on_date", "event_type": "offense", "Lat": "lat"}
    return landing.standardize_columns(table(spark, sf_dir, "events"), names)


@query("require_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def require_table(spark, sf_dir):
    return landing.require_table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


# All incident columns, one of them named MONTH, from the orders; the codes of a day repeat.
INCIDENTS = """SELECT CAST(o_orderkey AS VARCHAR) AS INCIDENT_NUMBER, CAST(o_custkey % 5 AS VARCHAR) AS OFFENSE_CODE,
    'group' AS OFFENSE_CODE_GROUP, o_orderpriority AS OFFENSE_DESCRIPTION, concat('D', CAST(o_custkey % 7 AS VARCHAR)) AS DISTRICT,
    CAST(o_custkey AS VARCHAR) AS REPORTING_AREA, '0' AS SHOOTING, {ts} AS OCCURRED_ON_DATE,
    CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) AS YEAR, CAST(month(CAST(o_orderdate AS DATE)) AS VARCHAR) AS MONTH,
    CAST(NULL AS VARCHAR) AS DAY_OF_WEEK, '3' AS HOUR, 'Part' AS UCR_PART, o_orderpriority AS STREET, '42.3' AS Lat, '-71.1' AS Long,
    o_orderstatus AS Location, o_orderkey AS row_seq FROM orders"""
INCIDENTS_SQL = INCIDENTS.replace("{ts}", "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)")


def _incidents(spark, sf_dir):
    """The same rows; the time as the text that the interface sends."""
    sent = INCIDENTS.replace("{ts}", "concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 00:00:00')")
    return spark.sql(sent.replace("VARCHAR", "STRING").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def _deliver(rows, path):
    """Rows as more landed page files, ``row_seq`` as their place."""
    record = F.struct(*schemas.INCIDENT_COLUMNS)
    page = F.col("row_seq")
    line = F.to_json(F.struct(page.alias("offset"), F.lit(True).alias("success"), F.struct(F.array(record).alias("records")).alias("result")))
    rows.select(line.alias("value")).write.mode("append").text(path)


@query(
    "write_incidents",
    f"SELECT * EXCLUDE (row_seq), strftime(OCCURRED_ON_DATE, '%Y-%m') AS occurred_month_part FROM ({INCIDENTS_SQL})",
)
def write_incidents(spark, sf_dir):
    path = scratch_path(spark, "incidents")
    rows = _incidents(spark, sf_dir).drop("row_seq")
    store.write_incidents(coerce_timestamps(rows, OCCURRED_ON_DATE="OCCURRED_ON_DATE"), path, "OCCURRED_ON_DATE")
    return store.read_incidents(spark, path)


METADATA_SQL = """
    SELECT 'run 1' AS last_updated, strftime(min(ts), '%Y-%m-%d') AS start_day, strftime(max(ts), '%Y-%m-%d') AS end_day,
           CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS total_days,
           count(*) AS total_records, string_agg(DISTINCT district, ',' ORDER BY district) AS districts
    FROM {ev}
"""


def _flat_metadata(metadata):
    return metadata.select(
        "last_updated",
        F.col("date_range.start").alias("start_day"),
        F.col("date_range.end").alias("end_day"),
        F.col("date_range.total_days").alias("total_days"),
        "total_records",
        F.concat_ws(",", "districts").alias("districts"),
    )


def _metadata(spark, sf_dir):
    return quality.dataset_metadata(view(spark, sf_dir, "ev"), "ts", "district", F.lit("run 1"))


@query("dataset_metadata", oracle(METADATA_SQL))
def dataset_metadata(spark, sf_dir):
    return _flat_metadata(_metadata(spark, sf_dir))


@query("write_metadata", oracle(METADATA_SQL))
def write_metadata(spark, sf_dir):
    path = scratch_path(spark, "metadata")
    store.write_metadata(_metadata(spark, sf_dir), path)
    return _flat_metadata(spark.read.json(path))


@query("load_metadata", oracle(METADATA_SQL))
def load_metadata(spark, sf_dir):
    path = scratch_path(spark, "metadata")
    store.write_metadata(_metadata(spark, sf_dir), path)
    return _flat_metadata(store.load_metadata(spark, path))


# The saved summary where there is one, else the figures of the data.
@query("dataset_info", oracle(f"""SELECT 'saved' AS branch, * FROM ({METADATA_SQL}) UNION ALL
    SELECT 'data', * FROM ({METADATA_SQL.replace("run 1", "Unknown")})"""))
def dataset_info(spark, sf_dir):
    rows, saved = view(spark, sf_dir, "ev"), scratch_path(spark, "metadata")
    missing = scratch_path(spark, "metadata")
    store.write_metadata(_metadata(spark, sf_dir), saved)
    both = [
        _flat_metadata(store.dataset_info(spark, path, rows, "ts", "district")).select(F.lit(branch).alias("branch"), "*")
        for branch, path in (("saved", saved), ("data", missing))
    ]
    return both[0].unionByName(both[1])


@query("anti_join_new", oracle(f"SELECT {EV} FROM {{batch}} WHERE event_id NOT IN (SELECT event_id FROM {{existing}})"))
def anti_join_new(spark, sf_dir):
    return merge.anti_join_new(view(spark, sf_dir, "batch"), view(spark, sf_dir, "existing"), "event_id")


@query(
    "concat_batches",
    oracle("SELECT event_id, ts, district, offense, user_id, value FROM {existing} "
           "UNION ALL SELECT event_id, ts, district, offense, user_id, NULL FROM {batch}"),
)
def concat_batches(spark, sf_dir):
    return merge.concat_batches(view(spark, sf_dir, "existing"), view(spark, sf_dir, "batch").drop("value"))


@query(
    "dedup_keep_last",
    oracle("""SELECT event_id, hour, district, offense, user_id, value FROM (
                SELECT *, date_trunc('hour', ts) AS hour, row_number() OVER (
                    PARTITION BY date_trunc('hour', ts), district, offense ORDER BY event_id DESC) AS r FROM {ev})
              WHERE r = 1"""),
)
def dedup_keep_last(spark, sf_dir):
    return merge.dedup_keep_last(_hourly(view(spark, sf_dir, "ev")), MERGE_KEYS, ["event_id"])


def _hourly(df):
    # The time is cut to the hour so that keys repeat.
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return df.select("event_id", hour.alias("hour"), "district", "offense", "user_id", "value")


@query("merge_incremental", oracle("SELECT * FROM {merged}"))
def merge_incremental(spark, sf_dir):
    existing, batch = (_hourly(view(spark, sf_dir, name)) for name in ("existing", "batch"))
    return merge.merge_incremental(existing, batch, "event_id", MERGE_KEYS, ["event_id"])


@query("sort_by_date", oracle(f"SELECT {EV} FROM {{ev}} ORDER BY ts, event_id"))
def sort_by_date(spark, sf_dir):
    return merge.sort_by_date(view(spark, sf_dir, "ev"), "ts", "event_id")


# Two deliveries that overlap, in one landing folder; each is read once.
@query(
    "update_data",
    f"""WITH landed AS ({INCIDENTS_SQL}), first AS (SELECT * FROM landed WHERE row_seq % 2 = 0 OR row_seq % 3 = 0),
        kept AS (SELECT * FROM first QUALIFY row_number() OVER (
            PARTITION BY OCCURRED_ON_DATE, DISTRICT, OFFENSE_CODE ORDER BY row_seq DESC) = 1),
        second AS (SELECT * FROM landed WHERE row_seq % 2 = 1 OR row_seq % 3 = 0 QUALIFY row_number() OVER (
            PARTITION BY OCCURRED_ON_DATE, DISTRICT, OFFENSE_CODE ORDER BY row_seq DESC) = 1),
        pool AS (SELECT *, 0 AS source_rank FROM kept UNION ALL SELECT *, 1 FROM second
                 WHERE INCIDENT_NUMBER NOT IN (SELECT INCIDENT_NUMBER FROM kept))
        SELECT * EXCLUDE (source_rank) FROM pool QUALIFY row_number() OVER (
            PARTITION BY OCCURRED_ON_DATE, DISTRICT, OFFENSE_CODE ORDER BY source_rank DESC, row_seq DESC) = 1""",
)
def update_data(spark, sf_dir):
    path, metadata, folder = (scratch_path(spark, name) for name in ("incidents", "metadata", "landing"))
    rows = _incidents(spark, sf_dir)
    for share in ("row_seq % 2 = 0 OR row_seq % 3 = 0", "row_seq % 2 = 1 OR row_seq % 3 = 0"):
        _deliver(rows.filter(share), folder)
        for _ in range(2):  # the second time nothing has landed
            plan.update_from(spark, path, metadata, folder)
    return store.read_incidents(spark, path).drop(store.MONTH_PART)


@query("latest_date", oracle("SELECT max(ts) AS latest FROM {inc_typed}"))
def latest_date(spark, sf_dir):
    return quality.latest_date(typed_incidents(spark, sf_dir), "ts")


@query("load_clusters", oracle("SELECT type, cluster_id, \"count\" AS \"count\" FROM {grid_counts} WHERE type = 'R'"))
def load_clusters(spark, sf_dir):
    path = scratch_path(spark, "clusters")
    store.write_series_outputs(cluster_counts(view(spark, sf_dir, "grid"), "type"), path, "type")
    return store.load_series_output(spark, path, "type", "R")


@query("list_series", oracle("SELECT DISTINCT district FROM {inc_typed} ORDER BY district"))
def list_series(spark, sf_dir):
    return store.list_series(filled_incidents(spark, sf_dir), "district")
