"""Typing, filters, the lookup join, quality checks and scalar functions."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.functions import coerce, geo, stats, text
from tallyground.operators import clean, lookup, quality
from tallyground.plans import daily as daily_plan
from tallyground.plans.enrich import enrich
from tallyground.registry.catalog import query, rounded, rounds
from tallyground.registry.inputs import filled_incidents, incident_daily, oracle, table, typed_incidents, view
from tallyground.sources import landing

AS_OF = "2001-10-15 12:00:00"


@query("coerce_timestamp", oracle("SELECT incident_number, occurred_raw, TRY_CAST(occurred_raw AS TIMESTAMP) AS ts FROM {inc}"))
def coerce_timestamp(spark, sf_dir):
    rows = view(spark, sf_dir, "inc").select("incident_number", "occurred_raw")
    return clean.coerce_timestamps(rows, ts="occurred_raw")


@query(
    "coerce_numeric",
    oracle("""SELECT incident_number, TRY_CAST(offense_code_raw AS INT) AS offense_code, TRY_CAST(hour_raw AS INT) AS hour,
              TRY_CAST(lat_raw AS DOUBLE) AS lat, TRY_CAST(long_raw AS DOUBLE) AS lon FROM {inc}"""),
)
def coerce_numeric(spark, sf_dir):
    rows = clean.coerce_numbers(view(spark, sf_dir, "inc"), lat="lat_raw", lon="long_raw")
    rows = clean.coerce_integers(rows, offense_code="offense_code_raw", hour="hour_raw")
    return rows.select("incident_number", "offense_code", "hour", "lat", "lon")


@query("drop_bad_dates", oracle("SELECT incident_number, ts FROM {inc_typed} WHERE ts IS NOT NULL"))
def drop_bad_dates(spark, sf_dir):
    return clean.drop_bad_dates(typed_incidents(spark, sf_dir).select("incident_number", "ts"), "ts")


def _located(spark, sf_dir):
    rows = view(spark, sf_dir, "inc").select("incident_number", "lat_raw", "long_raw")
    return clean.coerce_numbers(rows, lat="lat_raw", lon="long_raw").select("incident_number", "lat", "lon")


LOCATED = "SELECT incident_number, TRY_CAST(lat_raw AS DOUBLE) AS lat, TRY_CAST(long_raw AS DOUBLE) AS lon FROM {inc}"


@query("drop_missing_coords", oracle(f"SELECT * FROM ({LOCATED}) WHERE lat IS NOT NULL AND lon IS NOT NULL"))
def drop_missing_coords(spark, sf_dir):
    return clean.drop_missing_coords(_located(spark, sf_dir), "lat", "lon")


@query("valid_coordinates", oracle(f"SELECT * FROM ({LOCATED}) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"))
def valid_coordinates(spark, sf_dir):
    return clean.valid_coordinates(_located(spark, sf_dir), "lat", "lon")


@query("fill_unknown_district", oracle("SELECT incident_number, coalesce(district, 'UNKNOWN') AS district FROM {inc}"))
def fill_unknown_district(spark, sf_dir):
    return clean.fill_unknown_district(view(spark, sf_dir, "inc").select("incident_number", "district"))


@query("drop_if_present", oracle("SELECT incident_number, offense_code_raw, occurred_raw, hour_raw FROM {inc}"))
def drop_if_present(spark, sf_dir):
    return clean.drop_if_present(view(spark, sf_dir, "inc"), ["lat_raw", "long_raw", "district", "_id"])


@query("cast_categoricals", oracle("SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, round(value, 6) + 0.0 AS value, typeof(CAST(value AS VARCHAR)) = 'VARCHAR' AS is_text FROM {ev}"))
def cast_categoricals(spark, sf_dir):
    rows = clean.cast_categoricals(view(spark, sf_dir, "ev"), ["user_id", "value", "street"])
    number = F.round(F.col("value").cast("double"), 6).alias("value")
    return rows.select("event_id", "user_id", number, F.lit(dict(rows.dtypes)["value"] == "string").alias("is_text"))


@query("rename_offense_type", oracle("SELECT o_orderkey AS order_id, substr(o_orderpriority, 3) AS offense_type FROM orders"))
def rename_offense_type(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("substr(o_orderpriority, 3)").alias("name"))
    return landing.standardize_columns(rows, {"o_orderkey": "order_id", "name": "offense_type", "NAME_2": "offense_name"})


@query("filter_by_series", oracle("SELECT ds, y FROM {daily} WHERE district = 'BUILDING'"))
def filter_by_series(spark, sf_dir):
    return clean.filter_by_series(incident_daily(spark, sf_dir), "district", "BUILDING").select("ds", "y")


@query(
    "filter_date_range",
    oracle("""SELECT 'closed' AS kind, district, ds, y FROM {daily} WHERE ds BETWEEN DATE '1996-02-10' AND DATE '1998-03-01'
              UNION ALL
              SELECT 'open' AS kind, district, ds, y FROM {daily} WHERE ds > DATE '1996-02-10' AND ds <= DATE '1998-03-01'"""),
)
def filter_date_range(spark, sf_dir):
    daily, first, last = incident_daily(spark, sf_dir), F.to_date(F.lit("1996-02-10")), F.to_date(F.lit("1998-03-01"))
    closed = clean.filter_date_range(daily, "ds", first, last).withColumn("kind", F.lit("closed"))
    half_open = clean.filter_date_range(daily, "ds", first, last, open_start=True).withColumn("kind", F.lit("open"))
    return closed.unionByName(half_open)


LOOKUP_SQL = """SELECT incident_number, offense_code, name AS offense_type FROM {inc_typed}
                JOIN {codes} ON offense_code = code WHERE name IS NOT NULL"""


@query("offense_lookup_join", oracle(LOOKUP_SQL))
def offense_lookup_join(spark, sf_dir):
    rows = typed_incidents(spark, sf_dir).select("incident_number", "offense_code")
    joined = lookup.offense_lookup_join(rows, view(spark, sf_dir, "codes"), "offense_code", "code", "name")
    return joined.select("incident_number", "offense_code", "offense_type")


@query("drop_null_offense", oracle(LOOKUP_SQL))
def drop_null_offense(spark, sf_dir):
    codes = landing.standardize_columns(view(spark, sf_dir, "codes"), {"code": "offense_code", "name": "offense_type"})
    rows = typed_incidents(spark, sf_dir).select("incident_number", "offense_code")
    return lookup.drop_null_offense(rows.join(codes, "offense_code", "left"), "offense_type").select(
        "incident_number", "offense_code", "offense_type"
    )


@query(
    "unmatched_codes",
    oracle("""SELECT count(*) AS unmatched FROM {inc_typed}
              WHERE offense_code IS NULL OR offense_code NOT IN (SELECT code FROM {codes} WHERE name IS NOT NULL)"""),
)
def unmatched_codes(spark, sf_dir):
    return lookup.unmatched_codes(
        typed_incidents(spark, sf_dir), view(spark, sf_dir, "codes"), "offense_code", "code", "name"
    )


# Freshness and quality ------------------------------------------------------------------------------------------


@query(
    "data_freshness",
    oracle(f"""SELECT CAST(m AS DATE) AS latest_date, d AS days_old,
               CASE WHEN d > 90 THEN 'warning' WHEN d > 30 THEN 'info' ELSE 'fresh' END AS level
               FROM (SELECT max(ts) AS m, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 86400000000)
                     AS BIGINT) AS d FROM {{inc_typed}})"""),
)
def data_freshness(spark, sf_dir):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return quality.data_freshness(typed_incidents(spark, sf_dir), "ts", as_of)


CHECKS_SQL = """
    SELECT 'empty' AS "check", 'ERROR' AS severity, n AS observed, 0 AS reference, n = 0 AS fired, 'no rows' AS message FROM profile
    UNION ALL SELECT 'dates', 'WARNING', bad, n, n > 0 AND bad > n * 0.1,
        format('{} of {} times are unreadable, {:.1f}%', bad, n, bad * 100.0 / n) FROM profile
    UNION ALL SELECT 'districts', 'WARNING', missing, n, n > 0 AND missing > 0, format('{} of {} districts are empty', missing, n) FROM profile
    UNION ALL SELECT 'coverage', 'WARNING', days, span, span > 0 AND days < span * 0.8,
        format('{} days occur in a range of {}, {:.1f}%', days, span, days * 100.0 / span) FROM profile
    UNION ALL SELECT 'span', 'WARNING', span, 3650, span > 3650, format('over ten years, from {} until {}', oldest, newest) FROM profile
"""
PROFILE_SQL = """
    SELECT count(*) AS n, count(*) FILTER (ts IS NULL) AS bad, count(*) FILTER (missing_district) AS missing,
           count(DISTINCT CAST(ts AS DATE)) AS days,
           CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS span,
           CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS oldest, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS newest
    FROM (SELECT TRY_CAST(occurred_raw AS TIMESTAMP) AS ts, district IS NULL AS missing_district FROM {inc})
"""


def _checks_text(condition: str) -> str:
    text = CHECKS_SQL.replace("FROM profile", f"FROM ({PROFILE_SQL})")
    return (
        f'SELECT "check", severity, CAST(observed AS BIGINT) AS observed, CAST(reference AS BIGINT) AS reference, fired, message '
        f"FROM ({text}) WHERE {condition}"
    )


def _checks_sql(condition: str) -> str:
    return oracle(_checks_text(condition))


def _checks(spark, sf_dir):
    rows = typed_incidents(spark, sf_dir)
    return quality.quality_checks(quality.quality_profile(rows, "ts", "district"))


@query("validate_data", _checks_sql("fired"))
def validate_data(spark, sf_dir):
    issues = quality.validate_data(typed_incidents(spark, sf_dir), "ts", "district")
    return issues.withColumn("fired", F.lit(True))


def _register_check(name: str, check: str) -> None:
    @query(name, _checks_sql(f"\"check\" = '{check}'"))
    def one_check(spark, sf_dir):
        return _checks(spark, sf_dir).filter(F.col("check") == check)


for _name, _check in {
    "validate_empty": "empty",
    "validate_dates": "dates",
    "validate_districts": "districts",
    "validate_coverage": "coverage",
    "validate_span": "span",
}.items():
    _register_check(_name, _check)


# Scalar functions ------------------------------------------------------------------------------------------------


@query(
    "normalize_name",
    r"""SELECT p_partkey, replace(replace(replace(replace(replace(replace(replace(replace(replace(
           concat(p_name, '/', p_type, ':', p_brand, '|x\y?*"<>'), '/', '_'), '\', '_'), ':', '_'), '|', '_'),
           '?', ''), '*', ''), '"', ''), '<', ''), '>', '') AS safe_name FROM part""",
)
def normalize_name(spark, sf_dir):
    name = F.concat_ws("", "p_name", F.lit("/"), "p_type", F.lit(":"), "p_brand", F.lit('|x\\y?*"<>'))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_name(name).alias("safe_name"))


@query("day_of_year", oracle("SELECT event_id, CAST(dayofyear(ts) AS INT) AS day_of_year FROM {ev}"))
def day_of_year(spark, sf_dir):
    return view(spark, sf_dir, "ev").select("event_id", coerce.day_of_year(F.col("ts")).alias("day_of_year"))


@query("to_day", oracle("SELECT event_id, CAST(ts AS DATE) AS day FROM {ev}"))
def to_day(spark, sf_dir):
    return view(spark, sf_dir, "ev").select("event_id", coerce.to_day(F.col("ts")).alias("day"))


@query("utc_naive", oracle("SELECT event_id, ts - INTERVAL 5 HOUR AS utc FROM {ev}"))
def utc_naive(spark, sf_dir):
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+05:00"))
    return view(spark, sf_dir, "ev").select("event_id", coerce.utc_naive(zoned.cast("timestamp")).alias("utc"))


@query("parse_iso_timestamp", oracle("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM {ev}"))
def parse_iso_timestamp(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return view(spark, sf_dir, "ev").select("event_id", coerce.parse_iso_timestamp(iso).alias("shown"))


@query("radians", oracle(f"""SELECT row_id, {rounds('phi', 'lam', digits=9)} FROM (
    SELECT row_id, radians(lat) AS phi, radians(lon) AS lam FROM {{grid}})"""))
def radians(spark, sf_dir):
    return rounded(view(spark, sf_dir, "grid").withColumns(geo.angles("lat", "lon")).select("row_id", "phi", "lam"), 9)


@query(
    "haversine",
    oracle(f"""SELECT row_id, {rounds('distance', digits=9)} FROM (
               SELECT row_id, 2 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(42.3)) / 2), 2)
                   + cos(radians(42.3)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(-71.1)) / 2), 2)))) AS distance
               FROM {{grid}})"""),
)
def haversine(spark, sf_dir):
    centre = F.radians(F.lit(42.3)), F.radians(F.lit(-71.1))
    distance = geo.haversine(*centre, F.radians("lat"), F.radians("lon"))
    return rounded(view(spark, sf_dir, "grid").select("row_id", distance.alias("distance")), 9)


@query(
    "web_mercator",
    oracle(f"""SELECT row_id, {rounds('x', 'y', digits=3)} FROM (
               SELECT row_id, 6378137.0 * radians(lon) AS x, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y
               FROM {{grid}})"""),
)
def web_mercator(spark, sf_dir):
    x, y = geo.web_mercator_x(F.col("lon")).alias("x"), geo.web_mercator_y(F.col("lat")).alias("y")
    return rounded(view(spark, sf_dir, "grid").select("row_id", x, y), 3)


CAP_SQL = """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 + 1.5 * 10 THEN 25 + 1.5 * 10
             WHEN l_quantity < 25 - 1.5 * 10 THEN 25 - 1.5 * 10 ELSE l_quantity END AS capped FROM lineitem"""


@query("cap_value", f"SELECT l_orderkey, l_linenumber, CAST(capped AS DOUBLE) AS capped FROM ({CAP_SQL})")
def cap_value(spark, sf_dir):
    capped = stats.cap_value(F.col("l_quantity"), F.lit(25.0), F.lit(10.0), 1.5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", capped.alias("capped"))


@query(
    "day_arithmetic",
    """SELECT o_orderkey, CAST(floor((CAST(o_orderdate AS DATE) - DATE '1995-01-01') * CAST(0.8 AS DOUBLE)) AS INT) AS train_days,
       CAST(o_orderdate AS DATE) + 60 AS two_months_on FROM orders""",
)
def day_arithmetic(spark, sf_dir):
    day = F.to_date("o_orderdate")
    elapsed = F.date_diff(day, F.to_date(F.lit("1995-01-01")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", stats.ratio_days(elapsed, 0.8).alias("train_days"), F.date_add(day, 60).alias("two_months_on")
    )


@query(
    "improvement_pct",
    f"""SELECT l_orderkey, l_linenumber, {rounds('improvement')} FROM (
        SELECT l_orderkey, l_linenumber, (l_discount - l_tax) / nullif(l_discount, 0) * 100 AS improvement FROM lineitem)""",
)
def improvement_pct(spark, sf_dir):
    gain = stats.improvement_pct(F.col("l_discount"), F.col("l_tax"))
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gain.alias("improvement")))


@query(
    "quality_flag",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL WHEN l_discount > l_tax THEN 'improves'
       ELSE 'warning' END AS flag FROM lineitem""",
)
def quality_flag(spark, sf_dir):
    gain = stats.improvement_pct(F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", stats.quality_flag(gain).alias("flag"))


# Plans -----------------------------------------------------------------------------------------------------------

RAW_NAMES = {
    "incident_number": "INCIDENT_NUMBER", "offense_code_raw": "OFFENSE_CODE", "occurred_raw": "OCCURRED_ON_DATE",
    "district": "DISTRICT", "hour_raw": "HOUR", "lat_raw": "Lat", "long_raw": "Long",
}


@query(
    "preprocess_data",
    oracle("""SELECT incident_number, offense_code, ts AS occurred, district, day_of_year, hour, lat, lon, offense_type
              FROM (SELECT i.incident_number, TRY_CAST(offense_code_raw AS INT) AS offense_code,
                           TRY_CAST(occurred_raw AS TIMESTAMP) AS ts, coalesce(district, 'UNKNOWN') AS district,
                           CAST(dayofyear(TRY_CAST(occurred_raw AS TIMESTAMP)) AS INT) AS day_of_year,
                           TRY_CAST(hour_raw AS INT) AS hour, TRY_CAST(lat_raw AS DOUBLE) AS lat,
                           TRY_CAST(long_raw AS DOUBLE) AS lon FROM {inc} i)
              JOIN (SELECT code, name AS offense_type FROM {codes} WHERE name IS NOT NULL) ON offense_code = code
              WHERE lat IS NOT NULL AND lon IS NOT NULL"""),
)
def preprocess_data(spark, sf_dir):
    raw = view(spark, sf_dir, "inc").withColumnsRenamed(RAW_NAMES)
    raw = raw.withColumns({"YEAR": F.lit("n/a"), "MONTH": F.lit("n/a"), "SHOOTING": F.lit("0")})
    codes = view(spark, sf_dir, "codes").select(F.col("code").cast("string").alias("CODE"), F.col("name").alias("NAME"))
    return enrich(raw, codes).select(
        F.col("INCIDENT_NUMBER").alias("incident_number"),
        F.col("OFFENSE_CODE").alias("offense_code"),
        F.col("OCCURRED_ON_DATE").alias("occurred"),
        F.col("DISTRICT").alias("district"),
        F.col("DAY_OF_YEAR").alias("day_of_year"),
        F.col("HOUR").alias("hour"),
        F.col("Lat").alias("lat"),
        F.col("Long").alias("lon"),
        F.col("OFFENSE_TYPE").alias("offense_type"),
    )


# Daily counts, freshness, issues and metadata, all from the same pass.
@query(
    "load_and_preprocess_data",
    oracle(f"""SELECT 'daily' AS output, district AS name, ds, y AS value, NULL AS note FROM {{daily}}
        UNION ALL SELECT 'issue', "check", NULL, observed, severity || ': ' || message FROM ({_checks_text("fired")})
        UNION ALL SELECT 'freshness', CASE WHEN d > 90 THEN 'warning' WHEN d > 30 THEN 'info' ELSE 'fresh' END, CAST(m AS DATE), d, NULL
            FROM (SELECT max(ts) AS m, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 86400000000) AS BIGINT) AS d FROM {{inc_typed}})
        UNION ALL SELECT 'metadata', string_agg(DISTINCT nullif(district, 'UNKNOWN'), ',' ORDER BY nullif(district, 'UNKNOWN')), CAST(min(ts) AS DATE), count(*),
            strftime(max(ts), '%Y-%m-%d') FROM {{inc_typed}}"""),
)
def load_and_preprocess_data(spark, sf_dir):
    loaded = daily_plan.load(typed_incidents(spark, sf_dir), "ts", "district", F.lit(AS_OF).cast("timestamp_ntz"))
    none = F.lit(None)

    def part(output, df, name, ds, value, note):
        kinds = {"name": "string", "ds": "date", "value": "bigint", "note": "string"}
        columns = [c.cast(kind).alias(k) for c, (k, kind) in zip((name, ds, value, note), kinds.items(), strict=True)]
        return df.select(F.lit(output).alias("output"), *columns)

    metadata = loaded.metadata
    parts = [
        part("daily", loaded.daily, F.col("district"), F.col("ds"), F.col("y"), none),
        part("issue", loaded.issues, F.col("check"), none, F.col("observed"), F.concat_ws(": ", "severity", "message")),
        part("freshness", loaded.freshness, F.col("level"), F.col("latest_date"), F.col("days_old"), none),
        part("metadata", metadata, F.concat_ws(",", "districts"), F.col("date_range.start"), F.col("total_records"), F.col("date_range.end")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("distinct_series", oracle("SELECT district, count(*) OVER () AS series FROM (SELECT DISTINCT district FROM {inc_typed})"))
def distinct_series(spark, sf_dir):
    from tallyground.operators.series import distinct_values

    names = distinct_values(filled_incidents(spark, sf_dir), "district")
    return names.withColumn("series", names.agg(F.count("*")).scalar())
