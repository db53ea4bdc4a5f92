"""Incident-like inputs derived from the test tables.

The texts in VIEWS run in both engines; braces name the tables or views they read. ``CTES`` are
further steps of the expected results and exist in SQL only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyground.functions.coerce import coerce_integer, coerce_timestamp
from tallyground.operators.clean import fill_unknown_district
from tallyground.plans.daily import daily

VIEWS = {
    # Multi-year incidents with dirty fields.
    "inc": """
        SELECT CAST(o_orderkey AS STRING) AS incident_number,
               CASE WHEN o_orderkey % 97 = 0 THEN 'bad' ELSE substr(o_orderpriority, 1, 1) END AS offense_code_raw,
               CASE WHEN o_orderkey % 89 = 0 THEN 'not a date'
                    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS occurred_raw,
               CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS district,
               CASE WHEN o_orderkey % 53 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 24 AS STRING) END AS hour_raw,
               CASE WHEN o_orderkey % 47 = 0 THEN '' WHEN o_orderkey % 47 = 1 THEN '200.5'
                    ELSE CAST(42.25 + 0.0625 * (o_custkey % 16) AS STRING) END AS lat_raw,
               CASE WHEN o_orderkey % 43 = 0 THEN 'west'
                    ELSE CAST(-71.25 + 0.0625 * (o_custkey % 8) AS STRING) END AS long_raw
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
    """,
    # Lookup with one missing code and one null name.
    "codes": """
        SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) AS code,
               CASE WHEN substr(o_orderpriority, 1, 1) = '4' THEN NULL ELSE substr(o_orderpriority, 3) END AS name
        FROM {orders} WHERE substr(o_orderpriority, 1, 1) <> '5'
    """,
    # Sub-day timestamps over one month.
    "ev": """
        SELECT event_id, ts, concat('D', CAST(user_id % 12 AS STRING)) AS district, event_type AS offense,
               user_id, value
        FROM {events}
    """,
    # A stored table and a batch that overlaps its last days.
    "existing": "SELECT * FROM {ev} WHERE ts < TIMESTAMP '2024-01-24 00:00:00'",
    "batch": "SELECT * FROM {ev} WHERE ts >= TIMESTAMP '2024-01-18 00:00:00'",
    # A dense grid of positions with types and clusters; cluster -1 is noise.
    "grid": """
        SELECT l_orderkey * 8 + l_linenumber AS row_id, CAST(42.2 + (l_partkey % 100) * 0.002 AS DOUBLE) AS lat,
               CAST(-71.2 + (l_suppkey % 100) * 0.002 AS DOUBLE) AS lon, l_returnflag AS type, l_suppkey % 8 - 1 AS cluster
        FROM {lineitem}
    """,
}

_GEO = """
    SELECT vec_id, label, 42.32 + 0.03 * CAST(embedding[{first}] AS DOUBLE) + 0.05 * (label % 3) AS lat,
           -71.08 + 0.03 * CAST(embedding[{second}] AS DOUBLE) + 0.05 * (label % 2) AS lon,
           o_orderdate AS occurred
    FROM {embeddings} JOIN {orders} ON vec_id = o_orderkey
"""
GEO_SPARK = _GEO.replace("{first}", "0").replace("{second}", "1")
GEO_DUCK = _GEO.replace("{first}", "1").replace("{second}", "2")

HOLIDAY_CASE = """
    CASE WHEN month(ds) = 1 AND day(ds) = 1 THEN 'New Year''s Day'
         WHEN month(ds) = 1 AND dayofweek(ds) = 1 AND day(ds) BETWEEN 15 AND 21 THEN 'Martin Luther King Jr. Day'
         WHEN month(ds) = 2 AND dayofweek(ds) = 1 AND day(ds) BETWEEN 15 AND 21 THEN 'Washington''s Birthday'
         WHEN month(ds) = 5 AND dayofweek(ds) = 1 AND day(ds) >= 25 THEN 'Memorial Day'
         WHEN month(ds) = 6 AND day(ds) = 19 AND year(ds) >= 2021 THEN 'Juneteenth National Independence Day'
         WHEN month(ds) = 7 AND day(ds) = 4 THEN 'Independence Day'
         WHEN month(ds) = 9 AND dayofweek(ds) = 1 AND day(ds) <= 7 THEN 'Labor Day'
         WHEN month(ds) = 10 AND dayofweek(ds) = 1 AND day(ds) BETWEEN 8 AND 14 THEN 'Columbus Day'
         WHEN month(ds) = 11 AND day(ds) = 11 THEN 'Veterans Day'
         WHEN month(ds) = 11 AND dayofweek(ds) = 4 AND day(ds) BETWEEN 22 AND 28 THEN 'Thanksgiving Day'
         WHEN month(ds) = 12 AND day(ds) = 25 THEN 'Christmas Day' END
"""

Z80 = "1.2815515655446004"


def fit_ctes(prefix: str, source: str, keys: str, yearly: str, holidays: bool) -> dict[str, str]:
    """SQL steps of the closed-form model on ``source``: effects per row, then models and effect tables."""
    p, w = prefix, f"PARTITION BY {keys}"
    holiday = HOLIDAY_CASE if holidays else "CAST(NULL AS VARCHAR)"
    return {
        f"{p}1": f"""SELECT *, min(ds) OVER w AS t0, CAST(ds - min(ds) OVER w AS DOUBLE) AS t, dayofweek(ds) + 1 AS wd,
                     CASE WHEN {yearly} THEN month(ds) END AS mo, {holiday} AS hol
                     FROM {{{source}}} WINDOW w AS ({w})""",
        f"{p}2": f"""SELECT *, coalesce(covar_pop(y, t) OVER w / nullif(var_pop(t) OVER w, 0), 0) AS slope,
                     avg(y) OVER w AS my, avg(t) OVER w AS mt FROM {{{p}1}} WINDOW w AS ({w})""",
        f"{p}3": f"SELECT *, my - slope * mt AS intercept, y - (my - slope * mt + slope * t) AS r1 FROM {{{p}2}}",
        f"{p}4": f"SELECT *, avg(r1) OVER ({w}, wd) AS we FROM {{{p}3}}",
        f"{p}5": f"SELECT *, r1 - we AS r2, CASE WHEN mo IS NOT NULL THEN avg(r1 - we) OVER ({w}, mo) END AS ye "
                 f"FROM {{{p}4}}",
        f"{p}6": f"SELECT *, r2 - coalesce(ye, 0) AS r3, CASE WHEN hol IS NOT NULL THEN "
                 f"avg(r2 - coalesce(ye, 0)) OVER ({w}, hol) END AS he FROM {{{p}5}}",
        f"{p}_model": f"""SELECT {keys}, any_value(t0) AS t0, any_value(slope) AS slope,
                          any_value(intercept) AS intercept, stddev_samp(r3 - coalesce(he, 0)) AS sigma,
                          max(ds) AS last_day, count(*) AS n FROM {{{p}6}} GROUP BY {keys}""",
        f"{p}_weekly": f"SELECT {keys}, wd, any_value(we) AS we FROM {{{p}6}} GROUP BY {keys}, wd",
        f"{p}_yearly": f"SELECT {keys}, mo, any_value(ye) AS ye FROM {{{p}6}} WHERE mo IS NOT NULL GROUP BY {keys}, mo",
        f"{p}_holiday": f"SELECT {keys}, hol, any_value(he) AS he FROM {{{p}6}} WHERE hol IS NOT NULL "
                        f"GROUP BY {keys}, hol",
    }


def score_cte(prefix: str, calendar: str, keys: str) -> str:
    """SQL of the components for ``calendar`` rows, which hold the model columns and ``ds``."""
    p = prefix
    names = [k.strip() for k in keys.split(",")]
    listed = ", ".join(f"c.{k}" for k in names)

    def on(table: str) -> str:
        return " AND ".join(f"c.{k} = {table}.{k}" for k in names)

    return f"""
        SELECT *, trend + weekly + yearly + holidays AS yhat,
               trend + weekly + yearly + holidays - {Z80} * coalesce(sigma, 0) AS yhat_lower,
               trend + weekly + yearly + holidays + {Z80} * coalesce(sigma, 0) AS yhat_upper
        FROM (SELECT {listed}, c.ds, c.sigma, c.intercept + c.slope * (c.ds - c.t0) AS trend,
                     coalesce(we, 0) AS weekly, coalesce(ye, 0) AS yearly, coalesce(he, 0) AS holidays
              FROM (SELECT *, {HOLIDAY_CASE} AS h FROM {{{calendar}}}) c
              LEFT JOIN {{{p}_weekly}} a ON {on('a')} AND dayofweek(c.ds) + 1 = a.wd
              LEFT JOIN {{{p}_yearly}} b ON {on('b')} AND month(c.ds) = b.mo
              LEFT JOIN {{{p}_holiday}} h ON {on('h')} AND c.h = h.hol)
    """


def _haversine(a: str, b: str) -> str:
    return (
        f"2 * asin(least(1.0, sqrt(pow(sin(({b}.phi - {a}.phi) / 2), 2) + "
        f"cos({a}.phi) * cos({b}.phi) * pow(sin(({b}.lam - {a}.lam) / 2), 2))))"
    )


def dbscan_ctes(prefix: str, source: str, kind: str, row_id: str, min_samples: int, eps: str = "0.0001") -> dict[str, str]:
    """SQL of the clustering by comparing all rows of a kind: neighbours, core, closure, labels."""
    p = prefix
    return {
        f"{p}_pts": f"SELECT {kind} AS kind, {row_id} AS point, radians(lat) AS phi, radians(lon) AS lam FROM {{{source}}}",
        f"{p}_near": f"""SELECT a.kind, a.point AS p, b.point AS q FROM {{{p}_pts}} a JOIN {{{p}_pts}} b
                         ON a.kind = b.kind AND {_haversine('a', 'b')} <= {eps}""",
        f"{p}_core": f"SELECT kind, p, count(*) AS n FROM {{{p}_near}} GROUP BY kind, p HAVING count(*) >= {min_samples}",
        f"{p}_link": f"""SELECT n.p, n.q FROM {{{p}_near}} n JOIN {{{p}_core}} a ON n.p = a.p
                         JOIN {{{p}_core}} b ON n.q = b.p""",
        f"{p}_reach": f"SELECT p AS root, p AS q FROM {{{p}_core}} UNION SELECT r.root, l.q FROM {p}_reach r "
                      f"JOIN {{{p}_link}} l ON r.q = l.p",
        f"{p}_root": f"SELECT c.kind, r.q AS p, min(r.root) AS root FROM {{{p}_reach}} r JOIN {{{p}_core}} c ON r.q = c.p "
                     f"GROUP BY c.kind, r.q",
        f"{p}_num": f"SELECT kind, p, dense_rank() OVER (PARTITION BY kind ORDER BY root) - 1 AS cluster FROM {{{p}_root}}",
        f"{p}_label": f"""SELECT s.point, coalesce(c.cluster, (SELECT min(u.cluster) FROM {{{p}_near}} n
                          JOIN {{{p}_num}} u ON n.q = u.p WHERE n.p = s.point), -1) AS cluster
                          FROM {{{p}_pts}} s LEFT JOIN {{{p}_num}} c ON s.point = c.p""",
    }


CTES = {
    "geo": GEO_DUCK,
    "inc_typed": """
        SELECT incident_number, TRY_CAST(offense_code_raw AS INT) AS offense_code,
               TRY_CAST(occurred_raw AS TIMESTAMP) AS ts, coalesce(district, 'UNKNOWN') AS district
        FROM {inc}
    """,
    "daily": "SELECT district, CAST(ts AS DATE) AS ds, count(*) AS y FROM {inc_typed} WHERE ts IS NOT NULL GROUP BY ALL",
    "split": """
        SELECT a AS train_start, a + train_days AS train_end, a + train_days + test_days AS test_end,
               z + 1 AS future_start, z + 61 AS future_end
        FROM (SELECT min(ds) AS a, max(ds) AS z,
                     CAST(floor((max(ds) - min(ds)) * CAST(0.8 AS DOUBLE)) AS INT) AS train_days,
                     CAST(floor((max(ds) - min(ds)) * CAST(0.15 AS DOUBLE)) AS INT) AS test_days FROM {daily})
    """,
    "gate": """
        SELECT district FROM {daily}, {split} WHERE ds BETWEEN train_start AND train_end
        GROUP BY district HAVING count(*) >= 10
    """,
    "fixed_gate": """
        SELECT district FROM {daily} WHERE ds BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'
        GROUP BY district HAVING count(*) >= 10
    """,
    "phases": """
        SELECT district, ds, y, 'initial' AS phase FROM {daily} JOIN {gate} USING (district), {split}
        WHERE ds BETWEEN train_start AND train_end
        UNION ALL
        SELECT district, ds, y, 'final' AS phase FROM {daily} JOIN {gate} USING (district), {split}
        WHERE ds <= test_end
    """,
    "capped": """
        SELECT district, phase, ds,
               CASE WHEN y - m > 3 * s THEN m + 3 * s WHEN m - y > 3 * s THEN m - 3 * s ELSE y END AS y
        FROM (SELECT *, avg(y) OVER w AS m, stddev_samp(y) OVER w AS s FROM {phases}
              WINDOW w AS (PARTITION BY district, phase))
    """,
    "train": "SELECT district, ds, y FROM {capped} WHERE phase = 'initial'",
    "test": """
        SELECT district, ds, y FROM {daily} JOIN {gate} USING (district), {split}
        WHERE ds > train_end AND ds <= test_end
    """,
    **fit_ctes("fit", "capped", "district, phase", "TRUE", True),
    "test_days": """
        SELECT m.*, CAST(unnest(generate_series(m.t0, l.last_test, INTERVAL 1 DAY)) AS DATE) AS ds
        FROM {fit_model} m JOIN (SELECT district, max(ds) AS last_test FROM {test} GROUP BY district) l
             ON m.district = l.district
        WHERE m.phase = 'initial'
    """,
    "future_days": """
        SELECT m.*, CAST(unnest(generate_series(s.future_start, s.future_end, INTERVAL 1 DAY)) AS DATE) AS ds
        FROM {fit_model} m, {split} s WHERE m.phase = 'final'
    """,
    "scored": score_cte("fit", "test_days", "district, phase"),
    "future": score_cte("fit", "future_days", "district, phase"),
    "base_rows": "SELECT *, row_number() OVER (PARTITION BY district ORDER BY ds DESC) AS r FROM {train}",
    "base": """
        SELECT district, max(y) FILTER (r = 1) AS naive, avg(y) FILTER (r <= 7) AS ma7, avg(y) FILTER (r <= 30) AS ma30
        FROM {base_rows} GROUP BY district
    """,
    "base_errors": """
        SELECT district, avg(abs(y - naive)) AS naive_mae, avg(abs(y - ma7)) AS ma7_mae, avg(abs(y - ma30)) AS ma30_mae
        FROM {test} JOIN {base} USING (district) GROUP BY district
    """,
    "errors": """
        SELECT t.district, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse,
               avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) * 100 AS mape,
               avg(CASE WHEN y >= yhat_lower AND y <= yhat_upper THEN 1.0 ELSE 0.0 END) AS coverage,
               count(*) AS test_samples
        FROM {test} t JOIN {scored} f ON t.district = f.district AND t.ds = f.ds GROUP BY t.district
    """,
    "metrics": """
        SELECT e.*, naive_mae AS baseline_naive_mae, ma7_mae AS baseline_ma7_mae, ma30_mae AS baseline_ma30_mae,
               (naive_mae - mae) / nullif(naive_mae, 0) * 100 AS improvement_pct,
               CASE WHEN (naive_mae - mae) / nullif(naive_mae, 0) > 0 THEN 'improves'
                    WHEN naive_mae <> 0 THEN 'warning' END AS quality
        FROM {errors} e JOIN {base_errors} b ON e.district = b.district
    """,
    # Actual and predicted pairs without a model: the mean of the series, on weekdays only.
    "fc_actual": "SELECT district, ds, y FROM {daily}",
    "fc": """
        SELECT district, ds, yhat, yhat - 1.2815515655446004 * s AS yhat_lower,
               yhat + 1.2815515655446004 * s AS yhat_upper
        FROM (SELECT district, ds, avg(y) OVER w AS yhat, stddev_samp(y) OVER w AS s FROM {daily}
              WINDOW w AS (PARTITION BY district))
        WHERE dayofweek(ds) BETWEEN 1 AND 5
    """,
    "ev_daily": "SELECT district, CAST(ts AS DATE) AS ds, count(*) AS y FROM {ev} GROUP BY ALL",
    "user_daily": "SELECT user_id, CAST(ts AS DATE) AS ds, count(*) AS y FROM {ev} GROUP BY ALL",
    "user_dense": """
        SELECT c.user_id, c.ds, coalesce(u.y, 0) AS y
        FROM (SELECT user_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
              FROM {user_daily} GROUP BY user_id) c
        LEFT JOIN {user_daily} u ON c.user_id = u.user_id AND c.ds = u.ds
    """,
    "merged_pool": """
        SELECT *, 0 AS source_rank FROM {existing}
        UNION ALL SELECT *, 1 AS source_rank FROM {batch} WHERE event_id NOT IN (SELECT event_id FROM {existing})
    """,
    "merged": """
        SELECT event_id, hour, district, offense, user_id, value FROM (
            SELECT *, date_trunc('hour', ts) AS hour, row_number() OVER (
                PARTITION BY date_trunc('hour', ts), district, offense ORDER BY source_rank DESC, event_id DESC) AS r
            FROM {merged_pool}) WHERE r = 1
    """,
    "grid_counts": "SELECT type, cluster AS cluster_id, count(*) AS \"count\" FROM {grid} WHERE cluster <> -1 GROUP BY ALL",
    "grid_rank": """
        SELECT *, row_number() OVER (PARTITION BY type ORDER BY "count" DESC, cluster_id) AS cluster_rank
        FROM {grid_counts}
    """,
    **dbscan_ctes("all", "geo", "0", "vec_id", 20),
    **dbscan_ctes("lab", "geo", "label", "vec_id", 5),
    "hot_rows": "SELECT g.*, l.cluster FROM {geo} g JOIN {lab_label} l ON g.vec_id = l.point",
    "hot_counts": "SELECT label, cluster, count(*) AS n FROM {hot_rows} WHERE cluster <> -1 GROUP BY ALL",
    "hot_top": """
        SELECT label, cluster FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, cluster) AS r
                                    FROM {hot_counts}) WHERE r = 1
    """,
    "hot_daily": """
        SELECT label, cluster, CAST(occurred AS DATE) AS ds, count(*) AS y
        FROM {hot_rows} JOIN {hot_top} USING (label, cluster) GROUP BY ALL
    """,
    "hot_dense": """
        SELECT c.label, c.cluster, c.ds, coalesce(d.y, 0) AS y, count(*) OVER (PARTITION BY c.label, c.cluster) AS days
        FROM (SELECT label, cluster, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
              FROM {hot_daily} GROUP BY label, cluster) c
        LEFT JOIN {hot_daily} d ON c.label = d.label AND c.cluster = d.cluster AND c.ds = d.ds
    """,
    "hot_fit_rows": "SELECT * FROM {hot_dense} WHERE days >= 14",
    **fit_ctes("hot", "hot_fit_rows", "label, cluster", "days >= 730", False),
    "hot_days": """
        SELECT m.*, CAST(unnest(generate_series(t0, last_day + 30, INTERVAL 1 DAY)) AS DATE) AS ds FROM {hot_model} m
    """,
    "hot_scored": score_cte("hot", "hot_days", "label, cluster"),
}

BRACES = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    text = GEO_SPARK if name == "geo" else VIEWS.get(name)
    if text is None:
        return table(spark, sf_dir, name)
    parts = {part: view(spark, sf_dir, part) for part in BRACES.findall(text)}
    return spark.sql(text, **parts)


def oracle(body: str) -> str:
    """Full SQL of an expected result; braces in ``body`` name views, steps or tables."""
    steps: dict[str, str] = {}

    def add(text: str) -> str:
        for name in BRACES.findall(text):
            known = CTES.get(name, VIEWS.get(name))
            if known is not None and name not in steps:
                body_text = add(known)
                steps.setdefault(name, body_text)
        return BRACES.sub(r"\1", text)

    last = add(body)
    if not steps:
        return last
    listed = ",\n".join(f"{name} AS ({text})" for name, text in steps.items())
    return f"WITH RECURSIVE {listed}\n{last}"


def typed_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inc`` with typed time and code, district still as it came."""
    return view(spark, sf_dir, "inc").select(
        "incident_number",
        coerce_integer(F.col("offense_code_raw")).alias("offense_code"),
        coerce_timestamp(F.col("occurred_raw")).alias("ts"),
        "district",
    )


def incident_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of ``inc`` per district."""
    return daily(typed_incidents(spark, sf_dir), "ts", "district")


def filled_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_unknown_district(typed_incidents(spark, sf_dir))
