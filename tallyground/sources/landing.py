"""Landed files: incident CSV, code lookup and the pages of the open-data interface."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyground import schemas
from tallyground.functions.coerce import error_message, minute_number


def require_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read ``path``; a missing path raises FileNotFoundError with a hint, never an empty frame."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"No data at '{path}'. Run the update plan first.") from problem
        raise


def scan_incidents_csv(
    spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_INCIDENT, encoding: str = "ISO-8859-1",
    line_breaks: bool = True,
) -> DataFrame:
    """Incident CSV as text columns, matched to the schema by the header row.

    Quoted fields may hold line breaks; then a file is read by one task. Without ``line_breaks`` Spark may split files.
    """
    return (
        spark.read.schema(schema)
        .options(header=True, encoding=encoding, enforceSchema=False, escape='"', multiLine=line_breaks)
        .csv(path)
    )


def scan_code_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Offense code lookup landed as CSV with the columns CODE and NAME; quoted names may hold line breaks."""
    return spark.read.schema(schemas.CODE_LOOKUP).options(header=True, enforceSchema=False, escape='"', multiLine=True).csv(path)


def read_pages(spark: SparkSession, path: str | list[str], record: T.StructType = schemas.RAW_INCIDENT) -> DataFrame:
    """Landed page envelopes, one JSON object per line."""
    return spark.read.schema(schemas.page_schema(record)).json(path)


def scan_api_pages(pages: DataFrame) -> DataFrame:
    """Records of the successful pages, with ``row_seq``, their place in the pull."""
    return (
        pages.filter("success")
        .select("offset", F.posexplode("result.records").alias("position", "record"))
        .select("record.*", (F.col("offset") + F.col("position")).alias("row_seq"))
    )


def api_page_errors(pages: DataFrame) -> DataFrame:
    """One row per failed page with its message."""
    return pages.filter(~F.coalesce(F.col("success"), F.lit(False))).select(
        "offset", error_message(F.col("error")).alias("error_message")
    )


def pages_until_short(pages: DataFrame, batch_size: int) -> DataFrame:
    """All landed records, marked by whether the pull was whole up to their page.

    ``complete`` is false for records that lie behind a failed page, or behind one shorter than ``batch_size``:
    something before them may be missing. Nothing is left out.
    """
    size = F.coalesce(F.size("result.records"), F.lit(0))
    gap = ~F.coalesce(F.col("success"), F.lit(False)) | (size < batch_size)
    first_gap = pages.filter(gap).agg(F.min("offset")).scalar()
    complete = first_gap.isNull() | (F.col("offset") <= first_gap)
    return pages.filter("success").select(complete.alias("complete"), F.inline("result.records"))


def incremental_pull(
    df: DataFrame, ts: str, start: datetime | Column, limit: int | None = None, tie_break: str | None = None
) -> DataFrame:
    """Rows after ``start`` in time order; ``limit`` is the page size of the pull. ``ts`` is zone-free.

    With a limit the rows are first counted per minute, which names the minute the limit falls into. Later rows
    are filtered out in the scan instead of every task sending its first ``limit`` rows to one.
    """
    order = [ts] if tie_break is None else [ts, tie_break]
    start = start if isinstance(start, Column) else F.lit(start)
    newer = df.filter(F.col(ts) > start)
    if limit is None:
        return newer.orderBy(*order)
    minute = minute_number(F.col(ts))
    full = _first_minute_reaching(newer.groupBy(minute.alias("minute")).agg(F.count("*").alias("n")), limit)
    return newer.filter(full.isNull() | (minute <= full)).orderBy(*order).limit(limit)


def _first_minute_reaching(minutes: DataFrame, limit: int) -> Column:
    """The first minute at which the running count reaches ``limit``, or NULL.

    Days are summed first, so that the running counts cover the days and then the minutes of one day.
    """
    minutes = minutes.withColumn("day", F.floor(F.col("minute") / 1440))
    total = F.sum("n").over(Window.orderBy("day"))
    days = minutes.groupBy("day").agg(F.sum("n").alias("n")).select("day", "n", total.alias("upto"))
    day = days.filter(F.col("upto") >= limit).agg(F.min_by(F.struct("day", F.col("upto") - F.col("n")), "day")).first()[0]
    if day is None:
        return F.lit(None).cast("bigint")
    running = F.lit(day[1]) + F.sum("n").over(Window.orderBy("minute"))
    inside = minutes.filter(F.col("day") == F.lit(day[0])).select("minute", running.alias("upto"))
    return F.lit(inside.filter(F.col("upto") >= limit).agg(F.min("minute")).first()[0])


def standardize_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that are present; the others stay as they are."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})
