"""Defaults of the forecasting and hotspot plans, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from datetime import date
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


# Defaults a user of the reference relies on.
@dataclass(frozen=True)
class ForecastSettings:
    use_fixed_dates: bool = False
    train_start: date = date(2023, 1, 1)
    train_end: date = date(2024, 12, 31)
    test_end: date = date(2025, 4, 4)
    train_ratio: float = 0.8
    test_ratio: float = 0.15
    future_months: int = 2
    forecast_start_offset_days: int = 1
    min_training_records: int = 10
    yearly_seasonality: bool = True
    weekly_seasonality: bool = True
    include_holidays: bool = True
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    outlier_threshold: float = 3.0
    interval_width: float = 0.8
    fallback_days: int = 30


@dataclass(frozen=True)
class HotspotSettings:
    eps: float = 0.0001
    min_samples: int = 20
    # Rows per type that are clustered; None takes all.
    sample_size: int | None = None
    seed: int = 42
    top_n: int = 5
    forecast_days: int = 30
    min_days_weekly: int = 14
    min_days_yearly: int = 730


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tallyground-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own, deleted at the end, only in a local
    session without that setting, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    Survives the loss of executors, and unlike ``checkpoint()`` does not compute the plan a second time.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no plan reads any more, whatever file system it is on."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
