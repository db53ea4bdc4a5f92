"""Versions of a stored table, each named by one small file.

Rows lie in folders by month and run, those of side tables in folders by run with the month as a column. A version file says
which run is live for each month; a new version takes effect when its file gets its name, in one step. Until then readers see the version before, also when the job ends between two months.
One writer at a time is assumed; a second one that publishes the same number fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Partition columns. No incident column may have these names, whatever its case.
MONTH_PART = "occurred_month_part"
RUN = "stored_run_part"
# How Spark names the folder of a missing partition value.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Version:
    """``months`` names the live run of each month; ``key`` and ``district`` the columns its side tables were made for."""

    number: int = 0
    months: dict[str, str] = field(default_factory=dict)
    schema: str = ""
    ts: str | None = None
    district: str | None = None
    key: str | None = None
    key_folders: int = 0


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    folder, files = _folder(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names(spark, f"{path}/_versions") if n.endswith(".json") and n[:-5].isdigit())


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Give a folder or file its name; False where the name is taken."""
    target, files = _folder(spark, new)
    return not files.exists(target) and files.rename(_folder(spark, old)[0], target)


def _load(spark: SparkSession, path: str, number: int) -> Version:
    file, files = _folder(spark, f"{path}/_versions/{number:010d}.json")
    stream = files.open(file)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(**json.loads(text))


def current(spark: SparkSession, path: str) -> Version | None:
    """The newest version, or None where nothing was ever published."""
    numbers = _numbers(spark, path)
    return _load(spark, path, numbers[-1]) if numbers else None


def publish(spark: SparkSession, path: str, version: Version) -> None:
    """Makes ``version`` the newest one."""
    final, files = _folder(spark, f"{path}/_versions/{version.number:010d}.json")
    draft, _ = _folder(spark, f"{path}/_versions/_draft-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(asdict(version)).encode()))
    out.close()
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"version {version.number} of '{path}' was published by another writer")


def staged_months(spark: SparkSession, path: str, run: str) -> list[str]:
    """The months for which ``run`` has written rows, from the names of folders."""
    pattern, files = _folder(spark, f"{path}/data/{MONTH_PART}=*/{RUN}={run}")
    return [s.getPath().getParent().getName().split("=", 1)[1] for s in files.globStatus(pattern) or []]


def replaced(version: Version, months: list[str], run: str, **changes) -> Version:
    """The next version, in which ``run`` is live for ``months``."""
    return replace(version, number=version.number + 1, months={**version.months, **dict.fromkeys(months, run)}, **changes)


def live(version: Version, months: list[str] | None = None) -> Column:
    """Whether a row is in a live run, of ``months`` only if given. Folders of other runs are not opened."""
    chosen = version.months if months is None else {m: r for m, r in version.months.items() if m in months}
    pair = F.concat_ws("/", F.coalesce(MONTH_PART, F.lit(NO_MONTH)), RUN).isin([f"{m}/{r}" for m, r in sorted(chosen.items())])
    return F.col(RUN).isin(sorted(set(chosen.values()))) & pair


def read_table(spark: SparkSession, path: str, name: str, schema: T.StructType, version: Version, months: list[str] | None = None) -> DataFrame:
    """The live rows of one of the tables below ``path``."""
    parts = T.StructType([f for f in schema if f.name not in (MONTH_PART, RUN)]).add(MONTH_PART, "string").add(RUN, "string")
    if not version.months:
        return spark.createDataFrame([], parts).drop(RUN)
    return spark.read.schema(parts).parquet(f"{path}/{name}").filter(live(version, months)).drop(RUN)


def ledger_numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions that have ledger entries, published or not."""
    return sorted(int(n.split("=", 1)[1]) for n in names(spark, f"{path}/ledger") if n.startswith("version="))


def clean(spark: SparkSession, path: str, keep: int) -> int:
    """Delete all but the newest ``keep`` versions, and the folders that none of those names; gives the oldest one kept.

    Readers that still work on an older version fail; ``keep`` is how far behind they may be.
    """
    numbers = _numbers(spark, path)
    kept = [_load(spark, path, n) for n in numbers[-keep:]]
    pairs = {pair for version in kept for pair in version.months.items()}
    runs = {run for _, run in pairs}
    for pattern in (f"data/{MONTH_PART}=*/{RUN}=*", f"profile/{RUN}=*", f"keys/*/{RUN}=*"):
        folder, files = _folder(spark, f"{path}/{pattern}")
        for status in files.globStatus(folder) or []:
            here = status.getPath()
            run, above = here.getName().split("=", 1)[1], here.getParent().getName().split("=", 1)[-1]
            if run not in runs or (pattern.startswith("data") and (above, run) not in pairs):
                files.delete(here, True)
    for number in numbers[:-keep]:
        file, files = _folder(spark, f"{path}/_versions/{number:010d}.json")
        files.delete(file, False)
    return kept[0].number if kept else 0
