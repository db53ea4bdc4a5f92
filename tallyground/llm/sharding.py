"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash; the hash covers the record's place
in the input, so neither a hot key nor repeated rows make a bucket large. Pass two gathers each bucket, puts it in the
order of the hashes, shuffles it with Spark's ``shuffle`` (a seeded Fisher-Yates) and writes it. The buckets one after
another are the shuffled table; record number i of it goes to shard ``i mod shards``, slot ``i div shards``, so the
counts of the shards are at most one apart (law ``rows``).

Cases: a null text has no bytes; nulls, ties and repeated rows in any column are records like others; an empty table
gives an empty result; all columns travel inside ``record``, so their names cannot clash with those of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyground.llm.frames import size_of
from tallyground.settings import cut_lineage

SHARDS = 40
BUCKET_BYTES = 16 << 20
ROW_BYTES = 16
SEED = 20_240_607
# The bucket counts are broadcast up to this many buckets (16 bytes each); beyond it the join is shuffled.
BROADCAST_BUCKETS = 1_000_000


def shuffled(docs: DataFrame, text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> tuple[DataFrame, int]:
    """``bucket, place, size, record`` in the shared folder, and the number of buckets."""
    rows, size = size_of(docs, text)
    buckets = max(1, math.ceil((size + ROW_BYTES * rows) / bucket_bytes))
    record = docs.select(
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"),
        F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("h"),
    )
    scattered = record.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets))).repartition(buckets, "bucket")
    gathered = scattered.groupBy("bucket").agg(F.collect_list(F.struct("h", "size", "record")).alias("all"))
    by_hash = F.array_sort("all", lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
    out = gathered.select("bucket", F.posexplode(F.shuffle(by_hash, seed)).alias("place", "r"))
    return cut_lineage(out.select("bucket", "place", "r.size", "r.record")), buckets


def shard(docs: DataFrame, text: str = "text", shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``record, size, shard, slot`` for every row."""
    written, buckets = shuffled(docs, text, bucket_bytes, seed)
    # One row per bucket; the running sum gives the number of its first record.
    counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("first"))
    number = F.col("first") + F.col("place")
    placed = written.join(F.broadcast(first) if buckets <= BROADCAST_BUCKETS else first, "bucket")
    return placed.select(
        "record", "size", F.pmod(number, F.lit(shards)).cast("int").alias("shard"), F.floor(number / shards).cast("long").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the rows of each file are in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
