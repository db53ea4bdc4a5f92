"""Product quantisation of integer vectors by k-means with Drake-Hamerly adaptive bounds.

Components become floor(1024 * x); vectors are cut into equal parts, each part position with its own codebook. A round
assigns every part to its nearest entry and replaces each entry by the floor of its parts' mean. All distances that
decide anything are exact integers; ties go to the lower index.

Between rounds a table in the shared folder keeps, per vector and part, the ``b`` closest entries in order, a lower bound
for each rank (it holds for all entries from that rank on; the last one is the outer bound for the entries that are not
listed) and an upper bound for the assigned entry. When entries move, bounds loosen by how far; a part whose upper bound
is still below the first lower bound keeps its entry without a look at the codebook. Otherwise the upper bound is made
exact, and only the ranks whose bounds do not exceed it are measured; if the outer bound is among them, all entries are.
``b`` starts at ``MOST_KEPT`` and shrinks to what all but ``FULL_SHARE`` of the parts needed. Bounds are kept in single precision,
rounded to the safe side.

Each round is one pass over that table. Tasks also write the sums of the parts that changed their entry; these are
added up by Spark, and the driver gets at most one number per component of the codebooks (their size is a parameter, not
a function of the rows). Codebooks are broadcast for that reason. The table before the last is deleted as soon as the
next one is written, so at most two exist.

Cases: null vectors and those that hold null or non-finite components are dropped; shorter vectors count as if filled up
with zeros to the longest one's length, rounded up to a multiple of ``parts`` (that changes no distance); components whose integer
lies beyond +-2**24 count as that; repeated rows each take part and get their own row; null ids sort last, equal ids by their vectors; fewer rows than entries give
smaller codebooks; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.settings import cut_lineage, remove_path, scratch_path

# The codebooks of the contract.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LIMIT = 1 << 24
MOST_KEPT, LEAST_KEPT = 16, 4
FULL_SHARE = 0.02
# Distances to all entries are taken for so many vectors at once.
ROWS_AT_ONCE = 4096
# Labels whose sums are broadcast; more of them are joined by a shuffle with salted keys.
FEW_LABELS = 100_000
SALTS = 32


@dataclass(frozen=True)
class Books:
    """Entries as ``parts x entries x width`` integers, and how far each has moved since the bounds were kept."""

    entry: np.ndarray
    moved: np.ndarray

    def distances(self, part: int, x: np.ndarray) -> np.ndarray:
        """Exact squared distances of the rows of ``x`` to all entries."""
        c = self.entry[part]
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
        if 4 * x.shape[1] * most * most < 1 << 53:  # then doubles hold every step exactly
            a, b = x.astype(np.float64), c.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
        out = np.zeros((len(x), len(c)), np.int64)
        for k in range(x.shape[1]):
            out += (x[:, k, None] - c[:, k]) ** 2
        return out

    def some(self, part: int, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Exact squared distances of each row of ``x`` to its own listed entries."""
        return ((x[:, None, :] - self.entry[part][near]) ** 2).sum(2)


@dataclass
class Bounds:
    """What is known about one part of a batch of vectors."""

    near: np.ndarray
    low: np.ndarray
    upper: np.ndarray
    needed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def measure(books: Books, part: int, x: np.ndarray, kept: int) -> Bounds:
    """Bounds from the distances to all entries."""
    entries = books.entry.shape[1]
    kept = min(kept, entries)
    most = min(kept + 1, entries)
    near = np.empty((len(x), kept), np.int64)
    low, upper = np.full((len(x), kept), np.inf), np.empty(len(x))
    for k in range(0, len(x), ROWS_AT_ONCE):
        rows = slice(k, k + ROWS_AT_ONCE)
        key = books.distances(part, x[rows]) * entries + np.arange(entries)  # ties to the lower index
        if most < entries:
            key = np.partition(key, most - 1, axis=1)[:, :most]
        key.sort(axis=1)
        near[rows] = key[:, :kept] % entries
        root = np.sqrt(key // entries)
        upper[rows], low[rows, : most - 1] = root[:, 0], root[:, 1:]
    return Bounds(near, _down(low), _up(upper))


def follow(books: Books, part: int, x: np.ndarray, bounds: Bounds) -> Bounds:
    """The same parts after the entries have moved; ``needed`` tells how many lower bounds gave way."""
    moved = books.moved[part]
    near, low = bounds.near.copy(), bounds.low.astype(np.float64)
    kept = near.shape[1]
    upper = bounds.upper + moved[near[:, 0]]
    low[:, :-1] -= moved[near[:, 1:]]
    low[:, -1] -= moved.max(initial=0)
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
    needed = (low <= upper[:, None]).sum(1)
    loose = np.flatnonzero(needed)
    upper[loose] = np.sqrt(books.some(part, x[loose], near[loose, :1])[:, 0])
    upper[loose] = np.nextafter(upper[loose], np.inf)
    needed[loose] = (low[loose] <= upper[loose, None]).sum(1)
    for z in range(1, kept):
        rows = np.flatnonzero(needed == z)
        if len(rows):
            entries = books.entry.shape[1]
            key = np.sort(books.some(part, x[rows], near[rows, : z + 1]) * entries + near[rows, : z + 1], axis=1)
            near[rows, : z + 1] = key % entries
            root = np.sqrt(key // entries)
            upper[rows] = root[:, 0]
            low[rows, :z] = np.minimum(root[:, 1:], low[rows, z, None])
    low, upper = _down(low), _up(upper)
    rows = np.flatnonzero(needed >= kept)
    if len(rows):
        whole = measure(books, part, x[rows], kept)
        near[rows], low[rows], upper[rows] = whole.near, whole.low, whole.upper
    return Bounds(near, low, upper, needed)


def _sum_by(code: np.ndarray, x: np.ndarray, entries: int) -> np.ndarray:
    """Per entry the sums of the components and, last, the number of rows."""
    out = np.zeros((entries, x.shape[1] + 1), np.int64)
    if len(code):
        order = np.argsort(code, kind="stable")
        heads = np.flatnonzero(np.diff(code[order], prepend=-1))
        with_one = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
        out[code[order][heads]] = np.add.reduceat(with_one[order], heads, axis=0)
    return out


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    """A list column whose rows all have ``width`` values."""
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), width)


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(1024 * x) of all vectors, filled up with zeros to ``dims``."""
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    scaled = np.floor(np.asarray(column.flatten(), dtype=np.float64) * SCALE)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = np.clip(scaled, -LIMIT, LIMIT)
    return out


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel(), kind))


def _state_schema(label: str) -> str:
    return f"key long, label {label}, v array<int>, near array<int>, low array<float>, upper array<float>, slots array<int>, values array<long>"


def _first_pass(books, dims: int, kept: int):
    """Vectors to their first state."""

    def work(batch: pa.RecordBatch):
        x = _integers(batch.column(2), dims)
        parts = np.split(x, books.value.entry.shape[0], axis=1)
        return x, parts, [measure(books.value, k, p, kept) for k, p in enumerate(parts)], None

    return work


def _next_pass(books, dims: int):
    """A state to the next one."""

    def work(batch: pa.RecordBatch):
        n_parts = books.value.entry.shape[0]
        x = _matrix(batch.column(2), dims, np.int64)
        near, low, upper = (np.asarray(batch.column(k).flatten()).reshape(len(x), n_parts, -1) for k in (3, 4, 5))
        parts = np.split(x, n_parts, axis=1)
        before = [Bounds(near[:, k].astype(np.int64), low[:, k], upper[:, k, 0].astype(np.float64)) for k in range(n_parts)]
        return x, parts, [follow(books.value, k, p, b) for k, (p, b) in enumerate(zip(parts, before, strict=True))], before

    return work


def _pass(work, books, keep: int):
    """One pass: new states, then a row with what changed in the sums (slots from 0) and how often z bounds gave way (slot -1 - z)."""

    def scan(batches: Iterator[pa.RecordBatch]):
        entry = books.value.entry
        n_parts, entries, width = entry.shape
        sums = np.zeros((n_parts, entries, width + 1), np.int64)
        gave_way = np.zeros(MOST_KEPT + 1, np.int64)
        schema, rows = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, parts, after, before = work(batch)
            rows += len(x)
            for k, part in enumerate(parts):
                code = after[k].near[:, 0]
                moved = np.arange(len(x)) if before is None else np.flatnonzero(code != before[k].near[:, 0])
                sums[k] += _sum_by(code[moved], part[moved], entries)
                if before is not None:
                    sums[k] -= _sum_by(before[k].near[moved, 0], part[moved], entries)
                    gave_way += np.bincount(after[k].needed, minlength=MOST_KEPT + 1)
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), _lists(x, pa.int32()),
                    _lists(np.concatenate([a.near[:, :keep] for a in after], axis=1), pa.int32()),
                    _lists(np.concatenate([a.low[:, :keep] for a in after], axis=1), pa.float32()),
                    _lists(np.stack([a.upper for a in after], axis=1), pa.float32()),
                    pa.nulls(len(x), pa.list_(pa.int32())), pa.nulls(len(x), pa.list_(pa.int64())),
                ],
                names=["key", "label", "v", "near", "low", "upper", "slots", "values"],
            )
            schema = out.schema
            yield out
        if rows:
            flat = sums.ravel()
            some = np.flatnonzero(flat)
            slots = np.concatenate([some, -1 - np.flatnonzero(gave_way)])
            values = np.concatenate([flat[some], gave_way[gave_way > 0]])
            lists = [_lists(slots[None, :], pa.int32()), _lists(values[None, :], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in schema][:-2] + lists, schema=schema)

    return scan


def _last_pass(books, dims: int):
    work = _next_pass(books, dims)

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, parts, after, _ = work(batch)
            code = np.stack([a.near[:, 0] for a in after], axis=1)
            error = sum(books.value.some(k, p, code[:, k : k + 1])[:, 0] for k, p in enumerate(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(code, pa.int32()), pa.array(error, pa.int64())], names=["key", "label", "code", "error"])

    return scan


@dataclass(frozen=True)
class Quantised:
    """``rows``: key, label, code (entry per part), error; ``books``: ``parts x entries x width``."""

    rows: DataFrame
    books: np.ndarray


def quantise(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> Quantised:
    """Codebooks and codes of all usable vectors after ``rounds`` rounds."""
    spark = vectors.sparkSession
    given = F.col(label) if label else F.lit(None).cast("int")
    rows = vectors.select(F.col(key).cast("long").alias("key"), given.alias("label"), F.col(vector).cast("array<double>").alias("x"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.col("x").isNotNull() & F.forall("x", finite))
    kind = rows.schema["label"].dataType.simpleString()
    first = rows.orderBy(F.col("key").asc_nulls_last(), "x").select("x").limit(entries).collect()
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return Quantised(spark.createDataFrame([], f"key long, label {kind}, code array<int>, error long"), np.zeros((parts, 0, 0), np.int64))
    dims = max(parts, -(-longest // parts) * parts)
    start = _integers(pa.array([r.x for r in first], pa.list_(pa.float64())), dims)
    entry = np.stack(np.split(start, parts, axis=1))
    books = Books(entry, np.zeros(entry.shape[:2]))
    totals = np.zeros((parts, entry.shape[1], dims // parts + 1), np.int64)
    kept = min(MOST_KEPT, entry.shape[1])
    shared, path = spark.sparkContext.broadcast(books), None
    for k in range(rounds):
        before, path = path, scratch_path(spark, "codes")
        work = _next_pass(shared, dims) if k else _first_pass(shared, dims, kept)
        state = (rows if not k else state).mapInArrow(_pass(work, shared, kept), _state_schema(kind))
        state.write.parquet(path)
        if before:
            remove_path(spark, before)
        table = spark.read.schema(_state_schema(kind)).parquet(path)
        state = table.filter("slots IS NULL")
        changes = table.filter("slots IS NOT NULL").select(F.explode(F.arrays_zip("slots", "values")).alias("c"))
        gave_way = np.zeros(MOST_KEPT + 1, np.int64)
        for slot, value in changes.groupBy("c.slots").agg(F.sum("c.values")).collect():
            if slot >= 0:
                totals.ravel()[slot] += value
            else:
                gave_way[-1 - slot] += value
        if k:  # ranks beyond the next kept would have asked for all entries
            beyond = np.cumsum(gave_way[::-1])[::-1]
            enough = np.flatnonzero(beyond <= FULL_SHARE * gave_way.sum())
            kept = max(min(LEAST_KEPT, kept), min(kept, int(enough[0]) if len(enough) else kept))
        count = totals[:, :, -1:]
        after = np.where(count > 0, totals[:, :, :-1] // np.maximum(count, 1), books.entry)
        moved = np.nextafter(np.sqrt(((after - books.entry) ** 2).sum(2)), np.inf)
        shared.unpersist()
        books = Books(after, np.where((after == books.entry).all(2), 0.0, moved))
        shared = spark.sparkContext.broadcast(books)
    codes = cut_lineage(state.mapInArrow(_last_pass(shared, dims), f"key long, label {kind}, code array<int>, error long"))
    if path:
        remove_path(spark, path)
    return Quantised(codes, books.entry)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``label_error``: the error summed over all rows with the same label, nulls together.

    Sums are made on the map side first. A table of at most ``FEW_LABELS`` labels is broadcast; a larger one is joined by a
    shuffle in which every label is spread over ``SALTS`` keys, so that a hot label does not fill one task.
    """
    sums = cut_lineage(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "other"))
    same = F.col("label").eqNullSafe(F.col("other"))
    if sums.count() <= FEW_LABELS:
        return rows.join(F.broadcast(sums), same).drop("other")
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("from", F.pmod(F.xxhash64("key", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("from") == F.col("salt"))).drop("other", "salt", "from")
