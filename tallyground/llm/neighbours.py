"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

1. Rows of equal vectors are one entry with its ``k + 1`` smallest ids, which is all that any query can need of them.
2. Entries get one more component so that a larger inner product is a smaller distance. A bounded sample is halved again
   and again (two means, cut at the median), which gives balanced lists; a list's centroid is the mean of its sample.
3. Each entry goes to the list of its nearest centroid, and to further ones that are almost as near, unless a chosen
   centroid is nearer to that centroid than the entry is (boundary replication).
4. Centroids are found by best-first search in an in-memory neighbour graph, many vectors at a time.
5. A query visits the lists whose centroid distance is at most ``ratio`` times that of its nearest centroid. The ratio is
   set from ``TUNING`` queries compared with brute force over all entries, so that ``RECALL`` of their true neighbours lie
   in visited lists.
6. Lists are cut into parts and parts gathered into chunks of bounded size; a task scores one chunk against one block
   of queries and returns its best ``k + 1`` ids per query. Scores are inner products of the original vectors in
   double precision.

Centroids and graph are broadcast: at most ``MOST_LISTS`` of them. Beyond ``MOST_LISTS * LIST_ROWS`` entries lists grow
and are cut into more parts; every row is indexed at any size.

Cases: null, zero, or partly null or non-finite vectors take no part, nor do null ids, nor vectors that have not the
commonest length; of rows with equal id the smallest vector counts; ties go to the smaller id; fewer than ``k``
candidates give fewer rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyground.settings import cut_lineage

K = 20
LIST_ROWS = 256
MOST_LISTS = 16_384
SAMPLE = 32_768
TUNING = 96
RECALL = 0.97
REPLICAS = 4
CLOSE = 1.08
DEGREE = 16
PART_ROWS = 4_096
CHUNK_ROWS = 16_384
BLOCK_QUERIES = 8_192
SALTS = 32


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``id, v`` with one finite non-zero vector per id, as little-endian doubles, and the length of the vectors."""
    v = F.col("v")
    fine = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
        & F.exists(v, lambda x: x != 0)
    )
    common = fine.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common.dim if common else 0
    one = fine.filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), dtype="<f8").reshape(-1, dim) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], names=["id", "v"])

    return one.mapInArrow(pack, "id long, v binary"), dim


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """``v, ids``: each distinct vector with its ``keep`` smallest ids. Batches are reduced before the first shuffle."""

    def reduce(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found: dict[bytes, list] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(v, []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array([sorted(x)[:keep] for x in found.values()], pa.list_(pa.int64()))],
                names=["v", "ids"],
            )

    def merged(df, *keys):
        return df.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"))

    partial = rows.mapInArrow(reduce, "v binary, ids array<long>").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
    return merged(merged(partial, "v", "salt"), "v")


def halves(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Sample rows in groups of at most ``leaf``, each cut being one of two means moved to the median."""
    todo, out = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own)
            continue
        y = x[own]
        far = y[np.argmax(((y - y[0]) ** 2).sum(1))]
        a, b = far, y[np.argmax(((y - far) ** 2).sum(1))]
        for _ in range(6):
            side = (y @ (a - b)) >= (a @ a - b @ b) / 2
            if side.all() or not side.any():
                break
            a, b = y[side].mean(0), y[~side].mean(0)
        order = np.argsort(y @ (a - b), kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


class Index:
    """Centroids in the lengthened space and their neighbour graph."""

    def __init__(self, sample: np.ndarray, lists: int, largest: float):
        self.largest = largest
        x = self.lengthen(sample)
        groups = halves(x, max(1, math.ceil(len(x) / lists)))
        self.centroids = np.array([x[g].mean(0) for g in groups])
        self.square = (self.centroids**2).sum(1)
        n = len(self.centroids)
        distance = self.square[:, None] - 2 * self.centroids @ self.centroids.T + self.square[None]
        near = np.argsort(distance, axis=1, kind="stable")[:, 1 : DEGREE + 1]
        # A ring keeps the graph in one piece.
        self.edges = np.column_stack([near, (np.arange(n) + 1) % n, (np.arange(n) - 1) % n])

    def lengthen(self, v: np.ndarray) -> np.ndarray:
        """Scaled to at most unit length, with a last component that makes it unit length."""
        v = v / self.largest
        return np.column_stack([v, np.sqrt(np.maximum(0.0, 1 - (v**2).sum(1)))])

    @staticmethod
    def query(v: np.ndarray) -> np.ndarray:
        return np.column_stack([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros(len(v))])

    def search(self, x: np.ndarray, width: int, ratio: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids of each row with their distances, nearest first, -1 where there are none.

        A row's search ends when no open centroid is within ``ratio`` times its nearest distance.
        """
        n, rows = len(self.centroids), len(x)
        width = min(width, n)
        own = (x**2).sum(1)
        seen = np.zeros((rows, n), bool)
        spread = np.unique(np.linspace(0, n - 1, min(n, 24)).astype(int))
        ids = np.tile(spread, (rows, 1))
        seen[:, spread] = True
        dist = self._distance(x, own, ids)
        done = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = (np.take_along_axis(v, order, 1) for v in (ids, dist, done))
            open_ = np.where(done | (dist > ratio * dist[:, :1] + 1e-12) | (ids < 0), np.inf, dist)
            pick = np.argsort(open_, axis=1, kind="stable")[:, :8]
            fits = np.isfinite(np.take_along_axis(open_, pick, 1))
            live = fits.any(1)
            if not live.any():
                return np.where(ids >= 0, ids, -1), dist
            np.put_along_axis(done, pick, np.take_along_axis(done, pick, 1) | fits, 1)
            nodes = np.take_along_axis(ids, pick, 1)
            more = np.where(fits[:, :, None], self.edges[nodes], -1).reshape(rows, -1)
            # A neighbour counts once: not if it was seen, nor if another picked node names it too.
            more.sort(axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
            r = np.arange(rows)[:, None]
            more = np.where((more >= 0) & ~seen[r, more], more, -1)
            flat = np.nonzero(more >= 0)
            seen[flat[0], more[flat]] = True
            new = np.full(more.shape, np.inf)
            c = more[flat]
            new[flat] = np.sqrt(np.maximum(0.0, own[flat[0]] + self.square[c] - 2 * np.einsum("ij,ij->i", x[flat[0]], self.centroids[c])))
            ids, dist = np.column_stack([ids, more]), np.column_stack([dist, new])
            done = np.column_stack([done, more < 0])

    def _distance(self, x, own, ids):
        c = self.centroids[ids]
        return np.sqrt(np.maximum(0.0, own[:, None] + self.square[ids] - 2 * np.einsum("ij,ikj->ik", x, c)))

    def lists(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``entry, list`` pairs of the posting lists, boundary entries in several."""
        x = self.lengthen(v)
        ids, dist = self.search(x, 2 * REPLICAS, CLOSE)
        keep = np.zeros(ids.shape, bool)
        keep[:, 0] = True
        for j in range(1, ids.shape[1]):
            close = (ids[:, j] >= 0) & (dist[:, j] <= CLOSE * dist[:, 0]) & (keep.sum(1) < REPLICAS)
            for i in range(j):
                gap = np.linalg.norm(self.centroids[ids[:, i]] - self.centroids[ids[:, j]], axis=1)
                close &= ~(keep[:, i] & (gap < dist[:, j]))
            keep[:, j] = close
        row, col = np.nonzero(keep)
        return row, ids[row, col]


def _best(scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:keep]


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed in the same order wherever a row stands."""
    return (v * q).sum(axis=1)


def tune(index: Index, stored: DataFrame, queries: np.ndarray, dim: int, k: int) -> float:
    """The distance ratio by which ``RECALL`` of the sample queries' true neighbours are found."""
    if not len(queries):
        return 1.0

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = matrix(batch.column(0), dim)
            scores = queries @ x.T
            top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
            which = np.repeat(np.arange(len(queries)), top.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(which), pa.array(np.take_along_axis(scores, top, 1).ravel()), batch.column(0).take(pa.array(top.ravel()))],
                names=["q", "s", "v"],
            )

    found = stored.select("v").mapInArrow(scan, "q long, s double, v binary")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "v"))
    true = found.withColumn("place", place).filter(F.col("place") <= k + 1).collect()
    q = np.array([r.q for r in true])
    v = np.frombuffer(b"".join(r.v for r in true), dtype="<f8").reshape(-1, dim)
    x = index.query(queries)
    nearest = index.search(x, 1)[1][:, 0]
    entry, own = index.lists(v)
    ratio = np.linalg.norm(x[q[entry]] - index.centroids[own], axis=1) / np.maximum(nearest[q[entry]], 1e-12)
    needed = np.full(len(true), np.inf)
    np.minimum.at(needed, entry, ratio)
    return max(1.0, float(np.quantile(needed, RECALL)) * (1 + 1e-9))


def nearest(
    rows: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = K, list_rows: int = LIST_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id satisfies ``is_query`` (a function of the id column)."""
    spark = rows.sparkSession
    one, dim = usable(rows, key, vector)
    one = cut_lineage(one)
    stored = cut_lineage(entries(one, k + 1))
    asked = one.filter(is_query(F.col("id")))
    n = stored.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    share = min(1.0, 2 * SAMPLE / n)
    picked = stored.select("v").filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64("v")).limit(SAMPLE)
    sample = np.frombuffer(b"".join(r.v for r in picked.collect()), dtype="<f8").reshape(-1, dim)

    def norms(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.linalg.norm(matrix(batch.column(0), dim), axis=1).max())])], names=["n"])

    largest = stored.select("v").mapInArrow(norms, "n double").agg(F.max("n")).first()[0]
    index = Index(sample, max(1, min(MOST_LISTS, math.ceil(n / list_rows))), largest)
    questions = asked.select("v").distinct()
    trial = questions.orderBy(F.xxhash64("v")).limit(TUNING).collect()
    trial = np.frombuffer(b"".join(r.v for r in trial), dtype="<f8").reshape(-1, dim)
    ratio = tune(index, stored, trial, dim, k)
    sent = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                entry, own = sent.value.lists(matrix(part.column(0), dim))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(c.take(pa.array(entry)) for c in part.columns)], names=["list", "v", "ids"])

    postings = cut_lineage(stored.mapInArrow(assign, "list int, v binary, ids array<long>"))
    # One count per list, of which there are at most MOST_LISTS; parts of lists fill chunks one after another.
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}
    parts = np.array([max(1, math.ceil(sizes.get(c, 0) / PART_ROWS)) for c in range(len(index.centroids))])
    filled, chunk, chunks = 0, 0, []
    for c, cut in enumerate(parts.tolist()):
        for _ in range(cut):
            filled += sizes.get(c, 0) // cut
            if filled > CHUNK_ROWS:
                chunk, filled = chunk + 1, sizes.get(c, 0) // cut
            chunks.append(chunk)
    first = np.concatenate([[0], np.cumsum(parts)])
    places = spark.sparkContext.broadcast((first, np.array(chunks)))
    blocks = max(1, math.ceil(questions.count() / BLOCK_QUERIES))

    def placed(batches: Iterator[pa.RecordBatch]):
        begin, of = places.value
        for batch in batches:
            own = np.asarray(batch.column(0))
            salt = np.array([i[0] for i in batch.column(2).to_pylist()])
            part = begin[own] + np.abs(salt) % (begin[own + 1] - begin[own])
            for b in range(blocks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[part].astype(np.int32)), pa.array(np.full(len(own), b, np.int32)), *batch.columns], names=["chunk", "block", "list", "v", "ids"]
                )

    def visit(batches: Iterator[pa.RecordBatch]):
        begin, of = places.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors = part.column(0).to_pylist()
                ids, dist = sent.value.search(sent.value.query(matrix(part.column(0), dim)), len(sent.value.centroids), ratio)
                out: list[tuple] = []
                for row, v in enumerate(vectors):
                    own = ids[row][(ids[row] >= 0) & (dist[row] <= ratio * dist[row, 0] + 1e-12)]
                    by_chunk: dict[int, list] = {}
                    for c in own.tolist():
                        for p in set(of[begin[c] : begin[c + 1]].tolist()):
                            by_chunk.setdefault(p, []).append(c)
                    block = zlib.crc32(v) % blocks
                    out += [(p, block, v, cs) for p, cs in by_chunk.items()]
                columns = list(zip(*out, strict=True))
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["chunk", "block", "q", "lists"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [("q", pa.binary()), ("best", pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())])))]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], kind) for c, kind in kinds})
        x, ids, own = matrix(left.column("v"), dim), left.column("ids").to_pylist(), left.column("list").to_numpy()
        q, visits = matrix(right.column("q"), dim), right.column("lists").to_pylist()
        wanted: dict[int, list] = {}
        for row, cs in enumerate(visits):
            for c in cs:
                wanted.setdefault(c, []).append(row)
        order = np.argsort(own, kind="stable")
        found: list[list] = [[] for _ in visits]
        for c, asking in wanted.items():
            there = order[np.searchsorted(own[order], c) : np.searchsorted(own[order], c, "right")]
            if not len(there):
                continue
            keep = min(len(there), k + 12)  # a margin for the rounding of the matrix product
            scores = q[asking] @ x[there].T
            top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            for row, t in zip(asking, top, strict=True):
                found[row].append(there[t])
        best = []
        for row, places_ in enumerate(found):
            rows_ = np.concatenate(places_) if places_ else np.zeros(0, np.int64)
            score = exact(x[rows_], q[row]) if len(rows_) else np.zeros(0)
            pairs = {i: s for r, s in zip(rows_.tolist(), score.tolist(), strict=True) for i in ids[r]}
            best.append([{"s": s, "id": i} for i, s in sorted(pairs.items(), key=lambda p: (-p[1], p[0]))[: k + 1]])
        return pa.table({"q": right.column("q"), "best": pa.array(best, kinds[1][1])})

    left = postings.mapInArrow(placed, "chunk int, block int, list int, v binary, ids array<long>").groupBy("chunk", "block")
    right = questions.mapInArrow(visit, "chunk int, block int, q binary, lists array<int>").groupBy("chunk", "block")
    answers = left.cogroup(right).applyInArrow(answer, "q binary, best array<struct<s:double,id:long>>")
    worst_last = F.array_sort(
        F.array_distinct(F.flatten(F.collect_list("best"))),
        lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0),
    )
    merged = answers.groupBy("q").agg(F.slice(worst_last, 1, k + 1).alias("best"))
    mine = asked.join(merged, F.col("v") == F.col("q"))
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)
    out = mine.select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.s").alias("score"))
