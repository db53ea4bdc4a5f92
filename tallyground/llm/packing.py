"""Best-fit packing of documents into sequences by patterns of lengths.

The histogram of piece lengths (at most one row per length) is covered by patterns of one to ``DEPTH`` lengths that
fill a sequence exactly; the repeat counts come from non-negative least squares. They are rounded down to what the
histogram holds, and what is left is packed best fit in order of falling length, a whole count of equal lengths at a
time. The plan is bounded by the sequence length, not by the documents. Each piece then finds its place from its rank
among the pieces of its length: the rank within its task plus the counts of the tasks before.

Tokens: ids of the vocabulary, then ``END`` for each document. Only documents of more than ``capacity`` ids are cut, into
pieces of ``capacity``; their first piece holds the rest.

Cases: a null or empty text is a document of one id; a null document id is carried along; repeated rows are packed
each by itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyground.llm import textkit as tk
from tallyground.llm import tokens
from tallyground.settings import cut_lineage

CAPACITY = 1024
END = 2
DEPTH = 3
ROUNDS = 400

PIECES = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, part int, nth long"


def cut(docs: DataFrame, vocabulary: str, doc: str, text: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The pieces, with their ids if these are wanted. ``part`` and ``nth`` number the pieces of each length within a task; they hold once
    the rows are written."""

    def scan(batches: Iterator[pa.RecordBatch]):
        encoder = tokens.load(vocabulary)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch, data, offsets in tk.slices(batches, "t"):
            ids, n = encoder.encode(data, offsets)
            # One END after each document.
            n_ids = n + 1
            ends = np.cumsum(n_ids)
            flat = np.full(int(ends[-1]), END, dtype=np.int32)
            flat[tk.expand(ends - n_ids, n)] = ids
            n_pieces = -(-n_ids // capacity)
            owner = np.repeat(np.arange(len(n_ids)), n_pieces)
            piece = tk.expand(np.zeros(len(n_ids), np.int64), n_pieces)
            head = (n_ids - (n_pieces - 1) * capacity)[owner]
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            length = np.where(piece == 0, head, capacity)
            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(length), np.int64)
            nth[order] = tk.expand(seen[counts > 0], counts[counts > 0])
            seen += counts
            bounds = np.concatenate([[0], np.cumsum(length)])
            raw = memoryview(flat.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)) if with_ids else pa.nulls(len(piece), pa.list_(pa.int32())),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(piece), part), pa.int32()), pa.array(nth),
                ],
                names=[x.split()[0] for x in PIECES.split(", ")],
            )

    return docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(scan, PIECES)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of at most ``DEPTH`` of ``lengths`` that sum to ``capacity``, longest first, padded with 0."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    out = [(capacity, 0, 0)] if there[capacity] else []
    for a in lengths[lengths < capacity][::-1].tolist():
        b = capacity - a
        if b <= a and there[b]:
            out.append((a, b, 0))
        second = lengths[(lengths <= a) & (lengths < b) & (lengths >= b - lengths)]
        third = b - second
        fits = there[third] & (third <= second)
        out += [(a, s, t) for s, t in zip(second[fits].tolist(), third[fits].tolist(), strict=True)]
    return np.array(out, dtype=np.int64).reshape(-1, DEPTH)


def repeats(histogram: np.ndarray, columns: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: how often to use each pattern so that the lengths add up to the histogram.

    Accelerated projected gradient on scaled columns; a product with the matrix is a lookup or a bincount.
    """
    size = len(histogram)
    target = histogram.astype(float)
    target[0] = 0.0
    scale = max(target.max(), 1.0)
    target = target / scale
    used = np.bincount(columns.ravel(), minlength=size)
    step = 1.0 / (DEPTH * max(1, used[1:].max()))
    x = np.zeros(len(columns))
    y, t = x, 1.0
    for _ in range(rounds):
        made = np.bincount(columns.ravel(), np.repeat(y, DEPTH), minlength=size)
        rest = made - target
        rest[0] = 0.0
        new = np.maximum(0.0, y - step * rest[columns].sum(1))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x * scale


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by falling length, for whole counts of equal lengths: ``(pattern, repeats)``."""
    bins: dict[int, list] = defaultdict(list)  # room left -> [(pattern, repeats)]
    for length in sorted(left, reverse=True):
        n = left[length]
        for room in sorted(r for r in bins if r >= length):
            fits = room // length
            groups, bins[room] = bins[room], []
            for pattern, k in groups:
                # Best fit fills a bin before it takes a roomier one.
                full = min(k, n // fits)
                rest = min(fits - 1, n - full * fits) if full < k else 0
                for put, times in ((fits, full), (rest, 1 if rest else 0)):
                    if times:
                        bins[room - put * length].append((pattern + (length,) * put, times))
                n -= full * fits + rest
                if k - full - (rest > 0):
                    bins[room].append((pattern, k - full - (rest > 0)))
        fits = capacity // length
        for put, times in ((fits, n // fits), (n % fits, 1)):
            if put and times:
                bins[capacity - put * length].append(((length,) * put, times))
    return [group for groups in bins.values() for group in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(pattern, repeats)`` that hold every piece of the histogram exactly once."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    columns = patterns(np.flatnonzero(counts), capacity)
    out, left = [], counts.copy()
    if len(columns):
        wanted = np.floor(repeats(counts, columns) + 0.5).astype(np.int64)
        for k in np.argsort(-wanted, kind="stable").tolist():
            if not wanted[k]:
                break
            pattern = tuple(c for c in columns[k].tolist() if c)
            need = {c: pattern.count(c) for c in pattern}
            n = min(int(wanted[k]), *(int(left[c]) // m for c, m in need.items()))
            if n:
                out.append((pattern, n))
                for c, m in need.items():
                    left[c] -= n * m
    return out + best_fit({int(c): int(left[c]) for c in np.flatnonzero(left)}, capacity)


class Places:
    """The plan as a lookup from length and rank to sequence and offset."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]]):
        rows, taken, base = [], defaultdict(int), 0
        for pattern, n in made:
            offset = 0
            for length in pattern:
                rows.append((length, taken[length], base, offset))
                taken[length] += n
                offset += length
            base += n
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        self.lengths, self.ranks, self.base, self.offset = table.T.copy()
        self.first = np.searchsorted(self.lengths, np.arange(self.lengths.max(initial=0) + 2))
        self.sequences = base

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Rows are in order of length, then rank; ranks below 2^52 keep both in one number.
        row = np.searchsorted(self.lengths * (1 << 52) + self.ranks, length * (1 << 52) + rank, "right") - 1
        return self.base[row] + rank - self.ranks[row], self.offset[row]


def pack(
    docs: DataFrame, vocabulary: str, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = True
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``."""
    pieces = cut_lineage(cut(docs, vocabulary, doc, text, capacity, with_ids))
    # One row per task and length; their running sums give each task its first rank.
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    counts = cut_lineage(counts.select("length", "part", "n", before.alias("before")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(histogram, capacity)))
    own = ["doc_id", "piece", "start", "length", *(["ids"] if with_ids else []), "ids_crc32"]
    ranked = pieces.join(counts.drop("n"), ["length", "part"]).select(*own, (F.col("before") + F.col("nth")).alias("rank"))
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in own) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sequence, offset = places.value(tk.long_column(batch, "length"), tk.long_column(batch, "rank"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*own, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, schema)
