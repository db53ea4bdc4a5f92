"""Benchmark decontamination with suffix arrays over the training words.

Every slice of the documents is a shard. Its words that the benchmark knows form a suffix array; the suffixes of the test
set at the first place of each distinct window are looked up in it by one vectorised binary search, which gives every location
of a window and, from that place, the longest verbatim match (which another place of the same window may exceed).
The documents are scanned once and nothing is shuffled. The benchmark goes to the tasks in blocks of bounded size;
a larger one takes more blocks within the same scan.

Words: A-Z lower-cased, runs of digits, letters and characters outside ASCII. A window is ``window`` consecutive
words of an item; an item of fewer words, but not none, is one window. A document word inside any occurrence of a
window is hit.

Cases: a null text has no words; an item without words has no window; a null item id counts as an item whose id is
the empty text; repeated items count by distinct id; repeated documents each get their own row; an empty benchmark
hits nothing; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.llm import textkit as tk

WINDOW = 10
# Bytes of benchmark text that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20

REPORT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, longest long, longest_at long"
)


class TestSet:
    """One block of the benchmark: its word sequence, its suffixes and its distinct windows."""

    __test__ = False

    def __init__(self, items: list[tuple], window: int):
        data, offsets = tk.text_bytes(pa.array([text for _, text in items], pa.large_string()))
        starts, ends, owner = tk.words(data, offsets)
        self.vocabulary, ids = np.unique(tk.word_hashes(data, starts, ends), return_inverse=True)
        sequence, at = [0], []
        windows: dict[tuple, set] = {}
        # A zero closes every item, so that no match runs across two of them.
        for k, (item, _) in enumerate(items):
            own = (ids[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")] + 1).tolist()
            length = min(window, len(own))
            for i in range(len(own) - length + 1 if own else 0):
                key = tuple(own[i : i + length])
                if key not in windows:
                    windows[key] = set()
                    at.append((len(sequence) + i, length))
                windows[key].add("" if item is None else str(item))
            sequence += [*own, 0]
        self.sequence = np.array(sequence, dtype=np.int64)
        self.at = np.array([a for a, _ in at], dtype=np.int64)
        self.length = np.array([n for _, n in at], dtype=np.int64)
        self.items = list(windows.values())
        self.shortest = int(self.length.min()) if len(self.length) else 0

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """1 + place in the vocabulary, 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == hashes, place + 1, 0)


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Places of all non-zero words, ordered by the words from there on to at least ``depth`` (prefix doubling)."""
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] if step < len(rank) else 0
        key = np.where(sequence > 0, rank * (int(rank.max()) + 2) + after + 1, 0)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.argsort(rank, kind="stable")
    return order[sequence[order] > 0]


def common_words(tests: np.ndarray, p: np.ndarray, train: np.ndarray, q: np.ndarray, limit=None) -> np.ndarray:
    """Length of the common prefix of test suffix ``p`` and training suffix ``q``, pair by pair."""
    length = np.zeros(len(p), np.int64)
    active = np.arange(len(p))
    while len(active):
        i, j = p[active] + length[active], q[active] + length[active]
        same = (tests[i] == train[j]) & (tests[i] > 0)
        if limit is not None:
            same &= length[active] < limit[active]
        active = active[same]
        length[active] += 1
    return length


def find(tests: np.ndarray, p: np.ndarray, train: np.ndarray, order: np.ndarray, limit=None, beyond=False) -> np.ndarray:
    """First place in ``order`` whose suffix is not below test suffix ``p``; with ``beyond``, not among those that
    begin with its first ``limit`` words either."""
    low, high = np.zeros(len(p), np.int64), np.full(len(p), len(order))
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        q = order[middle]
        bound = None if limit is None else limit[open_]
        length = common_words(tests, p[open_], train, q, bound)
        below = train[q + length] < tests[p[open_] + length]
        if bound is not None:
            below = np.where(length >= bound, beyond, below)
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
    return low


class Shard:
    """The words of one slice of documents and what one test set finds in them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, self.doc = tk.words(data, offsets)
        self.hashes = tk.word_hashes(data, starts, ends)
        self.docs = len(offsets) - 1
        self.n_words = np.bincount(self.doc, minlength=self.docs)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])[:-1]
        self.hit = np.zeros(len(self.doc) + 1, np.int64)
        self.items: dict[int, set] = {}
        self.longest = np.zeros(self.docs, np.int64)
        self.longest_at = np.full(self.docs, -1, np.int64)

    def search(self, tests: TestSet) -> None:
        if not len(tests.at) or not len(self.doc):
            return
        ids = tests.word_ids(self.hashes)
        # Runs of known words within a document; a run shorter than the shortest window holds no match.
        known = ids > 0
        opens = known.copy()
        opens[1:] &= ~known[:-1] | (self.doc[1:] != self.doc[:-1])
        run = np.cumsum(opens)[known] - 1
        sizes = np.bincount(run) if len(run) else np.zeros(0, np.int64)
        keep = sizes >= max(tests.shortest, 1)
        if not keep.any():
            return
        begin = np.flatnonzero(opens)[keep]
        sizes = sizes[keep]
        places = tk.expand(begin, sizes)
        target = tk.expand(np.cumsum(sizes + 1) - (sizes + 1), sizes)
        train = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
        origin = np.zeros(len(train), np.int64)
        train[target], origin[target] = ids[places], places
        order = suffix_array(train, int(min(sizes.max(), len(tests.sequence))) + 1)
        low = find(tests.sequence, tests.at, train, order, tests.length)
        fits = np.flatnonzero(low < len(order))
        fits = fits[
            common_words(tests.sequence, tests.at[fits], train, order[low[fits]], tests.length[fits]) >= tests.length[fits]
        ]
        if not len(fits):
            return
        at, length, low = tests.at[fits], tests.length[fits], low[fits]
        counts = find(tests.sequence, at, train, order, length, beyond=True) - low
        found = order[tk.expand(low, counts)]
        which = np.repeat(np.arange(len(fits)), counts)
        where = origin[found]
        np.add.at(self.hit, where, 1)
        np.add.at(self.hit, where + length[which], -1)
        reach = common_words(tests.sequence, at[which], train, found)
        doc = self.doc[where]
        for k in np.lexsort((-where, reach)):
            if reach[k] >= self.longest[doc[k]]:
                self.longest[doc[k]], self.longest_at[doc[k]] = reach[k], where[k] - self.first[doc[k]]
        for pair in np.unique(doc * len(fits) + which).tolist():
            self.items.setdefault(pair // len(fits), set()).update(tests.items[fits[pair % len(fits)]])

    def hits(self) -> np.ndarray:
        covered = np.cumsum(self.hit[:-1]) > 0
        return np.bincount(self.doc[covered], minlength=self.docs)


def test_sets(benchmark: DataFrame, item: str, text: str, window: int) -> list:
    """The benchmark as broadcast blocks. Its size is measured first; each block holds about ``BLOCK_BYTES``."""
    size = benchmark.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    items = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t"))
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    context = benchmark.sparkSession.sparkContext
    return [
        context.broadcast(TestSet([(r.i, r.t) for r in items.filter(F.col("b") == b).orderBy("i", "t").collect()], window))
        for b in range(blocks)
    ]


def _searched(batches: Iterator[pa.RecordBatch], column: str, sets: list):
    for batch, data, offsets in tk.slices(batches, column, SHARD_BYTES):
        shard = Shard(data, offsets)
        for tests in sets:
            shard.search(tests.value)
        yield batch, shard


def report(
    docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per document: words, hit words, items found, and the longest verbatim match with its first word."""
    sets = test_sets(benchmark, item, item_text, window)

    def scan(batches):
        for batch, shard in _searched(batches, "t", sets):
            items = [sorted(shard.items.get(k, ())) for k in range(shard.docs)]
            hits = shard.hits()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(shard.n_words), pa.array(hits), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    pa.array(hits > 0), pa.array(items, pa.list_(pa.string())), pa.array(shard.longest),
                    pa.array(shard.longest_at, mask=shard.longest_at < 0),
                ],
                names=[x.split()[0] for x in REPORT.split(", ")],
            )

    return docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(scan, REPORT)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The documents that hold no window of any item, with all their columns."""
    sets = test_sets(benchmark, item, item_text, window)

    def scan(batches):
        for batch, shard in _searched(batches, text, sets):
            yield batch.filter(pa.array(shard.hits() == 0))

    return docs.mapInArrow(scan, docs.schema)
