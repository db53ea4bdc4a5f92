"""Periodic runs of words, found on a run-length grammar made by recompression.

The words of a slice of documents become numbers. Rounds of block compression (a stretch of one symbol turns into one
symbol with its count) and pair compression (a coin per symbol, hashed anew each round, says which may stand left and
which right) shorten the sequence until every document is a few symbols. Equal stretches get equal symbols up to their
ends, so the grammar answers how far two places agree, to the right and to the left, in steps that rise and then fall
through its levels; a step passes a whole block. No suffix is sorted.

A run of period p and at least 3p words covers two neighbouring points of every grid of step p together with the words
p behind them. So only such points are candidates (their number is harmonic: n + n/2 + n/3 ...), and each is extended
exactly in both directions. A stretch found with several periods keeps the smallest, which divides the others.

Everything happens inside a task on slices of about ``SLICE_BYTES`` bytes; a longer text is a slice of its own, and
candidates are extended ``AT_ONCE`` at a time. Nothing is shuffled.

Cases: a null or blank text has no words, no runs and an empty collapsed text; repeated rows and null ids each give their
own row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.llm.textkit import expand, mix, slices

# A run has at least so many words and so many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
# A document is left alone once it is so few symbols long.
FEW = 4
AT_ONCE = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _dense(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers from 0, through a hash table."""
    return np.asarray(pa.array(keys).dictionary_encode().indices).astype(np.int64)


class Grammar:
    """The levels of a recompressed sequence, one after another in flat arrays.

    ``symbols`` is the lowest level: numbers from 0, and between documents and at both ends a negative number that occurs
    once. ``size`` is a symbol's length in words, ``ahead`` and ``behind`` count equal symbols from a place to the end and
    to the start of its block. ``first_up`` is the symbol of the next level that starts where this one does, or -1;
    ``last_up`` the one that ends there; ``first_down`` and ``last_down`` lead back.
    """

    def __init__(self, symbols: np.ndarray):
        names = ("symbol", "size", "ahead", "behind", "first_up", "last_up", "first_down", "last_down")
        levels: dict[str, list[np.ndarray]] = {name: [] for name in names}
        symbol, size = symbols, np.ones(len(symbols), np.int64)
        first_down = last_down = np.full(len(symbols), -1)
        at, level = 0, 0
        while True:
            n = len(symbol)
            head = np.ones(n, bool)
            head[1:] = symbol[1:] != symbol[:-1]
            heads = np.flatnonzero(head)
            count = np.diff(heads, append=n)
            block = np.cumsum(head) - 1
            place = np.arange(n) - heads[block]
            levels["symbol"].append(symbol)
            levels["size"].append(size)
            levels["ahead"].append(count[block] - place)
            levels["behind"].append(place + 1)
            levels["first_down"].append(first_down)
            levels["last_down"].append(last_down)
            wall = np.flatnonzero(symbol < 0)
            if np.diff(wall).max(initial=0) <= FEW + 1:
                levels["first_up"].append(np.full(n, -1))
                levels["last_up"].append(np.full(n, -1))
                break
            blocks, sizes = symbol[heads], size[heads] * count
            inner = blocks >= 0
            if count.max() > 1:
                blocks = np.where(inner, _dense(np.where(inner, blocks * (int(count.max()) + 1) + count, -1)), blocks)
            second = self._pairs(blocks, inner, level)
            opens = np.flatnonzero(~second)
            follows = np.zeros(len(opens), bool)
            follows[:-1] = second[opens[:-1] + 1]
            follows[-1:] = False
            partner = np.where(follows, np.append(blocks, 0)[opens + 1] + 1, 0)
            left = blocks[opens]
            key = left * (int(blocks.max(initial=0)) + 2) + partner
            merged = np.where(left >= 0, _dense(np.where(left >= 0, key, -1)), left)
            sizes = sizes[opens] + np.where(follows, np.append(sizes, 0)[opens + 1], 0)
            # Where a symbol's parts lie on this level.
            ends = np.append(heads, n)
            first, last = heads[opens], ends[opens + 1 + follows] - 1
            up = np.full(n, -1)
            up[first] = np.arange(len(opens)) + at + n
            levels["first_up"].append(up)
            up = np.full(n, -1)
            up[last] = np.arange(len(opens)) + at + n
            levels["last_up"].append(up)
            symbol, size, first_down, last_down = merged, sizes, first + at, last + at
            at, level = at + n, level + 1
        for name, parts in levels.items():
            setattr(self, name, np.concatenate(parts))
        self.n = len(symbols)

    @staticmethod
    def _pairs(blocks: np.ndarray, inner: np.ndarray, level: int) -> np.ndarray:
        """Which blocks are the second of a pair; of both orientations of the coin the one with more pairs."""
        with np.errstate(over="ignore"):
            coin = (mix(blocks.astype(np.uint64) + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(1)).astype(bool)
        both = inner[:-1] & inner[1:]
        rising, falling = both & ~coin[:-1] & coin[1:], both & coin[:-1] & ~coin[1:]
        chosen = rising if rising.sum() >= falling.sum() else falling
        return np.concatenate([[False], chosen])

    def agree(self, i: np.ndarray, j: np.ndarray, ahead: bool = True) -> np.ndarray:
        """How many words from the places ``i`` and ``j`` on are equal one by one, to the right or to the left."""
        up, down, run = (self.first_up, self.first_down, self.ahead) if ahead else (self.last_up, self.last_down, self.behind)
        sign = 1 if ahead else -1
        total, live = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(live):
            above_i, above_j = up[i], up[j]
            rise = (above_i >= 0) & (above_j >= 0) & (self.symbol[above_i] == self.symbol[above_j])
            same = self.symbol[i] == self.symbol[j]
            step = np.where(same & ~rise, np.minimum(run[i], run[j]), 0)
            total[live] += step * self.size[i]
            fall = ~same & ~rise
            on = np.flatnonzero(~fall | (i >= self.n))
            i, j = (np.where(rise, above, np.where(fall, down[k], k + sign * step))[on] for k, above in ((i, above_i), (j, above_j)))
            live = live[on]
        return total


def find_runs(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of all runs between the walls of ``symbols``, by start, then period."""
    grammar = None
    found: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, int]] = []

    def settle() -> None:
        nonlocal grammar
        if not waiting:
            return
        grammar = grammar or Grammar(symbols)
        i = np.concatenate([x for x, _ in waiting])
        p = np.repeat([p for _, p in waiting], [len(x) for x, _ in waiting])
        waiting.clear()
        start = i - grammar.agree(i - 1, i + p - 1, ahead=False)
        end = i + p + grammar.agree(i, i + p)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        found.append(np.unique(np.stack([start, end, p])[:, long], axis=1))

    held = 0
    for p in range(1, longest // LEAST_PERIODS + 1):
        grid = symbols[::p]
        equal = grid[1:] == grid[:-1]
        i = np.flatnonzero(equal[1:] & equal[:-1]) * p
        if len(i):
            # The words between the two points repeat as well; one of them settles most chance hits.
            i = i[symbols[i + p // 2] == symbols[i + p // 2 + p]]
        for k in range(0, len(i), AT_ONCE):
            waiting.append((i[k : k + AT_ONCE], p))
            held += len(waiting[-1][0])
            if held >= AT_ONCE:
                settle()
                held = 0
    settle()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[new], end[new], p[new]
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end`` of every word in bytes, and per document the number of words before it."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _collapse(data: np.ndarray, starts, ends, bounds, keep) -> pa.Array:
    """The kept words of every document, joined by one space."""
    kept = np.flatnonzero(keep)
    per_doc = np.searchsorted(kept, bounds)
    joined = np.ones(len(kept), np.int64)
    joined[per_doc[1:][per_doc[1:] > per_doc[:-1]] - 1] = 0  # no space behind a document's last word
    lengths = ends[kept] - starts[kept] + joined
    # A word that is not its document's last is followed by a space of some kind in the text.
    out = data[expand(starts[kept], lengths)]
    out[SPACE[out]] = 0x20
    places = np.concatenate([[0], np.cumsum(lengths)])[per_doc].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(places), pa.py_buffer(out)).cast(pa.string())


def _scan(batches: Iterator[pa.RecordBatch]):
    for batch, data, offsets in slices(batches, "t"):
        starts, ends, bounds = split_words(data, offsets)
        lengths = np.diff(bounds)
        # Words as exact numbers: their bytes without the spaces, looked up in Arrow's hash table.
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        names = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[~SPACE[data]])])
        number = np.asarray(names.dictionary_encode().indices).astype(np.int64)
        docs = len(lengths)
        symbols = np.empty(len(number) + docs + 1, np.int64)
        doc = np.repeat(np.arange(docs), lengths)
        symbols[np.arange(len(number)) + doc + 1] = number
        symbols[np.append(bounds[:-1] + np.arange(docs), len(symbols) - 1)] = -1 - np.arange(docs + 1)
        start, end, period = find_runs(symbols, int(lengths.max(initial=0)))
        own = np.searchsorted(bounds[:-1] + np.arange(docs), start, "right") - 1
        first = start - own - 1  # the word's number in the slice
        drop = np.zeros(len(number) + 1, np.int64)
        np.add.at(drop, first + period, 1)
        np.add.at(drop, first + end - start, -1)
        collapsed = _collapse(data, starts, ends, bounds, np.cumsum(drop[:-1]) == 0)
        runs = pa.StructArray.from_arrays([pa.array(first - bounds[own]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
        per_doc = np.searchsorted(own, np.arange(docs + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(pa.array(per_doc), runs), collapsed],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def collapse_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its words, its periodic runs by start and period, and the text with one period of each run left."""
    return docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(_scan, RESULT)
