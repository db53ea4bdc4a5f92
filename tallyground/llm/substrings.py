"""Substring dedup by hashing units of text: lines, paragraphs, the sentences of lines, or those and their clauses.

Each unit is normalised to its words (A-Z lower-cased, punctuation and white space dropped) and hashed to 128 bits, of which
96 are kept. Units of equal digests are the same; the one of the smallest rank (document id, then place in the text) stays and
the rest is removed. A unit is named by its document and its number in it. Every task gathers up to ``GATHERED`` units, keeps
the first of each digest, and sends these by ranges of digests, one packed row per range; so a unit in a third of all documents
costs one entry per task, and a range grows with ``RANGE_BYTES`` of text. Units that an earlier one in their task repeats are
lost whatever the other tasks hold, and are sent on as such. The numbers of the lost units go to the documents, whose texts are
cut into units again to get the spans.

Units of fewer than ``least_words`` words stay: they are common in ordinary prose. With ``unit="clause"`` a sentence that stays
loses its repeated clauses (up to a comma, semicolon or colon before a blank), so that a passage inside other prose is found but for
the clauses at its ends; and a short clause goes where it follows or precedes, with nothing but short clauses between, the same
longer clause as in an earlier place, which that longer clause repeats.

Cases: a null text has no units; a null id ranks after all others; rows of equal id and equal text are one document and
get the same result; rows of equal id and different text rank by a hash of the text; an empty table gives an empty
result; further columns are carried along by ``remove_repeats`` and ignored by ``repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.llm import textkit as tk
from tallyground.llm.frames import size_of

LEAST_WORDS = 5
LAST = (1 << 63) - 1
KEY = ("id key", "text key")
# Text whose units make one range of digests, on average, and units that a task gathers before it sends them.
RANGE_BYTES = 32 << 20
GATHERED = 1 << 20
PACKED = ["d", "h", "doc", "nth", "x", "y"]
LOST = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("nths", pa.list_(pa.int32()))])


def unit_bounds(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, in order; the start of every text is one."""
    newline = data == 10
    if unit == "paragraph":  # a blank line ends it
        ends = np.flatnonzero(newline[1:] & newline[:-1]) + 2
    else:
        ends = np.flatnonzero(newline) + 1
    if unit in ("sentence", "clause"):
        stop = np.isin(data, np.frombuffer(b".!?,;:" if unit == "clause" else b".!?", np.uint8))
        ends = np.concatenate([ends, np.flatnonzero(stop[:-1] & (data[1:] == 32)) + 1])
    begin = np.unique(np.concatenate([offsets[:-1], ends]))
    return begin[begin < len(data)]


def units(data: np.ndarray, offsets: np.ndarray, unit: str, least_words: int) -> tuple[np.ndarray, ...]:
    """``document, first byte of the sentence, whole, first byte, end byte, digest, second digest`` of the units that may go, by
    document and first byte.

    ``whole`` is false for the clauses of a longer sentence.
    """
    starts, ends, _ = tk.words(data, offsets)
    hashes = tk.word_hashes(data, starts, ends)
    one, two = tk.SpanHash(hashes), tk.SpanHash(tk.mix(hashes ^ np.uint64(0xA5A5A5A5)))

    def cut(unit: str) -> tuple[np.ndarray, ...]:
        begin = unit_bounds(data, offsets, unit)
        low = np.searchsorted(starts, begin)
        high = np.concatenate([low[1:], [len(starts)]])
        stop = np.concatenate([begin[1:], [len(data)]])
        keep = high > low
        return tuple(v[keep] for v in (np.searchsorted(offsets, begin, "right") - 1, begin, stop, low, high))

    doc, begin, stop, low, high = cut("sentence" if unit == "clause" else unit)
    keep = high - low >= least_words
    found = [tuple(v[keep] for v in (doc, begin, np.ones(len(doc), bool), begin, stop, one(low, high), two(low, high)))]
    if unit == "clause" and len(doc):
        sentence, sentence_low, sentence_high = begin, low, high
        doc, begin, stop, low, high = cut("clause")
        of = np.searchsorted(sentence_low, low, "right") - 1
        sentence, whole = sentence[of], (sentence_low[of] == low) & (sentence_high[of] == high)
        x, y = one(low, high), two(low, high)
        long = high - low >= least_words
        keep = long & ~whole
        found.append(tuple(v[keep] for v in (doc, sentence, whole, begin, stop, x, y)))
        # Short clauses: a digest of the nearest long clause on each side and of the words from there up to the clause's far end.
        short, anchors = np.flatnonzero(~long), np.flatnonzero(long)
        after = np.searchsorted(anchors, short)
        for side, at in enumerate((after - 1, after)):
            own = short[(at >= 0) & (at < len(anchors))]
            anchor = anchors[at[(at >= 0) & (at < len(anchors))]]
            own, anchor = own[doc[own] == doc[anchor]], anchor[doc[own] == doc[anchor]]
            first, last = (low[own], low[anchor]) if side else (high[anchor], high[own])
            with np.errstate(over="ignore"):
                x2, y2 = (tk.mix(v[anchor] * np.uint64(2 * side + 3) + run(first, last)) for v, run in ((x, one), (y, two)))
            found.append((doc[own], sentence[own], whole[own], begin[own], stop[own], x2, y2))
    doc, sentence, whole, begin, stop, x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    # Places are by bytes of all texts, so their order is that of documents too.
    order = np.argsort(begin, kind="stable")
    doc, sentence, whole, begin, stop, x, y = (v[order] for v in (doc, sentence, whole, begin, stop, x, y))
    return doc, sentence - offsets[doc], whole, begin - offsets[doc], stop - offsets[doc], x, y


def numbers(doc: np.ndarray) -> np.ndarray:
    """The number of each unit in its document, for units in order of document."""
    return np.arange(len(doc)) - np.searchsorted(doc, doc)


def keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``docs`` with two key columns that name a document: id and hash of the text, neither null."""
    text = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({KEY[0]: F.coalesce(F.col(doc).cast("long"), F.lit(LAST)), KEY[1]: F.xxhash64(text)})


def ranked(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every document key among the distinct ones, and a row of each of these, in order."""
    order = np.lexsort((h, d))
    new = np.ones(len(d), bool)
    new[1:] = (np.diff(d[order]) != 0) | (np.diff(h[order]) != 0)
    rank = np.empty(len(d), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def later(rank: np.ndarray, nth: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a unit of the same digest comes before each one; a repeated row of the same document does not count."""
    order = np.argsort(x)
    same = x[order[1:]] == x[order[:-1]]
    twice = np.zeros(len(x), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    at = at[np.lexsort((nth[at], rank[at], y[at], x[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (x[at[1:]] != x[at[:-1]]) | (y[at[1:]] != y[at[:-1]])
    first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
    gone = np.zeros(len(x), bool)
    gone[at] = (rank[at] != rank[first]) | (nth[at] != nth[first])
    return gone


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 in two bytes each where they fit, else in four."""
    return numbers.astype(np.uint16 if not len(numbers) or numbers.max() < 1 << 16 else np.uint32).tobytes()


def packed(d: np.ndarray, h: np.ndarray, doc: np.ndarray, nth: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[bytes]:
    """The units of documents ``d, h`` with only the documents that have any."""
    used, place = np.unique(doc, return_inverse=True)
    return [d[used].tobytes(), h[used].tobytes(), narrow(place), narrow(nth), x.tobytes(), y.tobytes()]


def unpacked(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """``d, h, doc, nth, x, y`` of all rows."""
    out, docs = [[] for _ in PACKED], 0
    for row in zip(*(rows.column(c).to_pylist() for c in PACKED), strict=True):
        d, h, y = np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int64), np.frombuffer(row[5], np.uint32)
        doc, nth = (np.frombuffer(v, np.uint16 if len(v) == 2 * len(y) else np.uint32).astype(np.int64) for v in row[2:4])
        for all_, one in zip(out, (d, h, doc + docs, nth, np.frombuffer(row[4], np.uint64), y), strict=True):
            all_.append(one)
        docs += len(d)
    return tuple(np.concatenate(v) for v in out)


def by_document(d: np.ndarray, h: np.ndarray, doc: np.ndarray, nth: np.ndarray) -> pa.Table:
    """A row per document with its unit numbers."""
    order = np.argsort(doc, kind="stable")
    used, first = np.unique(doc[order], return_index=True)
    ends = np.append(first, len(doc)).astype(np.int32)
    return pa.table([pa.array(d[used]), pa.array(h[used]), pa.ListArray.from_arrays(ends, pa.array(nth[order].astype(np.int32)))], schema=LOST)


def sent_units(rows: DataFrame, text: str, unit: str, least_words: int, ranges: int) -> DataFrame:
    """``range`` and packed units: the first of each digest in a task below ``ranges``, and from there on lost ones."""

    def send(parts: list[tuple[np.ndarray, ...]]):
        d, h = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        shift = np.cumsum([0] + [len(p[0]) for p in parts])
        doc = np.concatenate([p[2] + n for p, n in zip(parts, shift)])
        nth, x, y = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        rank, of = ranked(d, h)
        only = of[rank[doc]] == doc  # of repeated rows of one document one is enough
        rank, nth, x, y = rank[doc[only]], nth[only], x[only], y[only]
        d, h = d[of], h[of]
        gone = later(rank, nth, x, y)
        out = []
        if gone.any():
            out.append((ranges + int(h[0]) % ranges, *packed(d, h, rank[gone], nth[gone], x[gone][:0], np.zeros(gone.sum(), np.uint32))))
        at = np.flatnonzero(~gone)
        at = at[np.argsort(x[at])]
        group = ((x[at] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        for one in np.split(at, np.flatnonzero(np.diff(group)) + 1):
            if len(one):
                number = (int(x[one[0]]) >> 32) * ranges >> 32
                out.append((number, *packed(d, h, rank[one], nth[one], x[one], y[one])))
        columns = [pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[k] for o in out], pa.binary()) for k in range(1, 7))]
        return pa.RecordBatch.from_arrays(columns, names=["range", *PACKED])

    def scan(batches: Iterator[pa.RecordBatch]):
        parts, n = [], 0
        for batch, data, offsets in tk.slices(batches, "t"):
            doc, *_, x, y = units(data, offsets, unit, least_words)
            parts.append((tk.long_column(batch, "d"), tk.long_column(batch, "h"), doc, numbers(doc), x, (y >> np.uint64(32)).astype(np.uint32)))
            n += len(doc)
            if n >= GATHERED:
                yield send(parts)
                parts, n = [], 0
        if n:
            yield send(parts)

    kinds = "range int, " + ", ".join(f"{c} binary" for c in PACKED)
    return rows.select(F.col(KEY[0]).alias("d"), F.col(KEY[1]).alias("h"), F.col(text).alias("t")).mapInArrow(scan, kinds)


def repeats(rows: DataFrame, text: str, unit: str, least_words: int) -> DataFrame:
    """``d, h, nths``: the numbers of the units that a document loses, for documents that lose any."""
    ranges = size_of(rows, text)[1] // RANGE_BYTES + 1

    def settle(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        d, h, doc, nth, x, y = unpacked(table)
        if key[0].as_py() < ranges:
            gone = later(ranked(d, h)[0][doc], nth, x, y)
            doc, nth = doc[gone], nth[gone]
        return by_document(d, h, doc, nth)

    lost = sent_units(rows, text, unit, least_words, ranges).groupBy("range").applyInArrow(settle, "d long, h long, nths array<int>")
    return lost.groupBy("d", "h").agg(F.flatten(F.collect_list("nths")).alias("nths"))


def spans_of(column: pa.Array, lost: pa.Array, unit: str, least_words: int) -> pa.Array:
    """Per text the spans of its lost units, in order. A sentence that goes takes its clauses along."""
    found = []
    row = 0
    for batch, data, offsets in tk.slices(iter([pa.RecordBatch.from_arrays([column, lost], names=["t", "nths"])]), "t"):
        doc, sentence, whole, a, b, *_ = units(data, offsets, unit, least_words)
        nths = batch.column(1)
        owner = np.asarray(pc.list_parent_indices(nths)).astype(np.int64)
        # A repeated row of the document has its units lost more than once.
        at = np.unique(np.searchsorted(doc, owner) + np.asarray(pc.list_flatten(nths)).astype(np.int64))
        doc, sentence, whole, a, b = (v[at].astype(np.int64) for v in (doc, sentence, whole, a, b))
        order = np.lexsort((b, a, whole, sentence, doc))
        doc, sentence, whole, a, b = (v[order] for v in (doc, sentence, whole, a, b))
        last = np.ones(len(doc), bool)
        last[:-1] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
        ends = np.flatnonzero(last)
        taken = whole[ends[np.searchsorted(ends, np.arange(len(doc)))]] == 1
        keep = last | ~taken
        spans = np.unique(np.stack([doc[keep] + row, a[keep], b[keep]], 1), axis=0) if keep.any() else np.zeros((0, 3), np.int64)
        found.append(spans)
        row += batch.num_rows
    doc, a, b = np.concatenate([np.zeros((0, 3), np.int64), *found]).T
    ends = np.searchsorted(doc, np.arange(len(column) + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["a", "b"])
    return pa.ListArray.from_arrays(ends, pairs)


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", unit: str = "clause", least_words: int = LEAST_WORDS) -> DataFrame:
    """``record`` (all columns of the row), ``spans`` (removed bytes, offsets of the original text) and ``kept``."""
    rows = keyed(docs, doc, text).select(*KEY, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"))
    lost = repeats(keyed(docs, doc, text), text, unit, least_words)
    joined = rows.join(lost, (F.col(KEY[0]) == F.col("d")) & (F.col(KEY[1]) == F.col("h")), "left")
    raw = F.encode(F.coalesce(F.col("record")[text], F.lit("")), "UTF-8")

    @F.arrow_udf("array<struct<a:int,b:int>>")
    def spans(column: pa.Array, nths: pa.Array) -> pa.Array:
        return spans_of(column, nths, unit, least_words)

    # Only texts that lose something go to Python.
    affected = F.when(F.col("nths").isNotNull(), F.col("record")[text])
    joined = joined.select("record", spans(affected, "nths").alias("spans"), raw.alias("raw"))
    # The kept pieces: from the end of one removed span to the start of the next.
    piece = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda k: F.substring(
            F.col("raw"),
            F.when(k == 0, 0).otherwise(F.get(F.col("spans"), k - 1)["b"]) + 1,
            F.coalesce(F.get(F.col("spans"), k)["a"], F.octet_length("raw")) - F.when(k == 0, 0).otherwise(F.get(F.col("spans"), k - 1)["b"]),
        ),
    )
    kept = F.aggregate(piece, F.lit(b""), lambda all_, one: F.concat(all_, one))
    kept = F.when(F.size("spans") == 0, F.col("raw")).otherwise(kept)
    return joined.select("record", "spans", F.decode(kept, "UTF-8").alias("kept"))
