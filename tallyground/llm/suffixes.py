"""Exact removal of byte strings that an earlier document has too, by blockwise sorting of suffixes with a cover sample.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document with a smaller id. Suffixes
are compared to that depth only. The blockwise scheme sorts one bucket of suffixes at a time and settles ties by the
ranks of a cover sample, so memory is bounded by the bucket:

1. Cover sample. Of every ``length`` bytes the position whose ``GRAM`` bytes have the smallest hash is sampled, about one
   position in eighteen. Like a difference cover it meets every pair of equal suffixes at the same shift, but it is chosen
   by content, not by position modulo a number: a residue cover with the same guarantee needs a fifth of all positions,
   which does not fit the disk limits. Suffixes in a row with the same sample form a run; a run has the sample's name
   and a name of its whole text.
2. Buckets. Runs are dealt to buckets by the sample's name; within a slice of text, runs that repeat an earlier one there
   are settled before. A bucket is sorted by (name, text name, id): runs whose text an earlier document has are covered
   as a whole, and runs whose sample nobody else has are done.
3. Ties. What is left are runs that share the sample but not the whole text with an earlier document, the edges of
   repeated passages. Their bytes are fetched and their suffixes sorted one by one, again bucket by bucket.
4. Groups. A bucket sends what it has found as a blob per group of documents, a group being a hash of id and text; a group
   merges the spans of each of its documents.

A sample that very many different runs share is broken into single suffixes everywhere (``HEAVY``), so that no bucket
holds an unbounded group; the list of such samples is bounded by ``MOST_HEAVY``. Names are 64-bit hashes and two of them
must agree, so that equality is one of 112 bits.

Cases: a null text is empty; texts shorter than ``length`` lose nothing; a null id comes after all others; rows with the
same id never cover each other, and are told apart by 32 bits of a hash of their text; repeated rows each get the same
result; an empty table gives an empty result; further
columns travel inside ``record``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.llm import textkit as tk
from tallyground.llm.frames import size_of
from tallyground.settings import cut_lineage

LENGTH = 50
GRAM = 16
# Bytes of text whose runs are combined and sent together, and bytes of text per bucket.
SLICE = 8 << 20
BUCKET_BYTES = 8 << 20
# Bytes of text of a group of documents; the spans of a group are merged together.
GROUP_BYTES = 16 << 20
# Bytes of text that are hashed at once, and rows that are turned into Python objects at once.
HASHED = 1 << 20
ROWS = 256
# A sample is heavy from so many runs on, and from this share of all slices' runs.
HEAVY = 2000
MOST_HEAVY = 1_000_000
LAST = (1 << 63) - 1

RUN = (("h", np.uint64), ("c", np.uint64), ("doc", np.uint32), ("a", np.uint32), ("n", np.uint32))
SPAN = (("h", np.uint64), ("a", np.uint32), ("n", np.uint32), ("kind", np.uint8))
COVERED, TIE = 0, 1


def to_blob(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes, equal places of the numbers together, which compresses well."""
    return b"".join([len(arrays[0]).to_bytes(4, "little"), *(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)])


def from_blob(blob: bytes, kinds) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:4], "little"), 4, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * size
    return out


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """``first byte, end byte, sample's name, text's name, document`` of every run, and the hasher of the slice."""
    spans = tk.SpanHash(tk.BYTE_CODES[data])
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, spans
    least, width, size = spans.windows(gram), length - gram + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: -(width - size)], least[width - size :])
    fits = np.ones(len(least), bool)
    tail = np.maximum(offsets[:-1], offsets[1:] - length + 1)
    outside = tk.expand(tail, offsets[1:] - tail)
    fits[outside[outside < len(fits)]] = False
    at = np.flatnonzero(fits)
    name = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1 if len(at) else first
    a, b = at[first], at[last] + length
    return a, b, name[first], spans(a, b), np.searchsorted(offsets, a, "right") - 1, spans


def collected(batches: Iterator[pa.RecordBatch], length: int, gram: int, heavy: np.ndarray):
    """Runs of about ``SLICE`` bytes of text at once: ids, text keys, and the runs with their document's number there."""
    held, size = [], 0
    ids, keys, base = [], [], 0
    for batch, data, offsets in tk.slices(batches, "t", HASHED):
        a, b, h, c, doc, spans = runs(data, offsets, length, gram)
        if len(heavy) and len(a):
            place = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
            split = heavy[place] == h
            if split.any():
                n = (b - a)[split] - length + 1
                starts = tk.expand(a[split], n)
                names = spans(starts, starts + length)
                a, b = np.concatenate([a[~split], starts]), np.concatenate([b[~split], starts + length])
                h, c = np.concatenate([h[~split], tk.mix(names)]), np.concatenate([c[~split], names])
                doc = np.concatenate([doc[~split], np.repeat(doc[split], n)])
        held.append((h, c, *(v.astype(np.int32) for v in (doc + base, a - offsets[doc], b - a))))
        ids.append(tk.long_column(batch, "d"))
        keys.append(tk.long_column(batch, "k"))
        base, size = base + batch.num_rows, size + len(data)
        if size >= SLICE:
            yield np.concatenate(ids), np.concatenate(keys), [np.concatenate(v) for v in zip(*held, strict=True)]
            held, size, ids, keys, base = [], 0, [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(keys), [np.concatenate(v) for v in zip(*held, strict=True)]


def grouped(*keys: np.ndarray):
    """Order by the keys (first one first) and, per key, whether a row opens a new group of it and all before."""
    order = np.lexsort(keys[::-1])
    opens, new = [], np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for key in keys:
        own = key[order]
        new = new.copy()
        new[1:] |= own[1:] != own[:-1]
        opens.append(new)
    return order, opens


def decide(h: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs an earlier document covers, and which share their sample with other runs without being settled."""
    covered, tie = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if not len(h):
        return covered, tie
    # Most samples are alone; they need no further look.
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h), bool)
    same[1:] = h[order][1:] == h[order][:-1]
    same[:-1] |= same[1:]
    rows = order[same]
    order, (of_h, of_c, _) = grouped(h[rows], c[rows], d[rows])
    rows = rows[order]
    first_c = np.flatnonzero(of_c)
    least = d[rows][first_c][np.cumsum(of_c) - 1]
    covered[rows] = d[rows] > least
    if len(rows):
        group = np.cumsum(of_h) - 1
        begin = np.flatnonzero(of_h)
        low, high = np.minimum.reduceat(d[rows], begin)[group], np.maximum.reduceat(d[rows], begin)[group]
        texts = np.add.reduceat(of_c.astype(np.int64), begin)[group]
        tie[rows] = ~covered[rows] & (texts > 1) & (low < high)
    return covered, tie


def group_of(d: np.ndarray, k: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that a document belongs to; the copies of a text fall into different ones."""
    spread = (d % (1 << 31)) * 2654435761 ^ (k << 15)
    return (spread >> 17) % groups


def by_group(d, k, h, a, n, kind, groups: int) -> pa.Table:
    """The spans as one blob per group of documents, so that rows follow the bytes and not documents times buckets."""
    order = np.lexsort((a, k, d))
    d, k, h, a, n, kind = (v[order] for v in (d, k, h, a, n, kind))
    # Repeated rows of the table have given the same span more than once.
    again = np.zeros(len(d), bool)
    again[1:] = (d[1:] == d[:-1]) & (k[1:] == k[:-1]) & (a[1:] == a[:-1]) & (n[1:] == n[:-1]) & (kind[1:] == kind[:-1])
    group = group_of(d, k, groups)
    group[again] = -1
    order = np.argsort(group, kind="stable")[int(again.sum()) :]
    names, begin = np.unique(group[order], return_index=True)
    parts = np.split(order, begin[1:]) if len(order) else []
    blobs = [to_blob(d[p], k[p].astype(np.uint32), h[p], a[p], n[p], kind[p]) for p in parts]
    ties = [int((kind[p] == TIE).sum()) for p in parts]
    return pa.table({"g": pa.array(names.astype(np.int32)), "spans": pa.array(blobs, pa.binary()), "ties": pa.array(ties, pa.int32())})


GROUPS_TYPE = "g int, spans binary, ties int"
SPANS_TYPE = "d long, k long, spans binary"


def of_group(table: pa.Table, kind: int) -> list[np.ndarray]:
    """``d, k, h, a, n`` of the spans of one kind, by document, then place."""
    parts = [from_blob(b, (np.int64, np.uint32, *(t for _, t in SPAN))) for b in table.column("spans").to_pylist()]
    d, k, h, a, n, kinds = (np.concatenate(v) for v in zip(*parts, strict=True))
    order = np.flatnonzero(kinds == kind)
    order = order[np.lexsort((a[order], k[order], d[order]))]
    return [d[order], k[order].astype(np.int64), h[order], a[order], n[order]]


def per_document(d: np.ndarray, k: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row per document with its part of the columns as a blob; rows are in order of the documents."""
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(d))
    blobs = [to_blob(*(c[s:e] for c in columns)) for s, e in zip(begin.tolist(), stop.tolist(), strict=False)]
    return pa.table({"d": pa.array(d[begin]), "k": pa.array(k[begin]), "spans": pa.array(blobs, pa.binary())})


def ties_of(table: pa.Table) -> pa.Table:
    """Per document of a group its tied runs."""
    return per_document(*of_group(table, TIE))


def stretches_of(table: pa.Table) -> pa.Table:
    """Per document of a group its covered stretches, disjoint."""
    d, k, _, a, n = of_group(table, COVERED)
    if not len(d):
        return per_document(d, k, a, n)
    # All documents on one line, each further on than the one before can reach.
    doc = np.cumsum(np.append(0, (d[1:] != d[:-1]) | (k[1:] != k[:-1])))
    place = (doc << 33) + a.astype(np.int64)
    reach = np.maximum.accumulate(place + n)
    new = np.append(True, place[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    end = reach[np.append(begin[1:], len(d)) - 1] - (doc[begin] << 33)
    return per_document(d[begin], k[begin], a[begin], end.astype(np.uint32))


def heavy_samples(texts: DataFrame, length: int, gram: int) -> np.ndarray:
    """Names of samples that very many different runs share; at most ``MOST_HEAVY``."""

    def scan(batches: Iterator[pa.RecordBatch]):
        for _, _, (h, c, *_) in collected(batches, length, gram, np.zeros(0, np.uint64)):
            pairs = _distinct(h, c)
            names, counts = np.unique(pairs[:, 0], return_counts=True)
            often = counts >= 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(names[often].view(np.int64), 0)), pa.array(np.append(counts[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), len(pairs)))],
                names=["h", "n", "runs"],
            )

    found = cut_lineage(texts.mapInArrow(scan, "h long, n long, runs long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs")))
    total = found.agg(F.sum("runs")).first()[0] or 0
    # Each heavy sample has more than this many runs, so there are at most MOST_HEAVY of them.
    least = max(HEAVY, total // MOST_HEAVY + 1)
    return np.sort(np.array([r.h for r in found.filter(F.col("n") >= least).select("h").collect()], np.int64).view(np.uint64))


def _distinct(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    order, (_, new) = grouped(h, c)
    return np.column_stack([h, c])[order[new]]


def found_runs(texts: DataFrame, buckets: int, groups: int, length: int, gram: int) -> DataFrame:
    """Covered runs and ties, a blob per bucket and group of documents."""
    heavy = texts.sparkSession.sparkContext.broadcast(heavy_samples(texts, length, gram))

    def deal(batches: Iterator[pa.RecordBatch]):
        for ids, keys, (h, c, doc, a, n) in collected(batches, length, gram, heavy.value):
            # Settled here: runs that an earlier document of this slice has. They travel on as covered, spread by
            # document, so that a common passage sends its bucket no more than one document's runs per slice.
            done, _ = decide(h, c, ids[doc])
            spread = tk.mix(ids.view(np.uint64))[doc]
            bucket = (np.where(done, spread, h) >> np.uint64(11)) % np.uint64(buckets)
            rows, own = [], np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[own], np.arange(buckets + 1).astype(np.uint64))
            for j in range(buckets):
                pick = own[edges[j] : edges[j + 1]]
                if len(pick):
                    docs, local = np.unique(doc[pick], return_inverse=True)
                    size = (n[pick].astype(np.uint32) << np.uint32(1)) | done[pick].astype(np.uint32)
                    rows.append((j, to_blob(h[pick], (c[pick] >> np.uint64(16)).astype(np.uint32), (c[pick] & np.uint64(0xFFFF)).astype(np.uint16), local.astype(np.uint32), a[pick].astype(np.uint32), size), to_blob(ids[docs], keys[docs].astype(np.uint32))))
            for at in range(0, len(rows), 256):
                part = list(zip(*rows[at : at + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.binary())], names=["bucket", "runs", "docs"])

    def settle(table: pa.Table) -> pa.Table:
        parts = []
        for blob, docs in zip(table.column("runs").to_pylist(), table.column("docs").to_pylist(), strict=True):
            h, c1, c2, local, a, n = from_blob(blob, (np.uint64, np.uint32, np.uint16, np.uint32, np.uint32, np.uint32))
            ids, keys = from_blob(docs, (np.int64, np.uint32))
            parts.append((h, c1.astype(np.uint64) << np.uint64(16) | c2, ids[local], keys[local].astype(np.int64), a, n))
        h, c, d, k, a, n = (np.concatenate(v) for v in zip(*parts, strict=True))
        done, n = (n & np.uint32(1)).astype(bool), n >> np.uint32(1)
        covered, tie = decide(h, c, d)
        keep = covered | tie | done
        kind = np.where(covered | done, COVERED, TIE).astype(np.uint8)
        return by_group(d[keep], k[keep], h[keep], a[keep], n[keep], kind[keep], groups)

    dealt = texts.mapInArrow(deal, "bucket int, runs binary, docs binary")
    return cut_lineage(dealt.groupBy("bucket").applyInArrow(settle, GROUPS_TYPE))


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def settled_ties(texts: DataFrame, found: DataFrame, buckets: int, groups: int, length: int) -> DataFrame:
    """The suffixes of tied runs that an earlier document has."""
    tied = found.filter("ties > 0").groupBy("g").applyInArrow(ties_of, SPANS_TYPE)
    joined = texts.join(tied, ["d", "k"])

    def fetch(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches):
            out: list[tuple] = []
            for d, k, text, blob in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("d", "k", "t", "spans")), strict=True):
                raw = text.encode()
                h, a, n = from_blob(blob, (np.uint64, np.uint32, np.uint32))
                for j in range(len(h)):
                    out.append((int(h[j] >> np.uint64(11)) % buckets, int(h[j].view(np.int64)), d, k, int(a[j]), raw[int(a[j]) : int(a[j] + n[j])]))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                names = ("bucket", "h", "d", "k", "a", "run")
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, kinds, strict=True)], names=names)

    def settle(table: pa.Table) -> pa.Table:
        whole = table.column("run").to_pylist()
        data = np.frombuffer(b"".join(whole), np.uint8)
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        n = size - length + 1
        starts = tk.expand(np.cumsum(size) - size, n)
        row = np.repeat(np.arange(len(whole)), n)
        suffix = tk.SpanHash(tk.BYTE_CODES[data])(starts, starts + length)
        h, d, k, a = (np.asarray(table.column(c)) for c in ("h", "d", "k", "a"))
        order, (_, same, _) = grouped(h[row], suffix, d[row])
        least = d[row[order]][np.flatnonzero(same)][np.cumsum(same) - 1]
        hit = order[d[row[order]] > least]
        own = row[hit]
        place = (a[own] + starts[hit] - (np.cumsum(size) - size)[own]).astype(np.uint32)
        none = np.full(len(own), COVERED, np.uint8)
        return by_group(d[own], k[own], np.zeros(len(own), np.uint64), place, np.full(len(own), length, np.uint32), none, groups)

    pulled = joined.mapInArrow(fetch, "bucket int, h long, d long, k long, a int, run binary")
    return pulled.groupBy("bucket").applyInArrow(settle, GROUPS_TYPE)


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, removed`` (stretches of bytes) and ``kept`` (the remaining bytes) for every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(LAST)).alias("d"), (F.xxhash64(t).bitwiseAND(F.lit(0xFFFFFFFF))).alias("k"), t.alias("t"), F.col(doc).cast("long").alias("id"))
    n_bytes = size_of(docs, text)[1]
    buckets, groups = (max(1, math.ceil(n_bytes / size)) for size in (BUCKET_BYTES, GROUP_BYTES))
    found = found_runs(texts, buckets, groups, length, gram)
    every = found.unionByName(settled_ties(texts, found, buckets, groups, length)).groupBy("g").applyInArrow(stretches_of, SPANS_TYPE)
    joined = texts.join(every, ["d", "k"], "left")

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in small(batches):
            ids, sizes, lost, kept = [], [], [], []
            for i, raw, blob in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = raw.encode()
                cuts = list(zip(*(v.tolist() for v in from_blob(blob, (np.uint32, np.uint32))), strict=True)) if blob else []
                edges = [0, *(x for pair in cuts for x in pair), len(raw)]
                ids.append(i)
                sizes.append(len(raw))
                lost.append([{"a": a, "b": b} for a, b in cuts])
                kept.append(b"".join(raw[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)))
            stretch = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lost, stretch), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<a:long,b:long>>, kept binary")
