"""MinHash near-dedup of documents with DartMinHash signatures on weighted word shingles.

A document is a set of shingles (five consecutive words) weighted by how often they occur. Seeded hashes throw darts of
density one at the plane of weight and rank of every shingle, in regions that double in size: the darts of a region, their
weight, rank and coordinate follow from the shingle alone. A document keeps the darts below its weights, and per
coordinate the one of the smallest rank; two documents agree in a coordinate with the probability of their weighted
Jaccard similarity. Only about ``t log t + 2 t`` darts are looked at, whatever the document's length.

Documents that agree in all coordinates of one of ``BANDS`` bands meet in a bucket. Each candidate pair is verified on whole
texts, and classes are the connected components.

1. A bucket of at most ``SMALL`` members lists all its pairs. A larger one links its members to ``LEADERS`` of them, so that
   pairs grow with its members; ``TURNS`` times it then draws further leaders, if its members are in several components.
2. Larger buckets that still hold several components are settled exactly: their members are joined on the rare shingles that
   two similar texts must share (prefix filter, each occurrence of a shingle counts), where their components differ and
   sizes, places and sketches of all tokens leave room for the similarity. One pair for each two components is verified first, then all pairs
   whose components that has not joined. So no link of a bucket is lost. Members that are nearly similar, but in a component
   each, cost a comparison per pair that shares such a shingle.

Documents with equal word sequences are one node (64-bit hash) before banding, so copies cost nothing further.

Cases: a text with fewer than five words, but not none, is one shingle; texts without words, null ones too, are copies
of one another; a null id comes after all others; repeated rows are copies; an empty table gives an empty result;
further columns are carried along by ``keep_first``, whatever their names, and ignored by ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.llm import textkit as tk
from tallyground.operators.components import connected_components
from tallyground.settings import cut_lineage

SHINGLE = 5
# Tokens before a common one that are compared to tell whether a pair was met earlier.
BEFORE = 6
SIMILARITY = 0.8
# A pair of similarity 0.8 is missed by all bands with probability (1 - 0.8^4)^24, below 4 in a million.
BANDS = 24
BAND_ROWS = 4
# Leaders that a bucket compares its members with in one round, and rounds after the first.
LEADERS = 3
TURNS = 2
# Members of a bucket whose pairs are all verified at once.
SMALL = 8
# Words of 64 bits in the sketch of an unsettled text.
SKETCH = 8
BITS = [f"bits{k}" for k in range(SKETCH)]
# Hash classes in which shingles are counted to order them by rarity, and the bits of a shingle's key below its rarity.
RARITY_CLASSES = 1 << 20
RARITY_SHIFT = 58
RANK_UNIT = 0.125
LAST = (1 << 63) - 1
ELEMENT_BITS = 50

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def elements(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE):
    """``document, element, count`` of the shingles, in order of document and element, and each text's word hash."""
    n = len(offsets) - 1
    starts, ends, doc = tk.words(data, offsets)
    hashes = tk.SpanHash(tk.word_hashes(data, starts, ends))
    n_words = np.bincount(doc, minlength=n)
    first = np.cumsum(n_words) - n_words
    per_doc = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(n), per_doc)
    begin = tk.expand(first, per_doc)
    end = np.minimum(begin + shingle, (first + n_words)[owner])
    keys = np.sort((owner.astype(_U) << _U(ELEMENT_BITS)) | (hashes(begin, end) >> _U(64 - ELEMENT_BITS)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    whole = hashes(first, first + n_words)
    return (keys >> _U(ELEMENT_BITS)).astype(np.int64), keys & _U((1 << ELEMENT_BITS) - 1), count, whole


def poisson(uniform: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts by inversion."""
    k = np.arange(int(mean + 12 * np.sqrt(mean) + 24))
    logs = -mean + k * np.log(mean) - np.concatenate([[0], np.cumsum(np.log(k[1:]))])
    return np.searchsorted(np.cumsum(np.exp(logs)), uniform, "right").clip(0, len(k) - 1)


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, docs: int, t: int) -> np.ndarray:
    """The earliest dart of each of ``t`` coordinates, one row per document; zeros for documents without elements."""
    total = np.bincount(doc, count, minlength=docs)
    wanted = (t * np.log(t) + 2 * t) / np.maximum(total, 1)  # rank up to which that many darts are expected
    best = np.zeros((docs, t), _U)
    rank_of = np.full((docs, t), np.inf)
    level, todo = 0, total > 0
    while todo.any():
        low = (2.0**level - 1) * RANK_UNIT
        own = np.flatnonzero(todo[doc])
        found = []
        weight_level = 0
        while len(own):
            with np.errstate(over="ignore"):
                seed = tk.mix(element[own] * _A + _U(level * 64 + weight_level) * _B)
            n = np.zeros(len(own), np.int64)
            mean = 2.0**level * 2.0**weight_level * RANK_UNIT
            uniform = (seed >> _U(11)) * 2.0**-53
            hit = np.flatnonzero(uniform >= np.exp(-mean))
            n[hit] = poisson(uniform[hit], mean)
            source = np.repeat(np.arange(len(own)), n)
            with np.errstate(over="ignore"):
                dart = tk.mix(seed[source] + (tk.expand(np.zeros(len(own), np.int64), n).astype(_U) + _U(1)) * _C)
            if weight_level:
                weight = 2.0**weight_level - 1 + (tk.mix(dart ^ _B) >> _U(11)) * 2.0**-53 * 2.0**weight_level
                keep = weight < count[own[source]]
                source, dart = source[keep], dart[keep]
            found.append((doc[own[source]], dart))
            weight_level += 1
            own = own[count[own] >= 2**weight_level]
        where = np.concatenate([f[0] for f in found])
        dart = np.concatenate([f[1] for f in found])
        draw = tk.mix(dart ^ _A)
        rank = low + (draw >> _U(24)) * 2.0**-40 * 2.0**level * RANK_UNIT
        slot = where * t + ((draw & _U(0xFFFFFF)) * _U(t) >> _U(24)).astype(np.int64)
        # Ranks of a level lie above those of the levels before it: only open coordinates take its darts.
        free = np.isinf(rank_of.ravel()[slot])
        slot, rank, dart = slot[free], rank[free], dart[free]
        order = np.argsort(-rank, kind="stable")  # the earliest is written last
        best.ravel()[slot[order]] = dart[order]
        rank_of.ravel()[slot] = low
        level += 1
        todo &= (wanted > (2.0**level - 1) * RANK_UNIT) | np.isinf(rank_of).any(1)
    return best


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per document and band."""
    parts = signature.reshape(len(signature), bands, -1)
    key = np.tile(np.arange(1, bands + 1, dtype=_U), (len(signature), 1))
    with np.errstate(over="ignore"):
        for k in range(parts.shape[2]):
            key = tk.mix(key * _A + parts[:, :, k])
    return key.view(np.int64)


def texts_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``d, k, t``: a key of id and text that is never null, and the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(t).alias("k"), t.alias("t"))


def signed(texts: DataFrame, bands: int, band_rows: int, shingle: int) -> DataFrame:
    """``d, k, node, bands``: the word hash and the band keys of every document."""

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch, data, offsets in tk.slices(batches, "t"):
            doc, element, count, whole = elements(data, offsets, shingle)
            keys = band_keys(signatures(doc, element, count, batch.num_rows, bands * band_rows), bands)
            column = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole.view(np.int64)), column], names=["d", "k", "node", "bands"])

    return texts.mapInArrow(scan, "d long, k long, node long, bands array<long>")


def similarities(left: pa.Array, right: pa.Array, shingle: int) -> np.ndarray:
    """Weighted Jaccard similarity of texts, pair by pair."""
    sides = []
    for column in (left, right):
        data, offsets = tk.text_bytes(column)
        doc, element, count, _ = elements(data, offsets, shingle)
        sides.append(((doc.astype(_U) << _U(ELEMENT_BITS)) | element, count))
    (a, n), (b, m) = sides
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    owner = lambda keys: (keys >> _U(ELEMENT_BITS)).astype(np.int64)
    size = len(left)
    both = np.bincount(owner(common), np.minimum(n[i], m[j]), minlength=size)
    every = np.bincount(owner(a), n, minlength=size) + np.bincount(owner(b), m, minlength=size)
    return both / np.maximum(every - both, 1)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs ``u, v`` of nodes whose texts are similar enough."""
    one = pairs.join(texts.select(F.col("node").alias("u"), F.col("t").alias("a")), "u")
    two = one.join(texts.select(F.col("node").alias("v"), F.col("t").alias("b")), "v")

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch, *_ in tk.slices(batches, "a", 1 << 20):
            alike = similarities(batch.column(2), batch.column(3), shingle) >= least
            yield batch.select(["u", "v"]).filter(pa.array(alike))

    return two.select("u", "v", "a", "b").mapInArrow(scan, "u long, v long")


def tokens(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """``document, token``: a token for each occurrence of a shingle, so that the sets have the weighted similarity."""
    doc, element, count, _ = elements(data, offsets, shingle)
    with np.errstate(over="ignore"):
        nth = tk.expand(np.zeros(len(count), np.int64), count).astype(_U)
        return np.repeat(doc, count), tk.mix(np.repeat(element, count) * _A + nth * _C)


def rarity(texts: DataFrame, shingle: int) -> np.ndarray:
    """Per hash class the bits of its number of tokens."""

    def scan(batches: Iterator[pa.RecordBatch]):
        n = np.zeros(RARITY_CLASSES, np.int64)
        for _, data, offsets in tk.slices(batches, "t"):
            n += np.bincount((tokens(data, offsets, shingle)[1] % _U(RARITY_CLASSES)).astype(np.int64), minlength=RARITY_CLASSES)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["c", "n"])

    counts = texts.select("t").mapInArrow(scan, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    bits = np.zeros(RARITY_CLASSES, np.uint8)
    bits[np.asarray(counts["c"])] = np.log2(np.asarray(counts["n"]) + 1).astype(np.uint8)
    return bits


def prefixes(texts: DataFrame, bits: np.ndarray, shingle: int, least: float) -> DataFrame:
    """``token, node, root, size, at, short, before``: the rarest tokens of a text, of which any similar one has one.

    ``short`` marks those that are enough on the smaller side of a pair; ``before`` holds up to ``BEFORE`` tokens that come
    right before. ``bits`` is a sketch of all tokens, each of which turns over one bit: two texts differ in at least as many
    tokens as bits.
    """

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch, data, offsets in tk.slices(batches, "t"):
            doc, token = tokens(data, offsets, shingle)
            wide = 64 * SKETCH
            turned = np.bincount(doc * wide + (token % _U(wide)).astype(np.int64), minlength=batch.num_rows * wide) & 1
            sketch = np.packbits(turned.astype(bool).reshape(-1, wide), axis=1).view(np.int64)
            key = (bits[(token % _U(RARITY_CLASSES)).astype(np.int64)].astype(_U) << _U(RARITY_SHIFT)) | (token >> _U(64 - RARITY_SHIFT))
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            size = np.bincount(doc, minlength=batch.num_rows)
            at = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
            size = size[doc]
            # Two texts of similarity s share s of the larger one's size at least, and 2s / (1 + s) of the smaller one's.
            keep = at <= size - np.ceil(least * size - 1e-6)
            short = at <= size - np.ceil(2 * least / (1 + least) * size - 1e-6)
            own = np.flatnonzero(keep)
            n = np.minimum(at[own], BEFORE)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            before = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[tk.expand(own - n, n)].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[keep].view(np.int64)), pa.array(tk.long_column(batch, "node")[doc[keep]]), pa.array(tk.long_column(batch, "root")[doc[keep]]),
                    pa.array(size[keep].astype(np.int32)), pa.array(at[keep].astype(np.int32)), pa.array(short[keep]), before,
                    *(pa.array(sketch[doc[keep], k]) for k in range(SKETCH)),
                ],
                names=["token", "node", "root", "size", "at", "short", "before", *BITS],
            )

    kinds = "token long, node long, root long, size int, at int, short boolean, before array<long>" + "".join(f", {c} long" for c in BITS)
    return texts.select("node", "root", "t").mapInArrow(scan, kinds)


def across(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """``u, v, a, b, room``: nodes of different components (``a < b``) that may be similar, and the most they can share of all
    their shingles. ``texts``: ``node, root, t``."""
    every = cut_lineage(prefixes(texts, rarity(texts, shingle), shingle, least))
    # Tokens of one component only link nothing; what is left is joined on the token, where Spark splits hot ones.
    several = every.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
    every = cut_lineage(every.join(several, "token"))
    one = every.filter("short").select("token", *(F.col(c).alias(f"x_{c}") for c in ("node", "root", "size", "at", "before", *BITS)))
    most = F.least("at", "x_at") + F.least(F.col("size") - F.col("at"), F.col("x_size") - F.col("x_at"))
    both = F.col("size") + F.col("x_size")
    ordered = (F.struct("x_size", "x_node") < F.struct("size", "node")) & (F.col("root") != F.col("x_root"))
    fits = (F.col("x_size") >= F.col("size") * least - 1e-6) & (most * (1 + least) >= both * least - 1e-6)
    # Texts that differ in so many tokens share half of the others at most.
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"x_{c}"))) for c in BITS), F.lit(0))
    fits &= apart * (1 + least) <= both * (1 - least) + 1e-6
    # A pair that shares a token right before this one is met there already, as its nodes are in different components; so a pair
    # makes about one row, not one per common token.
    met = every.join(one, "token").filter(ordered & fits & ~F.arrays_overlap("before", "x_before"))
    first = F.col("x_root") < F.col("root")
    sides = [F.when(first, F.col(f"x_{c}")).otherwise(F.col(c)) for c in ("node", "root")]
    others = [F.when(first, F.col(c)).otherwise(F.col(f"x_{c}")) for c in ("node", "root")]
    met = met.select(sides[0].alias("u"), others[0].alias("v"), sides[1].alias("a"), others[1].alias("b"), (most / (both - most)).alias("room"))
    return met.groupBy("u", "v", "a", "b").agg(F.min("room").alias("room"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links ``u, v``."""
    own = roots.select(F.col("node").alias("u"), F.col("root").alias("a"))
    edges = links.join(own, "u", "left").join(own.select(F.col("u").alias("v"), F.col("a").alias("b")), "v", "left")
    edges = edges.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    # Roots that move, and nodes that had no root before.
    step = cut_lineage(connected_components(cut_lineage(edges.distinct())).select(F.col("u").alias("node"), "root"))
    onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
    known = roots.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return cut_lineage(known.unionByName(step))


def components(members: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """``node, root`` for nodes that are not the root of their class, from ``members`` (``key, n, node``) of shared buckets of
    ``n`` nodes."""
    few = members.filter(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("ns"))
    few = few.select(F.explode(F.flatten(F.transform("ns", lambda u, i: F.transform(F.slice("ns", i + 2, SMALL), lambda v: F.struct(u.alias("u"), v.alias("v")))))).alias("p"))
    members = members.filter(F.col("n") > SMALL)
    chosen = [F.min("node").alias("l0")] + [F.min_by("node", F.xxhash64(F.lit(k), "node")).alias(f"l{k}") for k in range(1, LEADERS)]
    leaders = members.groupBy("key").agg(*chosen).select("key", F.explode(F.array(*(f"l{k}" for k in range(LEADERS)))).alias("v"))
    asked = members.join(leaders, "key").filter("node <> v").select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"))
    tried = cut_lineage(asked.unionByName(few.select("p.u", "p.v")).distinct())
    links = cut_lineage(verified(tried, texts, shingle, least))
    if links.isEmpty():
        roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    else:
        roots = cut_lineage(connected_components(links).select(F.col("u").alias("node"), "root"))
    members = cut_lineage(members.select("key", "node"))
    for turn in range(TURNS + 1):
        sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
        placed = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        placed = cut_lineage(placed.join(sizes, "root", "left").select("key", "node", "root", F.coalesce("size", F.lit(0)).alias("size")))
        open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
        placed = cut_lineage(placed.join(open_keys, "key"))
        if placed.isEmpty():
            return roots
        if turn == TURNS:
            break
        # Members of a bucket's largest component, and one of its smallest, are further leaders; those outside the largest ask.
        one = F.struct("node", "root")
        draw = [F.xxhash64(F.lit(turn + 1), F.lit(k), "key", "node") for k in range(LEADERS + 1)]
        large = [F.max_by(one, F.struct("size", "root", draw[k])) for k in range(LEADERS)]
        large = F.array(*large, F.min_by(one, F.struct("size", draw[LEADERS]))).alias("ls")
        leaders = placed.groupBy("key").agg(large)
        leaders = leaders.select("key", F.col("ls")[0]["root"].alias("main"), F.explode(F.array_distinct("ls")).alias("l"))
        asked = placed.join(leaders, "key").filter("root <> main and root <> l.root")
        asked = asked.select(F.least("node", "l.node").alias("u"), F.greatest("node", "l.node").alias("v")).distinct()
        asked = cut_lineage(asked.join(tried, ["u", "v"], "left_anti"))
        tried = tried.unionByName(asked)
        links = cut_lineage(verified(asked, texts, shingle, least))
        if not links.isEmpty():
            roots = joined(roots, links)

    unsettled = cut_lineage(texts.join(placed.select("node", "root").distinct(), "node").select("node", "root", "t"))
    known = tried.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
    pairs = across(unsettled, shingle, least).withColumns({"x": F.least("u", "v"), "y": F.greatest("u", "v")})
    pairs = cut_lineage(pairs.join(known, ["x", "y"], "left_anti").select("u", "v", "a", "b", "room"))
    likely = pairs.groupBy("a", "b").agg(F.max_by(F.struct("u", "v"), F.struct("room", "u", "v")).alias("p")).select("p.u", "p.v")
    links = cut_lineage(verified(likely, unsettled, shingle, least))
    if not links.isEmpty():
        roots = joined(roots, links)
    # Of the others, those between components that are still apart.
    own = roots.select(F.col("node").alias("a"), F.col("root").alias("p"))
    rest = pairs.join(likely, ["u", "v"], "left_anti").join(own, "a", "left").join(own.select(F.col("a").alias("b"), F.col("p").alias("q")), "b", "left")
    rest = rest.filter(F.coalesce("p", "a") != F.coalesce("q", "b")).select("u", "v")
    links = cut_lineage(verified(rest, unsettled, shingle, least))
    return roots if links.isEmpty() else joined(roots, links)


def classes(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", least: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """``d, k, copies, class_d, class_k``: every document (id and text key) with the first document of its class."""
    texts = texts_of(docs, doc, text)
    rows = cut_lineage(signed(texts, bands, band_rows, shingle))
    first = F.min(F.struct("d", "k"))
    nodes = cut_lineage(rows.groupBy("node").agg(first.alias("first"), F.max("bands").alias("bands")))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(keys.join(shared, "key"))
    asked = members.select("node").distinct().join(nodes.select("node", "first.d", "first.k"), "node")
    # A document that stands in the table several times is fetched once.
    bodies = cut_lineage(texts.join(asked, ["d", "k"]).groupBy("node").agg(F.first("t").alias("t")))
    roots = components(members, bodies, shingle, least)
    placed = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    of_node = placed.join(heads, "root").select("node", "head")
    alike = rows.groupBy("d", "k", "node").agg(F.count(F.lit(1)).alias("copies"))
    return alike.join(of_node, "node").select("d", "k", "copies", F.col("head.d").alias("class_d"), F.col("head.k").alias("class_k"))


def keep_first(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The first document of each class (smallest id, then text key), with all its columns."""
    names = docs.columns
    inner = docs.toDF(*(f"own {k}" for k in range(len(names))))
    own_doc, own_text = f"own {names.index(doc)}", f"own {names.index(text)}"
    kept = classes(inner, own_doc, own_text, least).filter("d = class_d and k = class_k").select("d", "k", "copies")
    kept = cut_lineage(kept)
    keyed = inner.withColumns({"d": F.coalesce(F.col(f"`{own_doc}`").cast("long"), F.lit(LAST)), "k": F.xxhash64(F.coalesce(F.col(f"`{own_text}`"), F.lit("")))})
    joined = keyed.join(kept, ["d", "k"])
    out = joined.filter("copies = 1")
    if not kept.filter("copies > 1").isEmpty():
        # Rows that stand in the table several times: one of each stays.
        out = out.unionByName(joined.filter("copies > 1").dropDuplicates(["d", "k"]))
    return out.select(*inner.columns).toDF(*names)
