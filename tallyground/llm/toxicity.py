"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

A sample of labelled documents, bounded by ``SAMPLE`` rows and the same on every run, is split by hash: one part gives
a lexicon (words whose document frequency is much higher in toxic documents), one trains the trees, one calibrates.
Features are densities and rates: lexicon, lexicon near a second-person word, capitals, punctuation, obfuscation. All
documents are then scored in one scan without a shuffle.

Only rows whose crc32(id as text) mod 3 is not 1 are learned from. Labels, language, source and id are no features.

Cases: null text counts as empty; an empty text has a score like any other; null labels are no labels; of repeated
labels of one id the largest holds; a null id is held out; without both classes among the labels every score is the
share of toxic labels (0 if there are none); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyground.llm import textkit as tk
from tallyground.settings import cut_lineage

# Bounds of what is learned from and of the lexicon.
SAMPLE = 24_000
LEXICON = 400
LEAST_DOCS = 3
LEAST_LOG_ODDS = 1.5
NEAR = 5
REJECT_AT = 0.7

# Second-person words of the languages in use.
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie",
                 "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "vosotros", "ti", "tus"]
# Characters that stand in for letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = ("words", "lexicon", "weight", "strongest", "hits", "near", "you", "capitals", "shouted", "exclaimed", "asked",
            "punctuation", "digits", "noise", "disguised", "disguised_hits", "stretched")

_PLAIN = tk.LOWER.copy()
for _sign, _letter in LOOKALIKE.items():
    _PLAIN[ord(_sign)] = ord(_letter)
_SOFT = tk.WORD_BYTE.copy()
_SOFT[[ord("@"), ord("$")]] = True
_NOISE = np.zeros(256, bool)
_NOISE[[ord(c) for c in "#$%&*^~|<>{}[]\\"]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:'\"()-"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def held_out(doc: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(True))


class Lexicon:
    """Word hashes in order with their weights, for lookups of whole arrays."""

    def __init__(self, words: list[str], weights: list[float]):
        hashes = tk.hash_words(words)
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], np.array(weights, dtype=float)[order]
        self.second = np.sort(tk.hash_words(SECOND_PERSON))

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes))
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.weights[place], 0.0)

    def is_second(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.second, hashes), len(self.second) - 1)
        return self.second[place] == hashes


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    n = len(offsets) - 1
    starts, ends, doc = tk.words(data, offsets)
    hashes = tk.word_hashes(data, starts, ends)
    weight = lexicon.weigh(hashes)
    hit = weight > 0
    second = lexicon.is_second(hashes)

    def per_doc(of_word, where=None):
        return np.bincount(doc if where is None else doc[where], of_word if where is None else of_word[where], minlength=n)

    def per_byte(table):
        total = np.concatenate([[0], np.cumsum(table[data])])
        return total[offsets[1:]] - total[offsets[:-1]]

    # Hits with a second-person word at most NEAR words away in the same text.
    reach = np.concatenate([[0], np.cumsum(second)])
    begin = np.searchsorted(doc, np.arange(n))
    stop = np.searchsorted(doc, np.arange(n), "right")
    at = np.flatnonzero(hit)
    low, high = np.maximum(at - NEAR, begin[doc[at]]), np.minimum(at + NEAR + 1, stop[doc[at]])
    near = np.bincount(doc[at], reach[high] > reach[low], minlength=n)
    strongest = np.zeros(n)
    np.maximum.at(strongest, doc[at], weight[at])

    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shouted = ((upper[ends] - upper[starts]) == ends - starts) & (ends - starts > 1)

    # Words with look-alike signs among their letters, read as the letters they stand for.
    soft = _SOFT[data]
    signs = soft & ~_LETTER[data] & (data < 128)
    disguised, disguised_hits = np.zeros(n), np.zeros(n)
    if signs.any():
        first, last = soft.copy(), soft.copy()
        first[1:] &= ~soft[:-1]
        last[:-1] &= ~soft[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] |= soft[cut]
        last[cut - 1] |= soft[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        n_signs = np.concatenate([[0], np.cumsum(signs)])
        k = n_signs[e] - n_signs[s]
        s, e = s[(k > 0) & (k < e - s)], e[(k > 0) & (k < e - s)]
        owner = np.searchsorted(offsets, s, "right") - 1
        plain = lexicon.weigh(tk.SpanHash(tk.BYTE_CODES[_PLAIN[data]])(s, e)) > 0
        disguised, disguised_hits = np.bincount(owner, minlength=n), np.bincount(owner, plain, minlength=n)

    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & _LETTER[data[2:]]
    stretched = np.concatenate([[0], np.cumsum(same)])

    n_words, n_bytes = np.bincount(doc, minlength=n), np.diff(offsets)
    by_word, by_byte = 1 / np.maximum(n_words, 1), 1 / np.maximum(n_bytes, 1)
    letters = 1 / np.maximum(per_byte(_LETTER), 1)
    hits = per_doc(hit)
    table = np.zeros((3, 256), bool)
    table[0, ord("!")] = table[1, ord("?")] = True
    return np.column_stack(
        [
            np.log1p(n_words), hits * by_word, per_doc(weight) * by_word, strongest, np.log1p(hits), near * by_word,
            per_doc(second) * by_word, per_byte(_UPPER) * letters, per_doc(shouted) * by_word, per_byte(table[0]) * by_byte,
            per_byte(table[1]) * by_byte, per_byte(_PUNCTUATION) * by_byte, per_byte(_DIGIT) * by_byte, per_byte(_NOISE) * by_byte,
            disguised * by_word, disguised_hits * by_word, (stretched[offsets[1:]] - stretched[offsets[:-1]]) * by_byte,
        ]
    )


def with_features(rows: DataFrame, text: str, lexicon) -> DataFrame:
    """``rows`` with their text replaced by ``x``, the features as an ML vector; all else is carried along."""
    kept = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in kept) + ", x array<double>"

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch, data, offsets in tk.slices(batches, text):
            x = features(data, offsets, lexicon.value)
            column = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), column], names=[*kept, "x"])

    return rows.select(*kept, text).mapInArrow(scan, schema).withColumn("x", array_to_vector("x"))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, size: int) -> DataFrame:
    """``t, y, part`` of at most ``size`` labelled documents, those with the smallest hashes of their id."""
    known = labels.filter(F.col(label).isNotNull() & ~held_out(doc)).groupBy(F.col(doc).alias("d")).agg(F.max(label).cast("double").alias("y"))
    known = known.withColumn("h", F.xxhash64("d")).orderBy("h", "d").limit(size)
    known = known.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(5)))
    # At most ``size`` small rows, so they may be broadcast.
    found = docs.select(F.col(doc).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(known), "d")
    return cut_lineage(found.select("t", "y", "part"))


def learn_lexicon(rows: DataFrame, size: int) -> Lexicon:
    """Words whose share of toxic documents is far above their share of the others."""
    totals = rows.agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).first()
    bad, good = totals.bad or 0.0, totals.good or 0.0
    words = rows.select("y", F.explode(F.array_distinct(F.split(F.lower("t"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))).alias("w"))
    counts = words.filter("w <> ''").groupBy("w").agg(F.sum("y").alias("b"), F.sum(1 - F.col("y")).alias("g"))
    odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("g") + 0.5) / (good + 1))
    found = counts.filter(F.col("b") >= LEAST_DOCS).select("w", odds.alias("o"), "b").filter(F.col("o") >= LEAST_LOG_ODDS)
    top = found.orderBy(F.desc(F.col("o") * F.sqrt("b")), "w").limit(size).collect()
    return Lexicon([r.w for r in top], [r.o for r in top])


def score(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", size: int = SAMPLE,
    carry: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score``, or with ``carry`` all its own columns and ``score``,
    which must then not be a column of ``docs``."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, doc, text, label, size)
    lexicon = spark.sparkContext.broadcast(learn_lexicon(sample.filter("part < 2"), LEXICON))
    rows = cut_lineage(with_features(sample.filter("part >= 2"), "t", lexicon).select("y", "part", vector_to_array("x").alias("a")))
    rows = rows.withColumn("x", array_to_vector("a"))
    classes = {(r.y, r.fit) for r in rows.groupBy("y", (F.col("part") < 4).alias("fit")).count().collect()}

    if carry:
        own = [F.col(c) for c in docs.columns] + [F.coalesce(F.col(text), F.lit("")).alias("text to score")]
    else:
        own = [F.col(doc).cast("long").alias("doc_id"), held_out(doc).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text to score")]
    every = docs.select(*own)
    outputs = every.columns[:-1]
    if len(classes) < 4:
        share = sample.agg(F.avg("y")).first()[0] or 0.0
        return every.select(*outputs, F.lit(float(share)).alias("score"))
    trees = GBTClassifier(labelCol="y", featuresCol="x", maxIter=20, maxDepth=4, maxBins=32, stepSize=0.2, seed=7)
    trees = trees.fit(rows.filter("part < 4"))
    margin = vector_to_array("probability").getItem(1)
    fitted = trees.transform(rows.filter("part = 4")).withColumn("m", margin)
    curve = IsotonicRegression(labelCol="y", featuresCol="m", predictionCol="score").fit(fitted.select("y", "m"))
    scored = trees.transform(with_features(every, "text to score", lexicon)).withColumn("m", margin)
    return curve.transform(scored).select(*outputs, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def keep_clean(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """The documents that score below ``reject_at``, with their columns."""
    names = docs.columns
    scored = score(docs.toDF(*(f"own {k}" for k in range(len(names)))), labels.withColumnRenamed(doc, f"own {names.index(doc)}"),
                   f"own {names.index(doc)}", f"own {names.index(text)}", carry=True)
    return scored.filter(F.col("score") < reject_at).drop("score").toDF(*names)
