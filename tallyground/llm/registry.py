"""The operators of this package as queries over the given tables, and the pipeline."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyground.llm import codes, decontaminate, lines, minhash, neighbours, packing, periods, personal, secrets, sharding, substrings, suffixes, toxicity
from tallyground.llm.frames import table

# Words as the contract cuts them, in DuckDB.
WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
CONTAMINATION = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
            FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) t(i) WHERE len(w) > 0),
    place AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
              FROM d, (SELECT DISTINCT n FROM win) s, unnest(generate_series(1, len(w) - n + 1)) t(i) WHERE len(w) >= n),
    hit AS (SELECT doc_id, i, place.n, item FROM place JOIN win ON place.k = win.k AND place.n = win.n),
    covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit
                FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(generate_series(i, i + n - 1)) t(j) GROUP BY doc_id),
    named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
              FROM hit GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0)


@_query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("found")


@_query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@_query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return left.select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op5_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return placed.select(
        F.col("record.doc_id").alias("doc_id"), "size", F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lost = lines.removed_lines(docs)
    numbers = lambda c: F.concat_ws(",", F.transform(c, lambda n: n.cast("string"))).alias(f"{c}_lines")
    found = lost.select("d", "k", "n_lines", F.size("exact").cast("long").alias("n_exact"), F.size("near").cast("long").alias("n_near"), numbers("exact"), numbers("near"))
    text = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id"), F.lit(lines.LAST)).alias("d"), F.xxhash64(text).alias("k"))
    return every.join(found, ["d", "k"], "left").drop("d", "k").fillna(0, ["n_lines", "n_exact", "n_near"]).fillna("", ["exact_lines", "near_lines"])


@_query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "longest", "longest_at")


SQL["op7_benchmark_decontamination"] = CONTAMINATION


@_query
def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(table(spark, sf_dir, "documents"))
    own = lambda c: F.when(F.col(c) != minhash.LAST, F.col(c))
    first = (F.col("d") == F.col("class_d")) & (F.col("k") == F.col("class_k"))
    rows = found.select(own("d").alias("doc_id"), own("class_d").alias("class_id"), first.alias("is_first"), "copies")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


@_query
def op9_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["a"].cast("string"), s["b"].cast("string")))
    return left.select(
        F.col("record.doc_id").alias("doc_id"), F.size("spans").cast("long").alias("n_removed"), F.concat_ws(",", spans).alias("spans"),
        F.octet_length("kept").cast("long").alias("n_kept_bytes"), F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"),
    )


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.REJECT_AT).cast("int"))


def _repeated(doc: str = "doc_id", text: str = "text") -> Column:
    """The text, in which a tenth of the documents repeat a stretch of their words as the contract says."""
    h = F.crc32(F.col(doc).cast("string"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        new = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.when(n > 0, F.array_join(new, " ")).otherwise(F.col(text))

    # The words are a lambda's argument, so that they are cut once and not again for each word.
    words = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return F.when((h % 10 == 0) & F.col(text).isNotNull(), F.get(F.transform(words, repeat), 0)).otherwise(F.col(text))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse_runs(table(spark, sf_dir, "documents").withColumn("text", _repeated()))
    run = "struct<start:bigint,length:bigint,period:bigint>"
    longer = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast(run), lambda best, r: F.when(longer(best, r), r).otherwise(best))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(listed, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


@_query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_added = (F.size("found") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *map(count, personal.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"), n_added)


@_query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.quantise(table(spark, sf_dir, "embeddings"))
    books = hashlib.sha256(",".join(map(str, found.books.ravel().tolist())).encode()).hexdigest()
    two_digits = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return codes.with_label_error(found.rows).select(
        F.col("key").alias("vec_id"), F.array_join(two_digits, "").alias("code"), "error", "label_error", F.lit(books).alias("codebooks_sha256")
    )


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
