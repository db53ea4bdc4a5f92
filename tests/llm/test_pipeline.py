"""The pipeline's stages against plain versions, each on its own input, and the registered queries on the smallest tables."""

import collections
import os
import sys

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from compare import compare, connect  # noqa: E402
from tallyground.llm import registry, toxicity  # noqa: E402
from tallyground.settings import cut_lineage  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def steps(spark):
    """The input of every stage, and the last result."""
    out = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF_DIR)))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "decontamination", "packing"]


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_toxic_documents_go(spark, steps):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity.score(steps[0], labels).collect()}
    assert {i for i, _ in rows(steps[1])} == {i for i, s in score.items() if s < toxicity.REJECT_AT}


def test_lines_go(steps):
    before = rows(steps[1])
    lost = brute.similar_lines(before)
    want = {}
    for i, text in before:
        gone = set().union(*lost[i, text]) if (i, text) in lost else set()
        want[i] = text if text is None else "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone)
    assert dict(rows(steps[2])) == want
    assert steps[2].filter("n_chars <> char_length(text)").count() == 0


def test_one_of_each_group_stays(steps):
    before = sorted(rows(steps[2]))
    first = {before[c][0] for c in brute.near_classes(before)}
    assert {i for i, _ in rows(steps[3])} == first


def test_contaminated_documents_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before = rows(steps[3])
    found = brute.contamination([t for _, t in before], items)
    assert {i for i, _ in rows(steps[4])} == {i for (i, _), (_, hit, _) in zip(before, found, strict=True) if not hit}


def test_the_rest_is_packed(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length, sequences = collections.Counter(), collections.Counter()
    for r in steps[5].collect():
        length[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert length == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows(steps[4])}
    assert max(sequences.values()) <= 1024


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "piece", "ids_crc32")
    want = steps[5].select("doc_id", "piece", "ids_crc32")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_awkward_rows_pass_through(spark):
    """Nulls, repeated rows and empty texts reach the end; an empty table gives an empty one."""
    docs = brute.awkward(spark).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = cut_lineage(stage(spark, df, SF_DIR))
        assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_with_sql(spark, name):
    assert compare(spark, SF_DIR, registry.QUERIES[name], registry.SQL[name], connect(SF_DIR)) == ""
