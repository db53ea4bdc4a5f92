"""Periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import brute
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyground.llm import periods, registry

SF_DIR = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words):
    """Every maximal stretch of each period, by comparing all words ``p`` apart."""
    best = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                best.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in best.items())


def plain_collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def scanned(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["d", "t"])
    return [row for out in periods._scan(iter([batch])) for row in out.to_pylist()]


def check(texts):
    for text, row in zip(texts, scanned(texts), strict=True):
        words = words_of(text)
        runs = plain_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == runs
        assert row["collapsed"] == plain_collapsed(words, runs)
        assert row["n_words"] == len(words)


def made_text(rng):
    words = rng.choices(rng.choice([["a"], "ab", "abc", [str(k) for k in range(300)]]), k=rng.randint(0, 250))
    for _ in range(rng.randint(0, 4)):
        unit = rng.choices("abcd", k=rng.randint(1, 40))
        at = rng.randint(0, len(words))
        words[at:at] = (unit * 7)[: rng.randint(2 * len(unit), 7 * len(unit))]
    return rng.choice(["", " ", "\t"]) + rng.choice([" ", " \n", "\x0b"]).join(words) + rng.choice(["", "\r"])


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)
    check([made_text(rng) for _ in range(200)])


def test_edges():
    exact = [" ".join("abcdefgh" * 3), " ".join("abcdefgh" * 3)[:-2], "x " * 24, "x " * 23, "x " * 5000]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    check([None, "", " \x0b\n", "   ", *exact, " ".join(fibonacci[-1]), ("q " * 30 + "r ") * 9, *exact])


def test_candidates_in_small_blocks(monkeypatch):
    monkeypatch.setattr(periods, "AT_ONCE", 3)
    check(["x " * 200, "a b c " * 60 + "d " * 40])


def test_awkward_rows(spark):
    docs = brute.awkward(spark)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.collapse_runs(docs).collect()]
    want = []
    for row in docs.collect():
        words = words_of(row.text)
        runs = plain_runs(words)
        want.append((row.doc_id, len(words), runs, plain_collapsed(words, runs)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periods.collapse_runs(docs.limit(0)).count() == 0


def contract_row(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    s, m, p = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return doc_id, len(runs), s, m, p, m and m * 1000 // p, sha(listed), sha(plain_collapsed(words, runs))


def test_query_equals_the_plain_version(spark):
    rows = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = sorted(contract_row(r["doc_id"], r["text"]) for r in rows)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = registry.op11_periodic_runs(spark, SF_DIR).select(*names)
    assert {kind for _, kind in got.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[1] > 0 for r in want) > 10
