"""Vector codes against plain k-means on integers."""

import hashlib
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyground.llm import codes, registry

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, key string, code int, low double, slots int"


def plain(rows, parts=4, entries=256, rounds=4):
    """``rows`` of (id, integers, label, vector): every distance in every round."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    x = np.array([r[1] for r in rows], dtype=np.int64)
    cut = np.split(x, parts, axis=1)
    books = [c[:entries].copy() for c in cut]

    def assign():
        d = [np.stack([((c - e) ** 2).sum(1) for e in b], axis=1) for c, b in zip(cut, books, strict=True)]
        return [k.argmin(1) for k in d], sum(k.min(1) for k in d)

    for _ in range(rounds):
        code, _ = assign()
        for c, b, k in zip(cut, books, code, strict=True):
            for e in range(len(b)):
                if (k == e).any():
                    b[e] = c[k == e].sum(0) // (k == e).sum()
    code, error = assign()
    by_label = {}
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return [(r[0], "".join(f"{k[i]:02x}" for k in code), int(error[i]), by_label[r[2]], sha) for i, r in enumerate(rows)]


def usable(vector):
    return vector is not None and all(v is not None and math.isfinite(v) for v in vector)


def integers(vector, dims):
    return [math.floor(1024 * v) for v in vector] + [0] * (dims - len(vector))


def test_query_equals_plain_k_means(spark):
    given = pq.read_table(f"{SF_DIR}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], integers(r["embedding"], 64), r["label"], r["embedding"]) for r in given if usable(r["embedding"])]
    got = registry.op13_vector_codes(spark, SF_DIR).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert [k for _, k in got.dtypes] == ["bigint", "string", "bigint", "bigint", "string"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


@pytest.mark.parametrize("seed", range(2))
def test_awkward_rows(spark, seed):
    rng = random.Random(seed)
    vector = lambda n: [rng.choice([rng.uniform(-3, 3), rng.randint(-2, 2) / 2]) for _ in range(n)]
    given = [(rng.choice([None, *range(400)]), vector(rng.choice([6, 6, 6, 5, 0])), rng.choice([None, 1, 2])) for _ in range(700)]
    given += [(k, bad, 1) for k, bad in enumerate([None, [None] * 6, [math.nan] * 6, [math.inf] + [0.0] * 5, [1.0, -math.inf]])]
    given += [given[5]] * 40
    frame = spark.createDataFrame([(*g, "k", 1, 0.5, 2) for g in given], SCHEMA).repartition(5)
    as_float = lambda v: [float(np.float32(c)) for c in v]
    rows = [(i, integers(as_float(v), 8), n, as_float(v)) for i, v, n in given if usable(v)]
    found = codes.quantise(frame, entries=64)
    got = [(r.key, "".join(f"{c:02x}" for c in r.code), r.error, r.label_error) for r in codes.with_label_error(found.rows).collect()]
    assert sorted(got, key=str) == sorted((r[:4] for r in plain(rows, entries=64)), key=str)


def test_salted_labels(spark, monkeypatch):
    frame = spark.createDataFrame([(k, [k] * 4, k % 3 or None, k) for k in range(90)], "key long, code array<int>, label int, error long")
    want = sorted(map(str, codes.with_label_error(frame).collect()))
    monkeypatch.setattr(codes, "FEW_LABELS", 1)
    assert sorted(map(str, codes.with_label_error(frame).collect())) == want


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(1, [0.5, 1.0, -0.25, 3.0], 0), (2, [0.25, 1.0, 0.0, 3.0], None)], "vec_id long, embedding array<double>, label int")
    found = codes.quantise(few)
    assert [(r.code, r.error) for r in found.rows.orderBy("key").collect()] == [([0, 0, 0, 0], 0), ([1, 0, 1, 0], 0)]
    none = codes.quantise(few.limit(0))
    assert none.rows.count() == 0 and codes.with_label_error(none.rows).count() == 0


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-codes.LIMIT, codes.LIMIT, (50, 40))
    books = codes.Books(x[None, :20], np.zeros((1, 20)))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in x[:20]] for r in x]
    assert books.distances(0, x).tolist() == want


def test_bounds_save_distances(spark, monkeypatch):
    """Once entries hardly move, few parts ask for all entries again, and the results stay exact."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 4
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8)) * 0.2) * 1024
    x = np.floor(x).astype(np.int64)
    entry = np.stack(np.split(x[:64], 2, axis=1))
    books = codes.Books(entry, np.zeros((2, 64)))
    state = [codes.measure(books, k, p, 8) for k, p in enumerate(np.split(x, 2, axis=1))]
    asked = []
    for _ in range(6):
        after = entry.copy()
        for k, p in enumerate(np.split(x, 2, axis=1)):
            sums = codes._sum_by(state[k].near[:, 0], p, 64)
            used = sums[:, -1] > 0
            after[k][used] = sums[used, :-1] // sums[used, -1:]
        books = codes.Books(after, np.nextafter(np.sqrt(((after - entry) ** 2).sum(2)), np.inf))
        entry = after
        state = [codes.follow(books, k, p, s) for k, (p, s) in enumerate(zip(np.split(x, 2, axis=1), state, strict=True))]
        for k, p in enumerate(np.split(x, 2, axis=1)):
            assert (state[k].near[:, 0] == books.distances(k, p).argmin(1)).all()
        asked.append(sum(int((s.needed >= 8).sum()) for s in state))
    assert asked[-1] < 600
