"""Personal data: fixed patterns against their plain form, the field against enumeration and on held-out regions."""

import collections
import hashlib
import itertools
import random
import re
import time

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyground.llm import personal, registry

SF_DIR = "/root/testdata/sf0.01"
# The contract's patterns as they stand there.
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def right(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d * 2 if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in p.finditer(text or "") if right(kind, m[0])]


def named(spans):
    return [(personal.KINDS[k], s, e) for k, s, e in spans]


@pytest.mark.parametrize("seed", range(3))
def test_base_equals_the_plain_patterns(seed):
    rng = random.Random(seed)
    pieces = ["a", "b.c", "@", "x@y.de", ".", "-", "+", "+4", "1", "23", "255", "256", "007", "4111111111111111", " ", "  ", "(", ")", "é", "\n", "_", "%", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 25)))
        assert named(personal.base_matches(text)) == plain(text), text


def test_long_texts_take_linear_time():
    n = 300_000
    begun = time.time()
    for text in ["1" * n, "a" * n + "@", "a" * n + " x@y.z", "+1" + " " * n, "1." * n, "1 " * n, "@a" * n, "0" * n + ".1.2.3", "a1" * (n // 4)]:
        personal.base_matches(text)
        personal.regions(text)
    assert time.time() - begun < 20


def test_every_chain(seed=4):
    """The decoded labelling is the best of all, by enumeration."""
    rng = np.random.default_rng(seed)
    texts = ["4111111111111111 +49 30 1234567", "mail a@b.de or +1 (017) 555-7713 190.137.22.3", "1.2.3.4 5.6.7.8", "12 345 678 90 12 34"]
    width = personal.features(personal.Atoms(["1"]), *(np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool), np.zeros(0, int), np.zeros(0, int))).shape[1]
    for _ in range(5):
        field = personal.Field(rng.normal(size=(4, width)), rng.normal(size=(4, 4)) * 2)
        for text in texts:
            atoms = personal.Atoms([text])
            a, b, mail, longest, shortest = personal.candidates(atoms)
            s = personal.features(atoms, a, b, mail, longest, shortest) @ field.weight.T
            items = [(int(a[k]), int(b[k]), t, float(s[k, t])) for k in range(len(a)) for t in ([0] if mail[k] else [1, 2, 3])]

            def chains(at, last, items=items, field=field):
                best = (0.0, ())
                for i, j, t, v in items:
                    if i >= at:
                        rest = chains(j, t)
                        total = v + (field.follow[last, t] if i == at and last is not None else 0) + rest[0]
                        best = max(best, (total, ((i, j, t), *rest[1])), key=lambda x: x[0])
                return best

            # Chains of a long region are many: only its best items go into both sides.
            items.sort(key=lambda x: -x[3])
            del items[14:]
            items.sort(key=lambda x: x[1])
            got = field._best(items)
            value = sum(v for *_, v in got) + sum(field.follow[x[2], y[2]] for x, y in itertools.pairwise(got) if x[1] == y[0])
            assert value == pytest.approx(chains(0, None)[0])


@pytest.fixture(scope="module")
def texts():
    return pq.read_table(f"{SF_DIR}/documents.parquet", columns=["text"])["text"].to_pylist()


def test_held_out_regions(texts):
    every = list(dict.fromkeys(t[s:e] for t in texts for s, e in personal.regions(t)))
    every = [r for r in every if not personal.doubtful(r)]
    field = personal.train([v for k, r in enumerate(every) if k % 3 for v in personal.variants(r)])
    held = [v for r in every[::3] for v in personal.variants(r)]
    count = collections.Counter()
    for (_, gold), got in zip(held, field.decode([t for t, _ in held]), strict=True):
        got = {(k, s, e) for k, s, e, score in got if score >= personal.MARGIN}
        count["found"] += len(got & set(gold))
        count["missed"] += len(set(gold) - got)
        count["false"] += len(got - set(gold))
    assert count["found"] > 100
    assert count["missed"] <= 0.05 * count["found"] and count["false"] <= 0.01 * count["found"]


def test_swallowed_spans_are_added(spark):
    card, other = "4111111111111111", "5500005555555559"
    rows = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    told = [(-1, f"Ein Wort {card} {other} am Ende."), (-2, f"{card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]} hier"), (-3, "schreib an max.muster [at] mail3.example.com heute")]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows] + told, "doc_id long, text string").repartition(4)
    found = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.found] for r in personal.find_personal(docs).collect()}
    assert found[-1] == [("card", 9, 25, False), ("card", 26, 42, False)]
    assert found[-2] == [("card", 0, 19, False)]
    assert found[-3] == [("email", 11, 44, False)]
    base = {r["doc_id"]: plain(r["text"]) for r in rows}
    assert all([s[:3] for s in found[k] if s[3]] == v for k, v in base.items())
    assert sum(not s[3] for k in base for s in found[k]) <= 5


def test_awkward_rows(spark):
    docs = brute.awkward(spark)
    got = sorted((str(r.doc_id), [tuple(s)[:3] for s in r.found]) for r in personal.find_personal(docs).collect())
    assert got == sorted((str(r.doc_id), plain(r.text)) for r in docs.collect())
    assert personal.find_personal(docs.limit(0)).count() == 0


def test_query(spark):
    rows = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {}
    for r in rows:
        spans = plain(r["text"])
        n = collections.Counter(k for k, *_ in spans)
        want[r["doc_id"]] = (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest())
    got = registry.op12_personal_data(spark, SF_DIR)
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert {r[0]: tuple(r[1:6]) for r in got.collect()} == want
