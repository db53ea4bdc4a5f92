"""The training-data operators against brute force, round trips and held-out accuracy, awkward rows included."""

import collections
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from tallyground.llm import (  # noqa: E402
    decontaminate, lines, minhash, neighbours, packing, secrets, sharding, substrings, suffixes, tokens, toxicity,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LAST = 1 << 63


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def key(i):
    return LAST if i is None else i


# Nearest neighbours


def vectors(n=900, dim=12, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[200:300] = x[200] * 2  # a hot vector
    x[300:340] = x[300] + rng.normal(size=(40, dim)) * 0.01
    return x


def test_neighbours_recall_and_scores(spark):
    x = vectors()
    rows = [(i, [float(v) for v in x[i]], i) for i in range(len(x))]
    rows += [(5000, None, 0), (5020, [0.0] * 12, 0), (5040, [math.nan] * 12, 0), (5060, [None] + [1.0] * 11, 0), (None, [1.0] * 12, 0)]
    rows += [(5080, [1.0] * 3, 0), rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(4)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, lambda c: c % 20 == 0, list_rows=32).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in range(0, len(x), 20):
        score = (x * x[q]).sum(1)
        want = [int(j) for j in np.lexsort((np.arange(len(x)), -score)) if j != q][:20]
        found = sorted(got[q])
        assert [r for r, *_ in found] == list(range(1, len(found) + 1))
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in found)
        hit += len(set(want) & {v for _, v, _ in found})
        total += len(want)
        if 200 <= q < 300:  # ties go to the smaller ids
            top = [v for _, v, s in found if abs(s - score[q]) < 1e-9]
            assert top == sorted(top)
    assert set(got) == set(range(0, len(x), 20))
    assert hit / total >= 0.9


def test_neighbours_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], schema)
    assert [r["count"] for r in neighbours.nearest(few, lambda c: c % 20 == 0).groupBy("query_id").count().collect()] == [2, 2]
    assert neighbours.nearest(spark.createDataFrame([], schema), lambda c: c % 20 == 0).count() == 0


# Secrets


def credential(rng):
    return "sk-" + "".join(rng.choices("0123456789abcdef", k=12)) + "-" + "".join(rng.choices("GHJKLMNPQR", k=6))


def test_secrets_against_plain_patterns(spark):
    rng = random.Random(1)
    rows = brute.awkward_rows()
    for i in range(60):
        rows.append((1000 + i, f"x {rng.choice(['token', 'API_KEY', 'Secret'])} = \"{credential(rng)}\" y token=token:abcdef", *rows[0][2:]))
    hidden = credential(rng)
    rows.append((2000, f"plain {hidden} here and ordinary-word-number-12 there, AKIA{'A1' * 9}, {'0af3' * 8} ſecret=abcdefgh", *rows[0][2:]))
    got = secrets.find_secrets(spark.createDataFrame(rows, brute.SCHEMA).repartition(3)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        spans = brute.base_spans(text)
        for r in by[i]:
            assert r.base_sha256 == brute.digest(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
    text = rows[-1][1]
    extra = [text[s.start : s.end] for s in by[2000][0].found if s.kind == "format"]
    assert extra == [hidden]


def test_secrets_without_rows(spark):
    assert secrets.find_secrets(empty(spark)).count() == 0


def test_automaton_generalises():
    rng = random.Random(4)
    learned = secrets.Automaton([credential(rng) for _ in range(200)])
    assert len(learned.red) < 60
    good, bad = learned.score([credential(rng), "zz.zz.zz.zz.zz.zz.zz12"])
    assert good > bad + 10


# Packing


TRICKY = [
    "", " ", "a", "a b", "a  b", "  lead", "trail  ", "\n\n\nx", "x\n\n", "tab\t\tx", "it's we'll 'tis I'm they'd 've '' 's's", "12 34ab5c  6",
    "a b   c", "é日本語 mixed123 ١٢", "!!! ??? ...,,, a!b ?c", "<|endoftext|> x", "\r\n \r\n", "a\x1cb\x85c", "🙂🙂 ok", "Ünïcödé 'ſ",
]


def test_token_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    from tallyground.llm import textkit

    reference = Tokenizer.from_file(VOCABULARY)
    reference.encode_special_tokens = True
    rng = random.Random(2)
    alphabet = list("ab Z9'\n\t.é日 s") + [" ", "  ", "'s", " ", "٣"]
    texts = TRICKY + [t or "" for t in brute.awkward_texts()] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(400)]
    import pyarrow as pa

    encoder = tokens.Encoder(VOCABULARY)
    for _ in range(2):  # once with an empty store of pieces, once with a full one
        ids, n = encoder.encode(*textkit.text_bytes(pa.array(texts, pa.string())))
        at = 0
        for text, size in zip(texts, n.tolist(), strict=True):
            assert ids[at : at + size].tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)
            at += size


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_plan_holds_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    histogram = collections.Counter(np.minimum(rng.geometric(0.01, 3000), 256).tolist())
    made = packing.plan(dict(histogram), 256)
    used = collections.Counter()
    for pattern, n in made:
        assert sum(pattern) <= 256 and n > 0
        for length in pattern:
            used[length] += n
    assert used == histogram
    least = -(-sum(a * n for a, n in histogram.items()) // 256)
    assert sum(n for _, n in made) <= 1.02 * least + 2


def test_added_tokens_equal_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tallyground.llm import textkit

    reference = Tokenizer.from_file(VOCABULARY)
    mark, rng = "<|endoftext|>", random.Random(4)
    texts = ["a <|endoftext|> b", mark, mark * 3, "", "x <|endof", "text|> y", f"it's{mark}'s  {mark}\n\n{mark} é", "<" + mark + ">"]
    texts += ["".join(rng.choices([mark, " ", "  ", "a", "'s", "\n", "é", "<|"], k=rng.randint(0, 12))) for _ in range(200)]
    ids, n = tokens.load(VOCABULARY).encode(*textkit.text_bytes(pa.array(texts, pa.string())))
    for text, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert part.tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(VOCABULARY)
    df = brute.awkward(spark)
    got = packing.pack(df, VOCABULARY, capacity=64).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    counts = collections.Counter(i for i, _ in pairs(df))
    for i, text in set(pairs(df)):
        ids = reference.encode(text or "", add_special_tokens=False).ids + [2]
        rows = sorted(by[i], key=lambda r: r.piece)
        rows = rows[:: counts[i]]
        assert [x for r in rows for x in r.ids] == ids
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert all(r.length == 64 for r in rows[1:])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty(spark), VOCABULARY).count() == 0


# Suffix dedup


@pytest.mark.parametrize("heavy", [2000, 1])
def test_suffixes_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(suffixes, "HEAVY", heavy)
    monkeypatch.setattr(suffixes, "SLICE", 4000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 8000)
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 8000)
    df = brute.awkward(spark)
    rng = random.Random(9)
    more = [(100 + i, "".join(rng.choices("ab", k=10)) * rng.randint(1, 12) + "x" * rng.randint(0, 70), "", 0, "", 0.0, 0, "") for i in range(25)]
    df = df.unionByName(spark.createDataFrame(more, brute.SCHEMA))
    want = collections.Counter(brute.repeated_bytes(pairs(df)))
    rows = suffixes.remove_repeats(df).collect()
    assert collections.Counter((r.doc_id, bytes(r.kept), sum(s.b - s.a for s in r.removed)) for r in rows) == want
    for r in rows:
        assert all(a.b < b.a for a, b in zip(r.removed, r.removed[1:], strict=False))
    assert sum(x[2] * n for x, n in want.items()) > 1000


def test_suffixes_without_rows(spark):
    assert suffixes.remove_repeats(empty(spark)).count() == 0


# Sharding


def test_shards_hold_every_row_once(spark, tmp_path):
    df = brute.awkward(spark)
    placed = sharding.shard(df, shards=7, bucket_bytes=2000)
    rows = placed.collect()
    want = collections.Counter(pairs(df))
    assert collections.Counter((r.record.doc_id, r.record.text) for r in rows) == want
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.size == len((r.record.text or "").encode()) + 16
    counts = [len(v) for v in slots.values()]
    assert max(counts) - min(counts) <= 1 and len(slots) == 7
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert [r.record.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))] != sorted((r.record.doc_id for r in rows), key=key)
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("shard = 3").count() == len(slots[3])
    assert sharding.shard(empty(spark)).count() == 0


def test_shards_use_no_python(spark):
    plan = sharding.shard(brute.awkward(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# Lines


def test_lines_against_brute_force(spark):
    df = brute.awkward(spark)
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 400)}" for _ in range(40)]
    more = []
    for i in range(30):
        line = list(base)
        line[rng.randrange(40)] = f"z{i}"
        more.append((200 + i, "Same line here\n" + " ".join(line[: rng.randint(34, 40)]) + "\nsame LINE here", "", 0, "", 0.0, 0, ""))
    df = df.unionByName(spark.createDataFrame(more, brute.SCHEMA))
    want = brute.similar_lines(pairs(df))
    keys = {(r.d, r.k): (r.id, r.t) for r in df.select(F.coalesce("doc_id", F.lit(lines.LAST)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), F.col("doc_id").alias("id"), F.col("text").alias("t")).collect()}
    got = {keys[r.d, r.k]: (set(r.exact), set(r.near)) for r in lines.removed_lines(df).collect()}
    for (i, text), spans in got.items():
        assert spans == want[key(i), text], (i, text)
    assert sum(len(n) for _, n in got.values()) > 5
    kept = lines.remove_lines(df)
    assert kept.columns == df.columns and kept.count() == df.count()
    text = {r.doc_id: r.text for r in kept.filter("doc_id >= 200").collect()}
    assert text[200].startswith("Same line here\n") and "\nsame" not in text[200] and "ame" not in text[201]
    assert lines.remove_lines(empty(spark)).count() == 0


def test_sketches_leave_out_no_similar_lines(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        one = [rng.randrange(1 << 60) for _ in range(rng.choice([1, 5, 9, 30, 80]))]
        other = [t if rng.random() < rng.choice([0.7, 0.9, 0.97]) else rng.randrange(1 << 60) for t in one] + [rng.randrange(1 << 60) for _ in range(rng.randint(0, 3))]
        rows.append((i, one, other))
    df = spark.createDataFrame(rows, "node long, one array<long>, other array<long>")
    a, b = (lines.sketched(df.select("node", F.col(c).alias("set"))).toDF("node", *(f"{c}{k}" for k in range(lines.SKETCH))) for c in ("one", "other"))
    columns = lambda c: [F.col(f"{c}{k}") for k in range(lines.SKETCH)]
    fits = lines.alike_bits(F.size("one"), columns("one"), F.size("other"), columns("other"))
    got = {r.node: r.fits for r in df.join(a, "node").join(b, "node").select("node", fits.alias("fits")).collect()}
    alike = {i: len({*one} & {*other}) >= 0.8 * len({*one} | {*other}) for i, one, other in rows}
    assert all(got[i] for i in alike if alike[i]) and sum(alike.values()) > 40
    assert sum(not got[i] for i in alike if not alike[i]) > 0.7 * sum(not v for v in alike.values())


def test_sketches_tell_lines_apart_that_differ_in_single_words(spark):
    # a changed word is in five shingles, and each of them has to count in the sketch, wherever the word stands in it.
    rng = random.Random(4)
    rows = []
    for i in range(200):
        one = [f"w{rng.randrange(10**6)}" for _ in range(84)]
        other = [f"x{w}" if at in (20, 42, 64) else w for at, w in enumerate(one)]
        rows += [(2 * i, " ".join(one)), (2 * i + 1, "  ".join(other))]
    sets = lines.ordered(spark.createDataFrame(rows, "node long, line string"), [[], [], []], "node")
    both = sets.select("node", F.size("set").alias("size")).join(lines.sketched(sets), "node").withColumn("pair", F.floor(F.col("node") / 2))
    a, b = (both.filter(F.col("node") % 2 == odd).select("pair", *(F.col(c).alias(f"{mark}{c}") for c in ("size", *lines.BITS))) for odd, mark in ((0, "a_"), (1, "b_")))
    columns = lambda mark: [F.col(f"{mark}{c}") for c in lines.BITS]
    fits = lines.alike_bits(F.col("a_size"), columns("a_"), F.col("b_size"), columns("b_"))
    # 15 of 80 shingles differ: similarity 65 / 95.
    got = [(r.a_size, r.b_size, r.fits) for r in a.join(b, "pair").select("a_size", "b_size", fits.alias("fits")).collect()]
    assert {(m, n) for m, n, _ in got} == {(80, 80)} and sum(fits for *_, fits in got) <= 10


def test_shingles_count_alike_by_place_and_as_a_list(spark):
    rng = random.Random(5)
    texts = [(" " * rng.randint(1, 3)).join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (1, 4, 5, 6, 30, 200)]
    # A grade takes the classes of 16 occurrences or more.
    df = spark.createDataFrame([(t,) for t in texts for _ in range(17)], "line string")
    classes = lines.shingled(df.distinct()).select(F.explode_outer("shingles").alias("s")).select(lines.rarity_class(F.col("s")).alias("c")).distinct()
    grades = lines.rarity(df)
    assert set(grades[0]) == {r.c for r in classes.collect()} and not grades[2]


def test_common_shingles_and_few_passes_over_words(spark, monkeypatch):
    # words were cut and hashed anew for the rarity, for the prefixes and for each round of sets; now for the prefixes and once for sets.
    rng = random.Random(12)
    common = [f"c{i}" for i in range(12)]
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for i in range(40):
        line = common + [word() for _ in range(rng.choice([3, 12, 40]))]
        end = line[:-1] + [word()]
        rows.append((i, " ".join(line) + "\n" + " ".join(common) + "\n" + "  ".join(end if i % 2 else line[1:])))
    # A line without a common shingle in its prefix beside one that has some.
    rows += [(100 + i, " ".join((common[:6] if i % 2 else []) + [f"{i // 2}v{j}" for j in range(60)])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    calls, seen = [], []
    hashes, rare_first = lines.word_hashes, lines.with_rare_first
    monkeypatch.setattr(lines, "word_hashes", lambda *a: calls.append(1) or hashes(*a))
    monkeypatch.setattr(lines, "with_rare_first", lambda *a: seen.append(rare_first(*a)) or seen[-1])
    got = {r.d: (set(r.exact), set(r.near)) for r in lines.removed_lines(df).collect()}
    assert len(calls) == 2
    want = brute.similar_lines(rows)
    assert got == {i: want[i, t] for i, t in rows} and sum(len(near) for _, near in got.values()) > 20
    tokens = seen[0].select("token").distinct()
    assert tokens.filter("token < 0").count() and tokens.filter("token >= 0").count()


def test_lines_are_found_and_cut_in_one_pass(spark, monkeypatch):
    # the texts were cut to lines once to name them and a second time for their shingles.
    rows = [(i, "\n" * (i % 3) + f"the same line\n  \nline {i} with words of its own and A few more\nthe SAME line ") for i in range(6)] + [(9, None), (10, " \n"), (9, "the same line")]
    calls, found = [], lines.lines_of
    monkeypatch.setattr(lines, "lines_of", lambda *a: calls.append(1) or found(*a))
    rows += rows[:1]
    got = {(r.d, r.n_lines): (set(r.exact), set(r.near)) for r in lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(calls) == 1
    want = brute.similar_lines(rows)
    assert got == {(i, 3 if i < 9 else 1): want[i, t] for i, t in rows if t and t.strip()}


def test_nodes_that_share_too_few_prefix_shingles_go_and_no_similar_one(spark):
    # a node went on to its whole set as soon as it shared one shingle of its prefix.
    rng = random.Random(21)
    number = lambda: rng.randrange(1 << 57)
    sets = []
    for _ in range(150):
        one = {number() for _ in range(rng.choice([1, 4, 9, 30, 90]))}
        for _ in range(rng.randint(1, 3)):
            kept = {t for t in one if rng.random() < rng.choice([0.8, 0.9, 0.97, 1])}
            sets.append(kept | {number() for _ in range(rng.choice([0, 0, 1, len(one) // 8]))} or {number()})
        sets.append(one)
    # Two by two they share their first shingle only.
    lonely = len(sets)
    for i in range(40):
        sets += [{i} | {number() for _ in range(60)} for _ in range(2)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, set array<long>")
    shared, there = collections.defaultdict(set), {}
    for r in lines.prefix_postings(lines.prefixes(df.unionByName(df.limit(20)))).collect():
        shared[r.node].add(r.token)
        there[r.token] = r.there
    assert lonely > max(shared) and min(there.values()) > 1
    alike = [(i, j) for i in range(lonely) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    first = lambda s: set(sorted(s)[: len(s) - -(-len(s) * 8 // 10) + 1])
    assert len(alike) > 100 and all(first(sets[i]) & first(sets[j]) <= shared[i] & shared[j] != set() for i, j in alike)


# Decontamination


def test_decontamination_against_brute_force(spark):
    df = brute.awkward(spark)
    texts = [t for _, t in pairs(df)]
    some = [brute.words(t) for t in texts if t and len(brute.words(t)) > 40]
    items = [(1, " ".join(some[0][5:30])), (2, " ".join(some[1][:10])), (3, "ONE"), (4, None), (5, ""), (6, "never said before at all"),
             (7, " ".join(some[0][5:30])), (None, " ".join(some[2][3:16])), (10, " ".join(some[3][-12:]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.report(df, benchmark).collect()
    want = collections.Counter((i, n, hit, ",".join(found)) for (i, t), (n, hit, found) in zip(pairs(df), brute.contamination(texts, items), strict=True))
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in rows) == want
    assert all(r.items_sha256 == brute.digest(",".join(r["items"])) and r.contaminated == (r.n_hit > 0) for r in rows)
    assert all((r.longest >= 10 or r["items"] == ["3"]) == r.contaminated or r.longest == 1 for r in rows)
    clean = decontaminate.decontaminate(df, benchmark)
    assert clean.columns == df.columns and clean.count() == sum(r.n_hit == 0 for r in rows)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(df, none).count() == df.count()
    assert decontaminate.report(empty(spark), benchmark).count() == 0


# Near-duplicates


def test_minhash_against_brute_force(spark):
    df = brute.awkward(spark)
    rng = random.Random(8)
    base = [f"v{rng.randint(0, 900)}" for _ in range(150)]
    more = []
    for i in range(25):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(150)] = f"y{i}"
        more.append((300 + i, " ".join(text), "", 0, "", 0.0, 0, ""))
    df = df.unionByName(spark.createDataFrame(more, brute.SCHEMA))
    rows = sorted(pairs(df), key=lambda r: key(r[0]))
    want = [rows[c][0] for c in brute.near_classes(rows)]
    got = {}
    for r in minhash.classes(df).collect():
        got.setdefault(None if r.d == minhash.LAST else r.d, set()).add(r.class_d)
    for (i, _), first in zip(rows, want, strict=True):
        assert got[i] == {key(first) if first is not None else minhash.LAST}, i
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted(set(want), key=key)
    assert minhash.keep_first(empty(spark)).count() == 0


def test_minhash_joins_families_by_single_links(spark):
    # Families of 150 near copies; the first document of each is similar to the first of the next, and no other pair is.
    base, rows = [f"w{i}" for i in range(400)], []
    for f in range(4):
        for i in range(150):
            text = list(base)
            for spot in (10 + 5 * (i % 25), 140 + 5 * (i * 7 % 25)) if i else ():
                text[spot] = f"own{f}x{i}"
            rows.append((f * 1000 + i, " ".join(text)))
        for k in range(7):
            base[390 - 6 * (7 * f + k)] = f"next{f}x{k}"
    classes = brute.near_classes([r for r in rows if r[0] % 1000 < 12])
    assert set(classes) == {0}
    sets = {i: brute.shingles(t) for i, t in rows if i % 1000 < 12}
    alike = lambda i, j: (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total()
    assert [(i, j) for i in sets for j in sets if i // 1000 < j // 1000 and alike(i, j)] == [(0, 1000), (1000, 2000), (2000, 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.class_d for r in minhash.classes(df).collect()} == {0}


def test_join_on_rare_shingles_leaves_out_unlike_texts(spark):
    # All texts share 60 of about 100 words, so their rare shingles meet, yet few pairs are similar.
    rng = random.Random(4)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(60):
        text = base[:60] + [f"own{i}x{k}" for k in range(30 if i % 10 else 8)]
        rows.append((i, i, " ".join(text)))
        if i % 10 == 0:
            text[rng.randrange(60)] = "changed"
            rows.append((1000 + i, 1000 + i, " ".join(text)))
    sets = {i: brute.shingles(t) for i, _, t in rows}
    share = lambda i, j: (sets[i] & sets[j]).total() / (sets[i] | sets[j]).total()
    want = {frozenset((i, j)) for i in sets for j in sets if i < j and share(i, j) >= 0.8}
    df = spark.createDataFrame(rows, "node long, root long, t string")
    got = {frozenset((r.u, r.v)) for r in minhash.across(df, minhash.SHINGLE, 0.8).collect()}
    assert want and want <= got and len(got) <= 2 * len(want)


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    element = np.arange(300, dtype=np.uint64) * np.uint64(7919)
    a, b = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    doc = np.repeat([0, 1], 300)
    sign = minhash.signatures(doc, np.concatenate([element, element]), np.concatenate([a, b]), 3, 2000)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sign[0] == sign[1]).mean() - truth) < 0.05
    assert (sign[:2] != 0).all() and (sign[2] == 0).all()


# Units


def test_units_against_brute_force(spark):
    df = brute.awkward(spark)
    for unit in ("line", "sentence", "paragraph"):
        seen, want = {}, {}
        rows = sorted(set(pairs(df)), key=lambda r: key(r[0]))
        for i, text in rows:
            raw = (text or "").encode()
            cuts = [0]
            for p in range(len(raw)):
                ends = raw[p : p + 1] == b"\n" if unit != "paragraph" else p > 0 and raw[p - 1 : p + 1] == b"\n\n"
                ends = ends or (unit == "sentence" and raw[p : p + 1] in (b".", b"!", b"?") and raw[p + 1 : p + 2] == b" ")
                if ends and p + 1 < len(raw):
                    cuts.append(p + 1)
            spans = []
            for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True):
                w = tuple(brute.words(raw[a:b].decode()))
                if len(w) >= 5 and seen.setdefault(w, (i, a)) != (i, a):
                    spans.append((a, b))
            want[i, text] = spans
        for r in substrings.remove_repeats(df, unit=unit).collect():
            spans = want[r.record.doc_id, r.record.text]
            assert [(s.a, s.b) for s in r.spans] == spans, (unit, r.record.doc_id)
            raw, at, left = (r.record.text or "").encode(), 0, b""
            for a, b in spans:
                left, at = left + raw[at:a], b
            assert r.kept.encode() == left + raw[at:]
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_clauses_of_a_passage_inside_other_prose(spark):
    passage = "the first clause of it has words, the second clause of it follows; yes, of course, and the third one ends it here"
    rows = [(1, f"Before. {passage}."), (2, f"A host that begins so, {passage}, and a host that goes on. Yes, of course, new words stand here too."), (3, f"Before. {passage}.")]
    left = {r.record.doc_id: r.kept for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left[1] == rows[0][1]
    assert left[2] == "A host that begins so, and a host that goes on. Yes, of course, new words stand here too."
    assert left[3] == ""


def plain_clauses(rows, least=5):
    """The registered mode, unit by unit: per row the spans of bytes that go."""
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    def units_of(raw):
        words = [(m.start(), m[0].lower() if m[0].isascii() else re.sub(rb"[A-Z]", lambda x: x[0].lower(), m[0])) for m in word.finditer(raw)]

        def cut(marks):
            begin = sorted({0} | {m.end() for m in re.finditer(rb"\n", raw)} | {m.start() + 1 for m in re.finditer(rb"[" + marks + rb"](?= )", raw)})
            begin = [x for x in begin if x < len(raw)]
            for a, b in zip(begin, [*begin[1:], len(raw)]):
                inside = [k for k, (at, _) in enumerate(words) if a <= at < b]
                if inside:
                    yield a, b, inside[0], inside[-1] + 1

        text = lambda lo, hi: tuple(w for _, w in words[lo:hi])
        sentences = list(cut(rb".!?"))
        out = [(a, True, a, b, text(lo, hi)) for a, b, lo, hi in sentences if hi - lo >= least]
        clauses = list(cut(rb".!?,;:"))
        long = [hi - lo >= least for *_, lo, hi in clauses]
        for k, (a, b, lo, hi) in enumerate(clauses):
            start, _, first, last = next(x for x in sentences if x[2] <= lo and hi <= x[3])
            whole = (first, last) == (lo, hi)
            if long[k]:
                if not whole:
                    out.append((start, False, a, b, text(lo, hi)))
                continue
            before = next((j for j in range(k - 1, -1, -1) if long[j]), None)
            after = next((j for j in range(k + 1, len(clauses)) if long[j]), None)
            if before is not None:
                _, _, x, y = clauses[before]
                out.append((start, whole, a, b, ("before", text(x, y), text(y, hi))))
            if after is not None:
                _, _, x, y = clauses[after]
                out.append((start, whole, a, b, ("after", text(x, y), text(lo, x))))
        return out

    found = [(key(i), t, u) for i, t in rows for u in units_of((t or "").encode())]
    first = {}
    for d, _, (_, _, a, _, name) in found:
        first[name] = min(first.get(name, (LAST + 1, 0)), (d, a))
    gone = collections.defaultdict(lambda: collections.defaultdict(set))
    for d, t, (start, whole, a, b, name) in found:
        if (d, a) != first[name]:
            gone[d, t][start].add((whole, a, b))
    spans = {}
    for place, by_sentence in gone.items():
        every = []
        for units in by_sentence.values():
            whole = [u for u in units if u[0]]
            every += [max(whole)[1:]] if whole else [u[1:] for u in units]
        spans[place] = sorted(set(every))
    return [spans.get((key(i), t), []) for i, t in rows]


@pytest.mark.parametrize("seed", [3, 4])
def test_clauses_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    clause = lambda: " ".join(rng.choices(["one", "two", "Three", "four", "é5", "six"], k=rng.choice([1, 2, 3, 5, 6, 7])))
    stock = [clause() for _ in range(14)]
    made = ["".join(rng.choice(stock) + rng.choice([", ", "; ", ". ", "! ", ".\n", ",", ": "]) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    df = brute.awkward(spark, seed).unionByName(spark.createDataFrame([(500 + i, t, "", 0, "", 0.0, 0, "") for i, t in enumerate(made)], brute.SCHEMA))
    rows = pairs(df)
    want = {(i, t): spans for (i, t), spans in zip(rows, plain_clauses(rows), strict=True)}
    got = substrings.remove_repeats(df).collect()
    assert len(got) == len(rows)
    for r in got:
        spans, raw, at, left = want[r.record.doc_id, r.record.text], (r.record.text or "").encode(), 0, b""
        assert [(s.a, s.b) for s in r.spans] == spans, r.record.doc_id
        for a, b in spans:
            left, at = left + raw[at:a], b
        assert r.kept.encode() == left + raw[at:]
    assert sum(len(s) for s in want.values()) > 200


def test_units_are_sent_once_and_a_common_one_once_a_task(spark):
    # The plan scanned the texts twice and sent every unit of each as a row of its own.
    common, rows = "this line stands in each of the documents", [(i, f"line {i} of this document is its own\nthis line stands in each of the documents") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.remove_repeats(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    left = {r.record.doc_id: (len(r.spans), r.kept) for r in got.collect()}
    assert left[0] == (0, rows[0][1]) and all(left[i] == (1, rows[i][1].removesuffix(common)) for i in range(1, 400))
    sent = substrings.sent_units(substrings.keyed(df, "doc_id", "text"), "text", "line", 5, 3).filter("range < 3")
    assert 401 <= sent.agg(F.sum(F.length("x") / 8)).first()[0] <= 404


# Toxicity


def labelled(spark, n=900):
    rng = random.Random(12)
    plain, bad = [f"word{i}" for i in range(300)], ["vile", "rotten", "nasty"]
    rows, marks = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        text = rng.choices(plain, k=rng.randint(20, 60))
        for _ in range(rng.randint(2, 4) if toxic else 0):
            text[rng.randrange(len(text))] = "you " + rng.choice(bad)
        rows.append((i, " ".join(text), "", 0, "", 0.0, 0, ""))
        marks.append((i, 1, int(toxic)))
    marks += [(3, 1, None), (None, 1, 1), marks[5]]
    return spark.createDataFrame(rows, brute.SCHEMA).unionByName(brute.awkward(spark).withColumn("doc_id", F.col("doc_id") + 10_000)), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), marks


def test_toxicity_held_out_accuracy(spark):
    docs, labels, marks = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert toxicity.score(docs, labels).count() == docs.count()
    assert all(0 <= r.score <= 1 for r in got.values())
    right = [(got[i].score >= toxicity.REJECT_AT) == bool(t) for i, _, t in marks if i is not None and t is not None and got[i].held_out]
    assert len(right) > 200 and np.mean(right) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_toxicity_without_labels(spark):
    docs = brute.awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.keep_clean(docs, none).count() == docs.count()
    assert toxicity.score(empty(spark), none).count() == 0
