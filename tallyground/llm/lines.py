"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its word shingles (five words; a shorter line is one shingle), lower-cased and cut at blanks. A line
is removed if an earlier line, by (document, number), has the same words or a Jaccard similarity of 0.8 or more with it;
lines are judged on the input, not on what is left. Blank lines stay.

1. Lines of equal text are one node, named by a 64-bit hash; its first occurrence can stay, later ones go.
2. Prefix filter: similar lines share one of the first ``size - ceil(0.8 size) + 1`` shingles in any order of all shingles. By
   the order of their hashes, these are cut in the pass that finds the lines, then dealt by shingle, and only shingles of several
   nodes go on, without the nodes that share too few of them with all others together. The whole sets of the rest are cut
   once and kept.
3. Common shingles are ordered by rarity: their counts over the kept sets stand in ``RARITY_CLASSES`` hash classes, which
   bounds the table. Nodes with a common shingle in their prefix get a second prefix, by the grade of a shingle's class, then its
   hash. Two of them share a shingle there if they are similar; a pair with at most one of them shares one of the first prefix that
   is not common. So the common ones of the first prefix are left out.
4. Each line is compared with the first line of each of its shingles and ``LEADERS - 1`` more that are earlier, after a length and a
   positional filter; what has no match there is compared with all earlier lines that share a prefix shingle. So a group of
   near copies costs some rows per member, not per pair, and no match is lost.
5. Nodes with a shared prefix shingle are cut once more, to a sketch of their whole sets: ``64 * SKETCH`` bits, of which
   every shingle turns over one. Two sets differ in at least as many shingles as their sketches differ in bits, so a pair whose
   sketches differ too much is left out within the joins of step 4, and no similar one is. What stays counts the prefix shingles
   that it shares; with all that may lie beyond the prefixes they must reach the overlap of a similar pair.
6. Pairs are verified on whole sets.

Cases: a null text has no lines; a null id comes after all others; rows of equal id rank by a hash of their text, and
rows that are equal in both get the same result; an empty table gives an empty result; further columns are carried
along by ``remove_lines``, whatever their names, and ignored by ``removed_lines``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyground.settings import cut_lineage

SHINGLE = 5
# The least similarity as tenths, so that all bounds are exact integers.
TENTHS = 8
RARITY_CLASSES = 1 << 16
# The bits of a shingle's hash from this one on depend on each of its words.
MIXED = 28
# A grade of commonness holds the classes with so many times the mean count.
GRADES = (8, 64, 512)
UNGRADED: list[list[int]] = [[] for _ in GRADES]
# A line is heavy if it makes more than one in so many of all lines.
HEAVY = 4096
# Lines of a shingle that its other lines are compared with first.
LEADERS = 4
# Words of 64 bits in the sketch of a set, a power of two.
SKETCH = 4
BITS = [f"bits{k}" for k in range(SKETCH)]
LAST = (1 << 63) - 1


def keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(t).alias("k"), t.alias("t"))


def lines_of(texts: DataFrame) -> DataFrame:
    """``d, k, n_lines, nth, line, node`` of every line with words; ``n_lines`` counts those of the text."""
    cut = texts.select("d", "k", F.split("t", "\n").alias("raw"))
    cut = cut.withColumn("n_lines", F.size(F.array_remove(F.transform("raw", lambda line: F.trim(line)), "")))
    # The outer function: for the other one Spark infers a filter on the size, which cuts each text a second time.
    return named(cut.select("d", "k", "n_lines", F.posexplode_outer("raw").alias("nth", "raw")))


def named(raw: DataFrame) -> DataFrame:
    """``line`` and ``node`` instead of ``raw``, of the lines with words."""
    # Filtered before it is lower-cased, so that Spark does not lower-case each line once more in the filter.
    lines = raw.filter(F.trim("raw") != "").withColumn("line", F.lower(F.trim("raw"))).drop("raw")
    return lines.withColumn("node", F.xxhash64("line"))


def word_hashes(lines: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``words``, a hash of each word of the lines."""
    cut = F.split("line", " ")
    # The line is trimmed, so only blanks side by side leave empty words.
    words = F.when(F.contains("line", F.lit("  ")), F.array_remove(cut, "")).otherwise(cut)
    return lines.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("words"))


def last_shingle() -> Column:
    """The place of the last shingle of ``words``, from 0."""
    return F.greatest(F.size("words") - SHINGLE, F.lit(0))


def shingle_at(at: Column) -> Column:
    """The shingle of ``words`` at a place. Its hash joins those of its words, each shifted by its place: two and two
    words, then the fifth. Only the bits from ``MIXED`` on depend on all five words."""
    word = lambda k: F.get("words", at + k if k else at)
    two = lambda k: F.shiftleft(word(k), 7).bitwiseXOR(word(k + 1))
    five = F.shiftleft(F.shiftleft(two(0), 14).bitwiseXOR(two(2)), 7).bitwiseXOR(word(4))
    # Declared free of nulls, so that Spark sorts plain numbers.
    return F.coalesce(five, F.lit(0))


def shingled(lines: DataFrame, *keep: str, key: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """``keep`` and ``shingles``, the hashes of each line's shingles, never empty: those of ``shingle_at``, each as its ``key``. Joined
    in two loops over lists, as Spark does not compile loops and the cost is in the number of operations in them.

    Explode these with the outer functions: for the others Spark infers a filter on the size, and pushing it down puts the
    whole word list into the loop over its shingles, which makes a long line cost the square of its length.
    """
    twos = F.transform("words", lambda word, at: F.shiftleft(word, 7).bitwiseXOR(F.get("words", at + 1)))
    four = lambda two, at: F.shiftleft(two, 14).bitwiseXOR(F.get("twos", at + 2))
    # Declared free of nulls, so that Spark sorts plain numbers. Places after the last shingle are cut off.
    five = lambda two, at: key(F.coalesce(F.shiftleft(four(two, at), 7).bitwiseXOR(F.get("words", at + 4)), F.lit(0)))
    fives = F.slice(F.transform("twos", five), F.lit(1), last_shingle() + 1)
    every = F.when(F.size("words") <= SHINGLE, F.array(key(F.xxhash64("words")))).otherwise(fives)
    return word_hashes(lines, *keep).select(*keep, "words", twos.alias("twos")).select(*keep, every.alias("shingles"))


def rarity_class(shingle: Column) -> Column:
    return F.shiftright(shingle, MIXED).bitwiseAND(RARITY_CLASSES - 1).cast("int")


def classes_of(lines: DataFrame) -> DataFrame:
    """``c``: the class of every shingle of the lines, or of the ``set`` of keys that they have already."""
    if "set" in lines.columns:
        return lines.select(F.explode_outer("set").alias("key")).select(rarity_class(hash_bits(F.col("key"))).alias("c"))
    # A row per place: the hashes are made in compiled code, not in a loop over an array.
    places = word_hashes(lines).select("words", F.explode_outer(F.sequence(F.lit(0), last_shingle())).alias("at"))
    shingle = F.when(F.size("words") <= SHINGLE, F.xxhash64("words")).otherwise(shingle_at(F.col("at")))
    return places.select(rarity_class(shingle).alias("c"))


def rarity(lines: DataFrame) -> list[list[int]]:
    """Per grade the hash classes whose shingles occur often. A grade holds at most ``RARITY_CLASSES / factor`` classes."""
    counts = cut_lineage(classes_of(lines).groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / RARITY_CLASSES
    often = counts.filter(F.col("n") > max(2.0, mean) * GRADES[0]).collect()
    return [[r.c for r in often if r.n > max(2.0, mean) * factor] for factor in GRADES]


def shingle_key(s: Column, grades: list[list[int]]) -> Column:
    # Each grade's classes are among those of the one before, so most shingles are looked up once.
    grade = F.lit(0)
    for classes in reversed(grades):
        if classes:
            grade = F.when(rarity_class(s).isin(classes), grade + 1).otherwise(0)
    plain = F.shiftrightunsigned(s, 7)
    return F.shiftleft(grade.cast("long"), 57).bitwiseOR(plain) if grades[0] else plain


def hash_bits(key: Column) -> Column:
    """The bits of a shingle's hash that its key without a grade has kept."""
    return F.shiftleft(key, 7)


def ordered(lines: DataFrame, grades: list[list[int]], *keep: str) -> DataFrame:
    """``keep`` and ``set``: the distinct shingle keys, rarest first."""
    if grades[0]:
        # A loop of its own over the hashes: inside the other one each use of ``s`` would hash the shingle again.
        keys = shingled(lines, *keep).select(*keep, F.transform("shingles", lambda s: shingle_key(s, grades)).alias("shingles"))
    else:
        keys = shingled(lines, *keep, key=lambda s: shingle_key(s, grades))
    return keys.select(*keep, F.sort_array(F.array_distinct("shingles")).alias("set"))


def tenths_up(n: Column) -> Column:
    """The least overlap share of ``n``, rounded up."""
    return F.floor((n * TENTHS + 9) / 10).cast("int")


def may_match(size: Column, at: Column, other: Column, other_at: Column) -> Column:
    """Length and positional filter for two sets with a common shingle at the given places (from 0)."""
    most = F.least(at, other_at) + 1 + F.least(size - at, other - other_at) - 1
    # Overlap o of a similar pair: o / (size + other - o) >= TENTHS / 10.
    return long_enough(size, other) & (most * (10 + TENTHS) >= (size + other) * TENTHS)


def sketched(sets: DataFrame) -> DataFrame:
    """``node`` and the words of the sketch of its set, for every row."""
    # A row per shingle, counted in compiled code. A node that stands there twice must not cancel itself out.
    each = sets.withColumn("row", F.monotonically_increasing_id()).select("node", "row", F.explode_outer("set").alias("t"))
    # A key has lost the lowest 7 bits of the hash. Lower bits of it would be the same for shingles that differ in an
    # early word only, which would then cancel each other.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("t", MIXED - 7).bitwiseAND(63).cast("int"))
    each = each.select("node", "row", bit.alias("bit"), F.shiftright("t", MIXED - 1).bitwiseAND(SKETCH - 1).alias("part"))
    words = [F.bit_xor(F.when(F.col("part") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(name) for k, name in enumerate(BITS)]
    return each.groupBy("node", "row").agg(*words).drop("row")


def alike_bits(size: Column, bits: list[Column], other: Column, other_bits: list[Column]) -> Column:
    """Whether sets with such sketches can be similar: ``apart`` shingles in one of them only leave ``size + other - apart`` for
    twice the overlap, which ``reaches`` compares."""
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(bits, other_bits, strict=True)), F.lit(0))
    return (size + other - apart) * (10 + TENTHS) >= (size + other) * (2 * TENTHS)


def both_sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``u, v`` with the named columns of both nodes, as ``a_`` and ``b_``."""
    for end, mark in (("u", "a"), ("v", "b")):
        pairs = pairs.join(table.select(F.col("node").alias(end), *(F.col(c).alias(f"{mark}_{c}") for c in columns)), end)
    return pairs


def reaches(both: Column, size: Column, other: Column) -> Column:
    """Whether an overlap of ``both`` makes two sets similar: ``both / (size + other - both) >= TENTHS / 10``."""
    return both * (10 + TENTHS) >= (size + other) * TENTHS


def most_beyond(size: Column, other: Column) -> Column:
    """The most shingles that two sets share besides those in both prefixes: what the larger one has after its prefix."""
    return tenths_up(F.greatest(size, other)) - 1


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose shared prefix shingles, and all that may lie beyond the prefixes, reach the similarity."""
    size, other = F.col("a_size"), F.col("b_size")
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    most = F.least(shared + most_beyond(size, other), size, other)
    return both_sides(pairs, nodes, "size", "tokens").filter(reaches(most, size, other)).select("u", "v")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``node``: the later nodes ``u`` of the pairs ``u, v`` whose sets reach the similarity."""
    both = F.size(F.array_intersect("a_set", "b_set"))
    found = both_sides(pairs, sets, "set").filter(reaches(both, F.size("a_set"), F.size("b_set")))
    return found.select(F.col("u").alias("node")).distinct()


def whole_sets(texts: DataFrame, firsts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, set`` of the wanted nodes, cut anew from the document of their first occurrence; as often as the table has it."""
    asked = firsts.join(wanted, "node").groupBy(F.col("first.d").alias("d"), F.col("first.k").alias("k")).agg(F.collect_set("first.nth").alias("nths"))
    lines = texts.join(asked, ["d", "k"]).select("nths", F.posexplode_outer(F.split("t", "\n")).alias("nth", "raw"))
    return ordered(named(lines.filter(F.array_contains("nths", F.col("nth"))).select("raw")), UNGRADED, "node")


def prefixes(sets: DataFrame) -> DataFrame:
    """The columns of ``sets`` with ``size`` and ``prefix`` instead of ``set``."""
    sized = sets.withColumn("size", F.size("set"))
    return sized.withColumn("prefix", F.slice("set", F.lit(1), F.col("size") - tenths_up(F.col("size")) + 1)).drop("set")


def cut_lines(texts: DataFrame) -> DataFrame:
    """``d, k, n_lines, nth, node, size, prefix`` of every line with words: its prefix by the order of the shingles' hashes."""
    return prefixes(ordered(lines_of(texts), UNGRADED, "d", "k", "n_lines", "nth", "node"))


def long_enough(size: Column, other: Column) -> Column:
    """Whether sets of such sizes can be similar."""
    return F.least(size, other) * 10 >= F.greatest(size, other) * TENTHS


def prefix_postings(cut: DataFrame) -> DataFrame:
    """``token, node, size, at, there``: prefix shingles that several nodes have, and how many, without those of nodes that cannot be
    similar to another one there."""
    postings = cut.select("node", "size", F.posexplode_outer("prefix").alias("at", "token"))
    mine = Window.partitionBy("token")
    # Most shingles are those of a single node, and go before the others are grouped; these stay where they are for that.
    several = postings.withColumns({"least": F.min("node").over(mine), "most": F.max("node").over(mine)}).filter("least <> most")
    return possible(several.groupBy("token", "node").agg(F.min("size").alias("size"), F.min("at").alias("at")))


def possible(shared: DataFrame) -> DataFrame:
    """The rows of ``token, node, size, at`` whose node may be similar to another one of the token, with ``there``, the nodes of the token."""
    # Of two similar sets, the one whose prefix ends first shares no more than this: the others have all that it shares in its prefix.
    most = tenths_up(F.col("size")) - 1 + F.count(F.lit(1)).over(Window.partitionBy("node")).cast("int")
    # The largest set to which that much makes it similar, by ``reaches``. One of the two has to be within the bound of the other.
    bound = F.floor((most * (10 + TENTHS) - F.col("size") * TENTHS) / TENTHS).cast("long")
    mine = Window.partitionBy("token")
    judged = shared.withColumn("bound", bound).withColumns({
        "there": F.count(F.lit(1)).over(mine), "least": F.min("size").over(mine), "sizes": F.sum("size").over(mine),
        "far": F.max("bound").over(mine), "bounds": F.sum("bound").over(mine),
    })
    size, other = F.col("size"), F.col("sizes") - F.col("size")
    pair = long_enough(size, other) & ((other <= F.col("bound")) | (size <= F.col("bounds") - F.col("bound")))
    group = (F.col("least") <= F.col("bound")) | (size <= F.col("far"))
    return judged.filter(F.when(F.col("there") == 2, pair).otherwise(group)).select("token", "node", "size", "at", "there")


def postings_of(cut: DataFrame, firsts: DataFrame) -> DataFrame:
    """The prefix postings of all lines."""
    # A line with more than this share of all occurrences goes on from its first one only; there are at most HEAVY such lines.
    total = firsts.agg(F.sum("n")).first()[0] or 0
    heavy = cut_lineage(firsts.filter(F.col("n") > max(1, total // HEAVY)).select("node", F.col("first").alias("only")))
    return prefix_postings(cut.join(F.broadcast(heavy), "node", "left").filter(F.col("only").isNull() | (F.col("only") == F.struct("d", "k", "nth"))))


def with_rare_first(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """``postings`` without common shingles, and those of a second prefix, rarest first, of the nodes that had one. The shingles of
    the second prefix are negative numbers, so that they only meet each other."""
    grades = rarity(sets)
    if not grades[0]:
        return postings
    common = rarity_class(hash_bits(F.col("token"))).isin(grades[0])
    crowd = postings.filter(common).select("node").distinct()
    regraded = F.transform("set", lambda key: shingle_key(hash_bits(key), grades))
    second = prefix_postings(prefixes(sets.join(crowd, "node").select("node", F.sort_array(regraded).alias("set"))))
    return postings.filter(~common).unionByName(second.withColumn("token", -1 - F.col("token")))


def near_nodes(texts: DataFrame, cut: DataFrame, firsts: DataFrame) -> DataFrame:
    """``node``: texts of lines that have a similar, different line before their own first occurrence."""
    postings = cut_lineage(postings_of(cut, firsts))
    sets = cut_lineage(whole_sets(texts, firsts, postings.select("node").distinct()))
    shared = with_rare_first(postings, sets).groupBy("node").agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct((F.col("token") < 0).alias("second"), "at", "token", "there"))).alias("own")
    )
    sketches = sketched(sets).dropDuplicates(["node"])
    # A row per node with its shared prefix shingles, which a line's length bounds.
    nodes = cut_lineage(shared.join(firsts.select("node", "first"), "node").join(sketches, "node").withColumn("tokens", F.col("own.token")))
    # ``from`` counts the shared prefix shingles of the node from this one on.
    each = nodes.select("node", "first", "size", *BITS, F.size("own").alias("n"), F.posexplode("own").alias("nth", "one"))
    each = each.select("node", "first", "size", *BITS, "one.at", "one.token", "one.there", (F.col("n") - F.col("nth")).alias("from"))
    columns = lambda mark: [F.col(f"{mark}{c}") for c in BITS]

    # Every line with the first line of each of its shingles, and some more.
    one = F.struct("first", "node", "size", "at", *BITS)
    chosen = [F.min(one), *(F.min_by(one, F.xxhash64(F.lit(k), "node")) for k in range(1, LEADERS))]
    # Dealt whole, as few rows of a task share a shingle, and to sort them for a first step costs more than it saves.
    heads = each.repartition("token").groupBy("token").agg(F.array_distinct(F.array(*chosen)).alias("heads"))
    asked = each.join(heads, "token").withColumn("head", F.explode("heads")).filter(F.col("head.first") < F.col("first"))
    fits = may_match(F.col("size"), F.col("at"), F.col("head.size"), F.col("head.at"))
    fits &= alike_bits(F.col("size"), columns(""), F.col("head.size"), columns("head."))
    tried = cut_lineage(asked.filter(fits).select(F.col("node").alias("u"), F.col("head.node").alias("v")).distinct())
    hopeful = cut_lineage(promising(tried, nodes))

    # What has no match there, with all earlier lines. Bounds hold for a pair's first common shingle; a later one may fail them.
    crowded = each.filter("there > 2").drop("there")

    def with_all(left: DataFrame) -> DataFrame:
        mine = crowded.join(left, "node", "left_semi").select("token", *(F.col(c).alias(f"x_{c}") for c in crowded.columns if c != "token"))
        size, other = F.col("x_size"), F.col("size")
        beyond = F.least(size - F.col("x_at"), other - F.col("at"))
        most = F.least(beyond, F.least("x_from", "from") + most_beyond(size, other), size, other)
        earlier = F.col("first") < F.col("x_first")
        met = mine.join(crowded, "token").filter(earlier & reaches(most, size, other) & alike_bits(size, columns("x_"), other, columns("")))
        met = met.select(F.col("x_node").alias("u"), F.col("node").alias("v")).distinct()
        return promising(met.join(tried, ["u", "v"], "left_anti"), nodes)

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        # A document that stands in the table several times gives its lines as often; one of each is enough.
        return cut_lineage(similar(pairs, cut_lineage(sets.join(wanted, "node").dropDuplicates(["node"]))))

    hoping = hopeful.select(F.col("u").alias("node")).distinct()
    rest = with_all(nodes.select("node").join(hoping, "node", "left_anti"))
    gone = verified(cut_lineage(hopeful.unionByName(rest)))
    missed = cut_lineage(with_all(hoping.join(gone, "node", "left_anti")))
    return gone.unionByName(verified(missed))


def removed_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``d, k, n_lines, exact, near``: per document (id and text key) its lines with words, and the numbers of those that go,
    as copies of an earlier line or as similar to one."""
    texts = keyed(docs, doc, text)
    cut = cut_lineage(cut_lines(texts))
    firsts = cut_lineage(cut.groupBy("node").agg(F.min(F.struct("d", "k", "nth")).alias("first"), F.count(F.lit(1)).alias("n")))
    near = near_nodes(texts, cut, firsts).withColumn("is_near", F.lit(True))
    # Only lines that stand there several times or have a similar one can go.
    suspects = firsts.join(near, "node", "left").filter("n > 1 or is_near").drop("n")
    judged = cut.select("d", "k", "nth", "node").join(suspects, "node").withColumn("copy", F.col("first") != F.struct("d", "k", "nth")).filter("copy or is_near")
    numbers = lambda what: F.array_sort(F.collect_set(F.when(what, F.col("nth"))))
    lost = judged.groupBy("d", "k").agg(numbers(F.col("copy")).alias("exact"), numbers(~F.col("copy")).alias("near"))
    every = cut.groupBy("d", "k").agg(F.max("n_lines").cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return every.join(lost, ["d", "k"], "left").select("d", "k", "n_lines", *(F.coalesce(c, none).alias(c) for c in ("exact", "near")))


def remove_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut out of the text; all rows and columns stay."""
    names = docs.columns
    inner = docs.toDF(*(f"own {k}" for k in range(len(names))))
    own_doc, own_text = f"own {names.index(doc)}", f"own {names.index(text)}"
    lost = removed_lines(inner, own_doc, own_text).select("d", "k", F.concat("exact", "near").alias("lost")).filter(F.size("lost") > 0)
    t = F.coalesce(F.col(f"`{own_text}`"), F.lit(""))
    rows = inner.withColumns({"d": F.coalesce(F.col(f"`{own_doc}`").cast("long"), F.lit(LAST)), "k": F.xxhash64(t)})
    joined = rows.join(lost, ["d", "k"], "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{own_text}`"), "\n"), lambda line, i: ~F.array_contains(F.col("lost"), i)), "\n")
    new = F.when(F.col("lost").isNull(), F.col(f"`{own_text}`")).otherwise(kept)
    return joined.withColumn(own_text, new).select(*inner.columns).toDF(*names)
