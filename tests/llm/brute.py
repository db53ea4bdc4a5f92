"""Plain versions of the operators, for small inputs, and the inputs that hold the awkward cases."""

import collections
import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, d long, k string, score double, shard int, record string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def awkward_texts(seed=3):
    """Nulls, empty, one word, copies, near copies, shared passages, odd characters, one long text."""
    rng = random.Random(seed)
    syllables = ["an", "the", "re", "ti", "on", "é", "schö", "lo", "ka", "mi"]

    def prose(n):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))

    shared, base = prose(60), prose(120)
    near = base.split(" ")
    near[3] = "changed"
    texts = [None, "", " \n \n", "one", "Don't we'll it's 'x \n\n  end  ", base, base, " ".join(near), base.upper()]
    texts += [prose(20) + "\n" + shared + "\n" + prose(15), prose(30) + " " + shared + " " + prose(7), shared]
    texts += [prose(rng.randint(1, 80)) + "\n" + prose(12) for _ in range(20)]
    texts += ["a" * 400, "ab" * 200, "日本語のテキスト 123 ١٢٣   x\r\n\ttab", prose(6000)]
    return texts


def awkward_rows(seed=3):
    """Rows with columns whose names the operators use too; one row twice, one null id."""
    rows = [(i, t, "xx", 1, "k", 0.5, 3, "r") for i, t in enumerate(awkward_texts(seed))]
    random.Random(seed).shuffle(rows)
    return rows + [rows[3], (None, rows[5][1], None, None, None, None, None, None)]


def awkward(spark, seed=3, parts=3):
    return spark.createDataFrame(awkward_rows(seed), SCHEMA).repartition(parts)


def repeated_bytes(rows, length=50):
    """Per row the bytes that lie in a string of ``length`` that starts in a row with a smaller id too."""
    last = 1 << 63
    key = lambda i: last if i is None else i
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for a in range(len(raw) - length + 1):
            w = raw[a : a + length]
            least[w] = min(least.get(w, last + 1), key(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            if least[raw[a : a + length]] < key(i):
                gone[a : a + length] = b"\1" * length
        out.append((i, bytes(b for b, g in zip(raw, gone, strict=True) if not g), sum(gone)))
    return out


def shingles(text, n=5):
    w = words(text)
    return collections.Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else collections.Counter()


def near_classes(rows, least=0.8):
    """Row number -> smallest row number of its class (weighted Jaccard, connected components)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, every = (sets[i] & sets[j]).total(), (sets[i] | sets[j]).total()
            if every == 0 or both / every >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def similar_lines(rows, least=0.8):
    """Per (id, text) the numbers of lines that copy an earlier line, and of those similar to one."""
    last = 1 << 63
    lines = []
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            line = line.lower().strip(" ")
            if line:
                w = [x for x in line.split(" ") if x]
                lines.append((last if i is None else i, n, t, line, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}))
    first = {}
    for i, n, _, line, _ in lines:
        first[line] = min(first.get(line, (last + 1, 0)), (i, n))
    out = collections.defaultdict(lambda: (set(), set()))
    for i, n, t, line, s in lines:
        if (i, n) != first[line]:
            out[i, t][0].add(n)
        elif any((j, m) < (i, n) and line != other and len(s & r) >= least * len(s | r) for j, m, _, other, r in lines):
            out[i, t][1].add(n)
    return out


def contamination(texts, items, window=10):
    """Per text: words, hit words, sorted item ids."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


BASE = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in BASE.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()
