"""Secret scan: fixed patterns, and credential formats learned by grammar inference.

The fixed patterns find labelled credentials. Their values train one probabilistic automaton per kind: a prefix tree
whose statistically compatible states are merged (ALERGIA: Hoeffding bound on the frequencies of ending and of every
symbol, applied to the subtrees too). All other candidates of every text are then scored by how much likelier the best
automaton makes their format than a background model of ordinary candidates. Nothing is shuffled but the training
sample, which is the ``SAMPLE`` values per kind with the smallest hashes; the scan itself covers every whole text.

Symbols are character classes; a class spreads its probability evenly over its characters.

Cases: null text counts as empty and has no spans; without labelled values nothing is learned and only the fixed
patterns count; repeated rows each get their own row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The base patterns with their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, so the least length can stand in the pattern
KINDS = ("assign", "access", "hex")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

# A candidate of the learned formats: a maximal run of credential characters with a digit and a letter in it.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
# Bound of the training sample, values per kind and ordinary candidates.
SAMPLE = 1000
ALPHA = 0.05
# A format counts only if an automaton makes it this much likelier than the background, in nats per character.
LEAST_RATIO = 0.1

CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
SYMBOL = np.full(128, -1, dtype=np.int64)
for _k, _chars in enumerate(CLASSES):
    SYMBOL[[ord(c) for c in _chars]] = _k
SPREAD = np.log([len(c) for c in CLASSES])
END = len(CLASSES)

RESULT = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, "
    "found array<struct<kind:string,start:long,end:long,score:double>>"
)


def base_matches(text: str) -> list[tuple[int, int, str, str]]:
    """``start, kind number, end, value`` of the fixed patterns, by start, then kind as listed."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list) -> list[tuple[int, int, str]]:
    """Runs of credential characters outside every base span."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][2] <= m.start():
            k += 1
        if any(b[0] < m.end() and b[2] > m.start() for b in base[max(0, k - 3) : k + 3]):
            continue
        if MIXED.match(m[0]):
            out.append((m.start(), m.end(), m[0]))
    return out


def symbols(value: str) -> np.ndarray:
    return SYMBOL[np.frombuffer(value.encode("ascii"), np.uint8)]


class Automaton:
    """A prefix tree with counts, merged into a probabilistic automaton."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.next: list[dict] = [{}]
        self.count: list[Counter] = [Counter()]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for value in values:
            at = 0
            for s in symbols(value).tolist():
                self.count[at][s] += 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                at = self.next[at][s]
            self.count[at][END] += 1
        self._merge_all()
        self._tabulate()

    def _differ(self, a: int, b: int) -> bool:
        n, m = self.count[a].total(), self.count[b].total()
        if not n or not m:
            return False
        gap = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(self.count[a][s] / n - self.count[b][s] / m) > gap for s in self.count[a] | self.count[b])

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._differ(a, b):
                return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[b] if s in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to the state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a].update(self.count[b])
            for s, child in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], child))
                else:
                    self.next[a][s] = child

    def _merge_all(self) -> None:
        """Red states stay; a state behind one is folded into the first red state it agrees with, or turns red."""
        red = [0]
        blue = [(0, s) for s in sorted(self.next[0])]
        while blue:
            parent, s = blue.pop(0)
            state = self.next[parent].get(s)
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][s] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            known = set(red)
            blue = [(r, s) for r in red for s in sorted(self.next[r]) if self.next[r][s] not in known]
        self.red = red

    def _tabulate(self) -> None:
        place = {r: k for k, r in enumerate(self.red)}
        n = len(place)
        self.step = np.full((n + 1, END), n)  # the last state stands for formats that were never seen
        self.log_p = np.full((n + 1, END + 1), math.log(1e-4))
        for r, k in place.items():
            total = self.count[r].total() + 0.01 * (END + 1)
            for s in range(END + 1):
                self.log_p[k, s] = math.log((self.count[r][s] + 0.01) / total)
            for s, target in self.next[r].items():
                self.step[k, s] = place[target]

    def score(self, values: list[str]) -> np.ndarray:
        """Log probability of each value."""
        lengths = np.array([len(v) for v in values])
        order = np.argsort(-lengths, kind="stable")
        flat = symbols("".join(values[k] for k in order))
        begins = np.concatenate([[0], np.cumsum(lengths[order])])[:-1]
        state, total = np.zeros(len(values), np.int64), np.zeros(len(values))
        for j in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths[order], -j, "left"))
            s = flat[begins[:live] + j]
            total[:live] += self.log_p[state[:live], s] - SPREAD[s]
            state[:live] = self.step[state[:live], s]
        total += self.log_p[state, END]
        out = np.empty(len(values))
        out[order] = total
        return out


class Background:
    """Ordinary candidates: transitions between character classes."""

    def __init__(self, values: list[str]):
        counts = np.ones((END + 1, END + 1))
        for value in values:
            s = symbols(value)
            np.add.at(counts, (np.concatenate([[END], s]), np.concatenate([s, [END]])), 1)
        self.log_p = np.log(counts / counts.sum(1, keepdims=True))

    def score(self, values: list[str]) -> np.ndarray:
        out = np.empty(len(values))
        for k, value in enumerate(values):
            s = symbols(value)
            out[k] = self.log_p[np.concatenate([[END], s]), np.concatenate([s, [END]])].sum() - SPREAD[s].sum()
        return out


class Formats:
    """The learned automata with their common threshold on the log likelihood ratio per character."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: list[str]):
        self.background = Background(ordinary)
        self.automata, self.threshold = [], math.inf
        held = []
        for values in labelled.values():
            # Every fifth value is held out; half the ratio that 95 % of those reach is the threshold.
            fit = [v for k, v in enumerate(values) if k % 5]
            if len(fit) >= 10:
                self.automata.append(Automaton(fit))
                held += values[::5]
        if self.automata:
            self.threshold = max(LEAST_RATIO, 0.5 * float(np.quantile(self.ratio(held), 0.05)))

    def ratio(self, values: list[str]) -> np.ndarray:
        best = np.max([a.score(values) for a in self.automata], axis=0)
        return (best - self.background.score(values)) / np.array([max(1, len(v)) for v in values])


def training_values(docs: DataFrame, text: str = "text", size: int = SAMPLE) -> DataFrame:
    """``kind, value``: per kind the ``size`` distinct values with the smallest hashes, and as many ordinary candidates.

    Each batch already keeps no more than that, so the shuffle holds at most ``size`` values per kind and batch.
    """

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            seen: dict[str, dict[str, int]] = {}
            for t in batch.column(0).to_pylist():
                if t:
                    base = base_matches(t)
                    for kind, value in [(KINDS[k], v) for _, k, _, v in base] + [("other", v) for *_, v in candidates(t, base)]:
                        seen.setdefault(kind, {})[value] = xxhash.xxh64_intdigest(value) >> 1
            rows = [(k, v, h) for k, vs in seen.items() for v, h in sorted(vs.items(), key=lambda x: (x[1], x[0]))[:size]]
            if rows:
                kinds, values, hashes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values), pa.array(hashes, pa.int64())], names=["kind", "value", "h"])

    found = docs.select(F.col(text).alias("t")).mapInArrow(scan, "kind string, value string, h long").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy("h", "value"))
    return found.withColumn("place", place).filter(F.col("place") <= size).select("kind", "value", "place")


def learn(docs: DataFrame, text: str = "text", size: int = SAMPLE) -> Formats:
    labelled: dict[str, list[str]] = {k: [] for k in KINDS}
    ordinary: list[str] = []
    for row in training_values(docs, text, size).orderBy("kind", "place").collect():
        (ordinary if row.kind == "other" else labelled[row.kind]).append(row.value)
    return Formats(labelled, ordinary)


def find_secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SAMPLE) -> DataFrame:
    """One row per document with the base spans and those whose format looks like a credential."""
    formats = docs.sparkSession.sparkContext.broadcast(learn(docs, text, size))

    def joined(spans):
        return ",".join(f"{kind}:{start}:{end}" for kind, start, end, _ in spans)

    def scan(batches: Iterator[pa.RecordBatch]):
        learned = formats.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_matches(t) for t in texts]
            more = [candidates(t, b) for t, b in zip(texts, base, strict=True)] if learned.automata else [[] for _ in texts]
            flat = [v for c in more for *_, v in c]
            ratio = iter(learned.ratio(flat).tolist() if flat else [])
            rows = []
            for b, c in zip(base, more, strict=True):
                own = [(s, k, e, 1.0) for s, k, e, _ in b]
                extra = [(s, len(KINDS), e, r) for (s, e, _), r in zip(c, ratio) if r > learned.threshold]
                every = [((*KINDS, "format")[k], s, e, r) for s, k, e, r in sorted(own + extra)]
                only = [x for x in every if x[0] != "format"]
                n = Counter(x[0] for x in every)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(only).encode()).hexdigest(), joined(every), n["format"],
                             [dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in every]))
            names = [x.split()[0] for x in RESULT.split(", ")][1:]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            kinds.append(pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
            arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *names])

    return docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(scan, RESULT)
