"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole spans.

The fixed patterns find e-mail addresses, IP addresses, card and phone numbers with their checks. The field adds spans
that they miss because they are written otherwise or because a failing match has swallowed them. It looks at regions:
stretches of text around digits and at signs. A region is cut into atoms (runs of digits, letters, blanks, single
marks). Every stretch of up to ``MOST_ATOMS`` atoms that may be a span is a candidate segment, and its features describe
the whole of it: digits, groups and their lengths, the Luhn sum, octets, marks inside, what stands on both sides.
A labelling of a region is a chain of segments and single outside atoms; its score is the sum of its segments' scores and
of a weight for each pair of types that follow each other directly. Training maximises the likelihood of the right labelling by
forward and backward sums over positions and types; decoding is the best labelling by dynamic programming over
segments of bounded length, which picks boundaries and types together. A decoded segment counts if it scores at least
``MARGIN`` nats above leaving its atoms outside and touches no span of the fixed patterns.

The labels come from the fixed patterns: regions with their spans, the same regions with the spans in other written
forms (``forms``), and regions without a span. Regions in which a failing match holds more digits than a card or a phone
number has, or in which a field that was trained on other regions finds a span, are left out, as their truth is unknown.
At most ``SAMPLE`` regions per kind are used, those with the smallest hashes; only they reach the driver. The scan covers
every whole text, in one pass without a shuffle.

Cases: null text counts as empty and has no spans; without any span in the corpus nothing is learned and only the fixed
patterns count; repeated rows each get their own row; an empty table gives an empty result; further columns are
ignored. Positions are code points; ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyground.settings import cut_lineage

# The base patterns, written so that no text takes more than linear time.
KINDS = ("email", "ip", "card", "phone")
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

SAMPLE = 200
MOST_ATOMS = 24
MARGIN = 3.0
STEPS = 100
RIDGE = 0.0005
# Candidates that are scored at once.
AT_ONCE = 1 << 15
# A neighbouring word belongs to a region with about so many characters at most.
CONTEXT = 40

# Kinds of atoms.
NUMBER, LETTERS, BLANK, DOT, DASH, OPEN, CLOSE, PLUS, SLASH, AT, LEFT, RIGHT, LINE, COLON, OTHER, AT_WORD, DOT_WORD, EDGE = range(18)
MARKS = {".": DOT, "-": DASH, "(": OPEN, ")": CLOSE, "+": PLUS, "/": SLASH, "@": AT, "[": LEFT, "]": RIGHT, "_": LINE, ":": COLON}
ATOM = re.compile(r"[(\[{]\x20?at\x20?[)\]}]|[(\[{]\x20?(?:dot|\.)\x20?[)\]}]|[0-9]+|[A-Za-z]+|\s+|.", re.IGNORECASE | re.DOTALL | re.ASCII)
TRIGGER = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.IGNORECASE | re.ASCII)
MARK_ONLY = re.compile(r"[().+/\[\]{}:-]{1,3}$")
WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for m in AT_DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """``kind number, start, end`` of the fixed patterns, by kind as listed, then start."""
    out = [(0, *m) for m in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        # A part with many digits is more than 255 unless they are leading zeros.
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of words with digits or at signs, with up to two words on either side on the same line."""
    if not TRIGGER.search(text):
        return []
    out: list[tuple[int, int]] = []
    begin, end, cold, hot = -1, 0, 0, False  # the open region: words without a trigger since the last one, any trigger at all
    before, chain = 0, [0, 0]  # the end of the word before; where the words one and two back begin, as far as they are near
    for m in WORD.finditer(text):
        start, stop = m.span()
        near = before > 0 and start - before <= 3 and "\n" not in text[before:start]
        if not near:
            chain = [start, start]
            if begin >= 0 and hot:
                out.append((begin, end))
            begin = -1
        trigger = TRIGGER.search(text, start, stop) is not None
        if trigger or (stop - start <= 3 and MARK_ONLY.match(text, start, stop)):
            if begin < 0:
                begin, hot = max(chain[0], start - 2 * CONTEXT, out[-1][1] if out else 0), False
            end, cold, hot = stop, 0, hot or trigger
        elif begin >= 0:
            end, cold = min(stop, start + CONTEXT), cold + 1
            if cold == 2 or end < stop:
                if hot:
                    out.append((begin, end))
                begin = -1
        before, chain = stop, [chain[1], start]
    if begin >= 0 and hot:
        out.append((begin, end))
    return out


class Atoms:
    """The atoms of several regions, one after another, with running sums over them."""

    def __init__(self, texts: list[str]):
        start, end, kind, count, value, region, digits = [], [], [], [], [], [], []
        for k, text in enumerate(texts):
            for m in ATOM.finditer(text):
                token = m[0]
                c = token[0]
                number = "0" <= c <= "9"
                if number:
                    what = NUMBER
                    digits.append(token)
                elif token.isascii() and token.isalpha():
                    what = LETTERS
                elif c.isspace():
                    what = BLANK
                elif len(token) > 1:
                    what = AT_WORD if "a" in token.lower() else DOT_WORD
                else:
                    what = MARKS.get(c, OTHER)
                start.append(m.start())
                end.append(m.end())
                kind.append(what)
                count.append(len(token) if number else 0)
                value.append(int(token) <= 255 if number and len(token) <= 3 else False)
                region.append(k)
        self.start, self.end, self.kind = np.array(start, np.int64), np.array(end, np.int64), np.array(kind, np.int64)
        self.count, self.region = np.array(count, np.int64), np.array(region, np.int64)
        self.first = np.searchsorted(self.region, np.arange(len(texts) + 1))
        self.digits = self._sums(self.count)
        self.octets = self._sums(np.array(value, np.int64))
        self.of_kind = {k: self._sums((self.kind == k).astype(np.int64)) for k in range(EDGE)}
        d = np.frombuffer("".join(digits).encode(), np.uint8).astype(np.int64) - 48
        twice = d * 2 - 9 * (d > 4)
        even = np.arange(len(d)) % 2 == 0
        # Luhn sums in which the digits at even places are doubled, and those at odd ones.
        self.luhn = np.stack([self._sums(np.where(even, twice, d)), self._sums(np.where(even, d, twice))])
        self.zero = self._sums(d == 0)
        places = np.flatnonzero((self.kind == AT) | (self.kind == AT_WORD))
        self.next_at = np.append(places, len(self.kind))[np.searchsorted(places, np.arange(len(self.kind) + 1))]

    @staticmethod
    def _sums(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(x)])

    def between(self, kinds, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(self.of_kind[k][b] - self.of_kind[k][a] for k in kinds)

    def beside(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The kind of the atom at ``place`` if it is in the region of the span, else EDGE."""
        inside = (place >= self.first[self.region[a]]) & (place < self.first[self.region[a] + 1])
        return np.where(inside, self.kind[np.clip(place, 0, len(self.kind) - 1)], EDGE)


def candidates(atoms: Atoms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``first atom, atom behind, is an address, longest group, shortest group`` of every stretch that may be a span."""
    n = len(atoms.kind)
    longest, shortest = atoms.count.copy(), np.where(atoms.count > 0, atoms.count, 1 << 30)
    out = []
    opens = np.isin(atoms.kind, (NUMBER, PLUS, OPEN))
    word = np.isin(atoms.kind, (NUMBER, LETTERS))
    number = atoms.kind == NUMBER
    for size in range(1, min(MOST_ATOMS, n) + 1):
        a = np.arange(n - size + 1)
        b = a + size
        if size > 1:
            longest = np.maximum(longest[:-1], atoms.count[size - 1 :])
            shortest = np.minimum(shortest[:-1], np.where(atoms.count[size - 1 :] > 0, atoms.count[size - 1 :], 1 << 30))
        one = atoms.region[a] == atoms.region[b - 1]
        digits, groups = atoms.digits[b] - atoms.digits[a], atoms.between((NUMBER,), a, b)
        strange = atoms.between((LETTERS, OTHER, AT, AT_WORD), a, b)
        numeric = one & opens[a] & number[b - 1] & (strange == 0) & (digits <= 19) & ((digits >= 7) | ((groups == 4) & (digits >= 4)))
        marks = atoms.between((AT, AT_WORD), a, b)
        address = one & word[a] & word[b - 1] & (marks == 1) & (atoms.between((BLANK,), a, b) <= 6) & (atoms.between((DOT, DOT_WORD), a, b) > 0) & (size >= 5)
        for which, mail in ((numeric, False), (address, True)):
            rows = np.flatnonzero(which)
            out.append((a[rows], b[rows], np.full(len(rows), mail), longest[rows], shortest[rows]))
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),) + (np.zeros(0, np.int64),) * 2
    a, b, mail, longest, shortest = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((a, b))
    return a[order], b[order], mail[order], longest[order], shortest[order]


def _one_of(x: np.ndarray, edges: list[int]) -> np.ndarray:
    return np.eye(len(edges) + 1, dtype=np.float32)[np.searchsorted(edges, x, "right")]


SIDES = np.zeros((EDGE + 1, 7), np.float32)
for _k in range(EDGE + 1):
    SIDES[_k, {EDGE: 0, BLANK: 1, LETTERS: 2, NUMBER: 3, DOT: 4, DASH: 5}.get(_k, 6)] = 1


def features(atoms: Atoms, a: np.ndarray, b: np.ndarray, mail: np.ndarray, longest: np.ndarray, shortest: np.ndarray) -> np.ndarray:
    """What the whole span looks like and what stands beside it."""
    digits, groups = atoms.digits[b] - atoms.digits[a], atoms.between((NUMBER,), a, b)
    octets = (atoms.octets[b] - atoms.octets[a] == groups) & (groups == 4)
    dots = atoms.between((DOT, DOT_WORD), a, b)
    last = atoms.digits[b]
    parity = last % 2  # the last digit is not doubled
    total = np.where(parity == 1, atoms.luhn[1][last] - atoms.luhn[1][atoms.digits[a]], atoms.luhn[0][last] - atoms.luhn[0][atoms.digits[a]])
    of_card = (digits >= 13) & (digits <= 19)
    between = (b - a) - groups - np.maximum(groups - 1, 0)
    blanks = atoms.between((BLANK,), a, b)
    first = atoms.kind[a]
    begin = atoms.digits[a]
    zeros = (first == NUMBER) & (atoms.count[a] >= 2) & (atoms.zero[np.minimum(begin + 2, len(atoms.zero) - 1)] - atoms.zero[begin] == 2)
    at = np.minimum(atoms.next_at[a], len(atoms.kind) - 1)
    end_word = (atoms.kind[b - 1] == LETTERS) & (atoms.end[b - 1] - atoms.start[b - 1] >= 2) & (atoms.end[b - 1] - atoms.start[b - 1] <= 6)
    behind, ahead = atoms.beside(a, b, a - 1), atoms.beside(a, b, b)
    behind2, ahead2 = atoms.beside(a, b, a - 2), atoms.beside(a, b, b + 1)
    word = lambda k: (k == NUMBER) | (k == LETTERS)
    yes = [
        np.ones(len(a)), octets, octets & (dots == 3), of_card & (total % 10 == 0), of_card & (total % 10 != 0),
        first == PLUS, first == OPEN, zeros, *(atoms.between((k,), a, b) > 0 for k in (BLANK, DASH, DOT, OPEN, CLOSE, SLASH, LEFT, LINE, COLON, DOT_WORD)),
        atoms.between((PLUS,), a, b) > (first == PLUS), atoms.between((OPEN,), a, b) != atoms.between((CLOSE,), a, b),
        (groups == 4) & (longest == 4) & (shortest == 4), octets & (blanks > 0),
        mail & (atoms.between((AT,), a, b) > 0), mail & (atoms.between((AT_WORD,), a, b) > 0), mail & end_word,
        mail & (atoms.between((DOT, DOT_WORD), at, np.maximum(b, at)) > 0), mail & np.isin(atoms.kind[np.minimum(at + 1, len(atoms.kind) - 1)], (DOT, DASH)),
        mail & (blanks > 0), mail & (blanks > 2),
        (behind == BLANK) & (behind2 == NUMBER), (ahead == BLANK) & (ahead2 == NUMBER),
        np.isin(behind, (DOT, DASH, LINE, PLUS, SLASH)) & word(behind2), np.isin(ahead, (DOT, DASH, SLASH, LINE)) & word(ahead2),
    ]
    return np.concatenate(
        [
            np.stack(yes, axis=1).astype(np.float32), _one_of(digits, [7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17]), _one_of(groups, [1, 2, 3, 4, 5, 6]),
            _one_of(longest, [1, 2, 3, 4, 5, 9, 13]), _one_of(shortest, [2, 3, 4, 5]), _one_of(between, [1, 3]), SIDES[behind], SIDES[ahead],
        ],
        axis=1,
    )


def _allowed(mail: np.ndarray) -> np.ndarray:
    """Which types a candidate may have: an address only the first, a number the others."""
    return np.concatenate([mail[:, None], np.repeat(~mail[:, None], 3, axis=1)], axis=1)


@dataclass
class Field:
    """``weight`` per type and feature, ``follow[before, after]`` for segments side by side."""

    weight: np.ndarray
    follow: np.ndarray

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """Per region ``type, start, end, score`` of the segments of the best labelling, by start."""
        atoms = Atoms(texts)
        a, b, mail, longest, shortest = candidates(atoms)
        rows, types, scores = [], [], []
        # A segment can gain no more than the best weights on both sides; below that it is never part of the best labelling.
        gain = 2 * max(0.0, float(self.follow.max()))
        for k in range(0, len(a), AT_ONCE):
            cut = slice(k, k + AT_ONCE)
            s = np.where(_allowed(mail[cut]), features(atoms, a[cut], b[cut], mail[cut], longest[cut], shortest[cut]) @ self.weight.T, -np.inf)
            row, kind = np.nonzero(s + gain > 0)
            rows.append(row + k)
            types.append(kind)
            scores.append(s[row, kind])
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        if not rows:
            return out
        row, kind, score = np.concatenate(rows), np.concatenate(types), np.concatenate(scores)
        region = atoms.region[a[row]] if len(row) else row
        order = np.lexsort((kind, a[row], b[row], region))
        row, kind, score, region = row[order], kind[order], score[order], region[order]
        edges = np.searchsorted(region, np.arange(len(texts) + 1))
        for r in np.flatnonzero(np.diff(edges)).tolist():
            items = slice(edges[r], edges[r + 1])
            spans = list(zip(a[row[items]].tolist(), b[row[items]].tolist(), kind[items].tolist(), score[items].tolist(), strict=True))
            for i, j, t, s in self._best(spans):
                out[r].append((t, int(atoms.start[i]), int(atoms.end[j - 1]), s))
        return out

    def _best(self, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """The best chain; ``spans`` by end. Only positions where a span ends can change anything."""
        ends: list[int] = [-1]
        # Per end: the best total up to there (with an outside atom or nothing last), and per type the best that ends right there.
        whole: list[tuple[float, object]] = [(0.0, None)]
        right: list[dict[int, tuple[float, object]]] = [{}]
        k = 0
        while k < len(spans):
            end, here = spans[k][1], {}
            while k < len(spans) and spans[k][1] == end:
                i, j, t, s = spans[k]
                lo, hi = 0, len(ends)
                while lo < hi:  # the last end that is not behind the start
                    mid = (lo + hi) // 2
                    if ends[mid] <= i:
                        lo = mid + 1
                    else:
                        hi = mid
                p = lo - 1
                best = whole[p] if ends[p] < i else whole[p - 1]  # with an outside atom before the segment
                options = [(best[0] + s, (best[1], (i, j, t, s)))]
                if ends[p] == i:
                    options += [(v + float(self.follow[u, t]) + s, (back, (i, j, t, s))) for u, (v, back) in right[p].items()]
                top = max(options, key=lambda x: x[0])
                if t not in here or top[0] > here[t][0]:
                    here[t] = top
                k += 1
            ends.append(end)
            whole.append(max([whole[-1], *here.values()], key=lambda x: x[0]))
            right.append(here)
        out, back = [], whole[-1][1]
        while back:
            back, item = back
            out.append(item)
        return out[::-1]


def doubtful(text: str) -> bool:
    """Whether a failing match may hide several spans."""
    return any(len(DIGIT.findall(m[0])) > most for pattern, most in ((CARD, 19), (PHONE, 15)) for m in pattern.finditer(text))


def forms(kind: int, value: str) -> list[str]:
    """Other ways in which people write the same thing."""
    digits = "".join(DIGIT.findall(value))
    if kind == 0:
        name, domain = value.split("@")
        dotted = domain.replace(".", "[dot]")
        return [f"{name} @ {domain}", f"{name}(at){domain}", f"{name} [at] {domain}", f"{name}[at]{dotted}", f"{name} (at) {domain.replace('.', ' (dot) ')}"]
    if kind == 1:
        return [value.replace(".", x) for x in (" . ", "[.]", "(.)")]
    if kind == 2:
        fours = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return [x.join(fours) for x in (".", "/", "  ", "_")] + [f"{digits} {digits}"]
    return [value[1:], value[1:].replace(" ", "-"), "00" + value[1:], value[1:].replace("-", ".").replace(" ", "."), value[1:].split(" ", 1)[-1]]


def variants(text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The region itself and, for each form, the region with its first span written so, each with its right spans."""
    gold = sorted(base_matches(text), key=lambda g: g[1])
    out = [(text, gold)]
    if len(gold) == 1:
        kind, start, end = gold[0]
        for form in forms(kind, text[start:end]):
            new = text[:start] + form + text[end:]
            twice = kind == 2 and form.count(" ") == 1 and "  " not in form
            half = len(form) // 2
            spans = [(kind, start, start + half), (kind, start + half + 1, start + len(form))] if twice else [(kind, start, start + len(form))]
            out.append((new, spans))
    return out


def train(labelled: list[tuple[str, list[tuple[int, int, int]]]], steps: int = STEPS) -> Field:
    """The field that makes the right labellings likeliest, by Adam on the penalised log likelihood."""
    atoms = Atoms([t for t, _ in labelled])
    a, b, mail, longest, shortest = candidates(atoms)
    x = features(atoms, a, b, mail, longest, shortest)
    row, kind = np.nonzero(_allowed(mail))
    region = atoms.region[a[row]]
    start, end = a[row] - atoms.first[region], b[row] - atoms.first[region]
    truth = {(r, t, s, e) for r, (_, spans) in enumerate(labelled) for t, s, e in spans}
    key = zip(region.tolist(), kind.tolist(), atoms.start[a[row]].tolist(), atoms.end[b[row] - 1].tolist(), strict=True)
    right = np.array([k in truth for k in key], bool)
    # Regions whose spans are not all among the candidates teach nothing.
    want = np.bincount([r for r, *_ in truth], minlength=len(labelled)) if truth else np.zeros(len(labelled), np.int64)
    usable = np.bincount(region[right], minlength=len(labelled)) == want
    keep = usable[region]
    row, kind, region, start, end, right = (v[keep] for v in (row, kind, region, start, end, right))
    lengths = np.diff(atoms.first)
    most, n, types = int(lengths.max(initial=0)), len(labelled), len(KINDS)
    by_end, by_start = np.argsort(end, kind="stable"), np.argsort(start, kind="stable")
    end_at, start_at = np.searchsorted(end[by_end], np.arange(most + 2)), np.searchsorted(start[by_start], np.arange(most + 2))
    follow_right = np.zeros((types, types))
    for r, (_, spans) in enumerate(labelled):
        if usable[r]:
            for (t, _, e), (u, s, _) in zip(spans, spans[1:]):
                follow_right[t, u] += e == s
    weight, follow = np.zeros((types, x.shape[1])), np.zeros((types, types))
    moments = [np.zeros_like(v) for v in (weight, weight, follow, follow)]
    for step in range(1, steps + 1):
        score = (x[row] * weight[kind]).sum(1) if step > 1 else np.zeros(len(row))
        # Types 0..3 and outside: log sums over all labellings up to a position, by what stands last.
        ahead = np.full((most + 1, n, types + 1), -np.inf)
        ahead[0, :, types] = 0.0
        wide = np.concatenate([follow, np.zeros((1, types))])  # what outside, or the start, gives to a type
        for j in range(1, most + 1):
            ahead[j, :, types] = np.logaddexp.reduce(ahead[j - 1], axis=1)
            for t in range(types):
                items = by_end[end_at[j] : end_at[j + 1]]
                items = items[kind[items] == t]
                if len(items):
                    into = np.logaddexp.reduce(ahead[start[items], region[items]] + wide[:, t], axis=1) + score[items]
                    np.logaddexp.at(ahead[j, :, t], region[items], into)
        back = np.full((most + 1, n, types + 1), -np.inf)
        for j in range(most, -1, -1):
            back[j][lengths == j] = 0.0
            if j < most:
                inside = lengths > j
                back[j, inside] = back[j + 1, inside, types, None]
                items = by_start[start_at[j] : start_at[j + 1]]
                if len(items):
                    onward = score[items] + back[end[items], region[items], kind[items]]
                    for u in range(types + 1):
                        np.logaddexp.at(back[j, :, u], region[items], onward + wide[u, kind[items]])
        total = back[0, :, types]
        given = ahead[start, region] + wide[:, kind].T + (score + back[end, region, kind] - total[region])[:, None]
        chance = np.exp(given)
        expected = chance.sum(1)
        grad_follow = follow_right - np.stack([np.bincount(kind, chance[:, u], minlength=types) for u in range(types)])
        grad = np.stack([(x[row[kind == t]] * (right[kind == t] - expected[kind == t])[:, None]).sum(0) for t in range(types)])
        for k, (value, slope) in enumerate(((weight, grad / n - RIDGE * weight), (follow, grad_follow / n - RIDGE * follow))):
            first, second = moments[2 * k], moments[2 * k + 1]
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            value += 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return Field(weight, follow)


def sample_regions(docs: DataFrame, text: str = "text", size: int = SAMPLE) -> list[tuple[str, str]]:
    """``kind, region`` of the distinct regions with the smallest hashes, at most ``size`` per kind.

    Each batch keeps no more than that. How many lie below a hash is counted in 4,096 classes, so that only what can be
    among the smallest reaches the driver.
    """

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            seen: dict[str, dict[str, int]] = {}
            for t in batch.column(0).to_pylist():
                for start, end in regions(t) if t else ():
                    region = t[start:end]
                    if doubtful(region):
                        continue
                    kinds = {KINDS[k] for k, *_ in base_matches(region)} or {"none"}
                    for kind in kinds:
                        seen.setdefault(kind, {})[region] = xxhash.xxh64_intdigest(region) >> 1
            rows = [(k, v, h) for k, vs in seen.items() for v, h in sorted(vs.items(), key=lambda x: (x[1], x[0]))[:size]]
            if rows:
                kinds, values, hashes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(values), pa.array(hashes, pa.int64())], names=["kind", "region", "h"])

    found = cut_lineage(docs.select(F.col(text).alias("t")).mapInArrow(scan, "kind string, region string, h long").distinct())
    counts = found.groupBy("kind", F.shiftright("h", 51).alias("class")).count().collect()
    least = F.lit(False)
    for kind in sorted({r.kind for r in counts}):
        left, limit = size, 4096
        for r in sorted((r for r in counts if r.kind == kind), key=lambda r: r["class"]):
            limit, left = r["class"] + 1, left - r["count"]
            if left <= 0:
                break
        least = least | ((F.col("kind") == kind) & (F.shiftright("h", 51) < limit))
    rows = sorted(found.filter(least).collect(), key=lambda r: (r.kind, r.h, r.region))
    out: dict[str, list[str]] = {}
    for r in rows:
        if len(out.setdefault(r.kind, [])) < size:
            out[r.kind].append(r.region)
    return [(kind, region) for kind, those in sorted(out.items()) for region in those]


def learn(docs: DataFrame, text: str = "text", size: int = SAMPLE) -> Field | None:
    """The field of a corpus, or None where the fixed patterns find nothing to learn from.

    A region without a span may hold one that the patterns miss. So each half of the sample first judges the other half's
    regions without a span, and those in which it finds one are left out of the last training.
    """
    chosen = sample_regions(docs, text, size)
    if all(kind == "none" for kind, _ in chosen):
        return None
    empty = {region for kind, region in chosen if kind == "none"}
    every = list(dict.fromkeys(region for _, region in chosen))
    keep = []
    for half in (0, 1):
        judged = every[half::2]
        field = train([v for region in every[1 - half :: 2] for v in variants(region)])
        found = field.decode(judged)
        keep += [r for r, spans in zip(judged, found, strict=True) if r not in empty or all(s[3] < MARGIN for s in spans)]
    return train([v for region in keep for v in variants(region)])


def added(field: Field, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int, float]]]:
    """Per text the spans that the field adds: ``kind, start, end, score``."""
    where = [(k, s, e) for k, t in enumerate(texts) for s, e in regions(t)]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if not where:
        return out
    for (k, at, _), spans in zip(where, field.decode([texts[k][s:e] for k, s, e in where]), strict=True):
        for kind, start, end, score in spans:
            if score >= MARGIN and not any(s < at + end and e > at + start for _, s, e in base[k]):
                out[k].append((kind, at + start, at + end, score))
    return out


RESULT = "doc_id long, found array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])


def find_personal(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = SAMPLE) -> DataFrame:
    """Per row all spans, by kind as in ``KINDS``, then start; the score is null for spans of the fixed patterns."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text, size))

    def scan(batches: Iterator[pa.RecordBatch]):
        field = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_matches(t) for t in texts]
            more = added(field, texts, base) if field else [[] for _ in texts]
            spans = [
                [dict(kind=KINDS[k], start=s, end=e, base=p is None, score=p) for k, s, e, p in sorted([(*x, None) for x in b] + m, key=lambda x: x[:3])]
                for b, m in zip(base, more, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "found"])

    return docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(scan, RESULT)
