"""Token ids of a byte-level BPE vocabulary for whole slices of text at once.

The vocabulary's split pattern is applied as array operations on character classes; each distinct piece is encoded once
per worker and kept, so most of the work is one lookup per piece. Texts with an apostrophe before one of the pattern's
contraction letters are encoded one by one. Texts are first cut at the literals of the file's added tokens, which get
their ids, as the tokenizer does by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken

from tallyground.llm import textkit as tk

# Fixed value: the split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space in Unicode.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)
# Pieces that a worker keeps at most; beyond that it starts anew.
KEPT = 1_000_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[SPACES] = SPACE
    return table


def _byte_of() -> dict[str, int]:
    """The printable stand-ins by which the vocabulary file writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in plain}
    return stand_in | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path, added=True)


class Encoder:
    """``added``: whether the literals of added tokens stand for these, or are text like any other."""

    def __init__(self, path: str, added: bool = False):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        if model["type"] != "BPE":
            raise ValueError(f"{path} is no byte-level BPE vocabulary")
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        special = {token for token in model["vocab"] if token.startswith("<|")}
        ranks = {b: i for b, i in ranks.items() if b.decode("utf-8", "replace") not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {t["content"].encode(): t["id"] for t in whole.get("added_tokens", [])} if added else {}
        if added and any(t.get(k) for t in whole.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has added tokens that take blanks or words around them into account")
        self.literal = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        whole = data.tobytes()
        texts = [whole[s:e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = [self.encoding.encode_ordinary(t) for t in texts]  # the batch call costs a thread hand-over per text
        if len(self.keys) + len(keys) > KEPT:
            self._forget()
        count = np.fromiter(map(len, found), np.int64, len(found))
        begin = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32, int(count.sum()))])
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.keys = every[order]
        self.begin, self.count = np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]

    def _places(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, place, -1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        whole = data.tobytes()
        if not any(t in whole for t in self.added):
            return self._plain(data, offsets)
        begin, end, mark, after, doc = [], [], [], [], []  # the texts between literals, and after which of them a literal comes
        for k, (at, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for m in self.literal.finditer(whole, at, stop):
                mark.append(self.added[m[0]])
                after.append(len(begin))
                begin.append(at)
                end.append(m.start())
                doc.append(k)
                at = m.end()
            begin.append(at)
            end.append(stop)
            doc.append(k)
        size = np.array(end) - np.array(begin)
        ids, n = self._plain(data[tk.expand(np.array(begin), size)], np.concatenate([[0], np.cumsum(size)]))
        ids = np.insert(ids, np.cumsum(n)[after], np.array(mark, np.int32))
        n[after] += 1
        return ids, np.bincount(doc, n, minlength=len(offsets) - 1).astype(np.int64)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        edge = np.searchsorted(at, offsets)
        starts, odd = _piece_starts(points, edge)
        first = at[starts]
        last = np.concatenate([first[1:], [len(data)]])
        doc = np.searchsorted(offsets, first, "right") - 1
        if odd.any():
            keep = ~odd[doc]
            first, last, doc = first[keep], last[keep], doc[keep]
        keys = tk.SpanHash(tk.BYTE_CODES[data])(first, last)
        coded = pa.array(keys).dictionary_encode()  # a hash table; sorting the pieces would cost several times as much
        unique, back = np.asarray(coded.dictionary), np.asarray(coded.indices)
        places = self._places(unique)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            known = len(self.keys) + len(missing) <= KEPT
            new = missing if known else np.arange(len(unique))
            where = np.empty(len(unique), np.int64)
            where[back] = np.arange(len(back))
            self._learn(data, unique[new], first[where[new]], last[where[new]])
            places = self._places(unique)
        place = places[back]
        count = self.count[place]
        ids = self.ids[tk.expand(self.begin[place], count)]
        per_doc = np.bincount(doc, count, minlength=n).astype(np.int64)
        if not odd.any():
            return ids, per_doc
        plain = np.split(ids, np.cumsum(per_doc)[:-1])
        whole = data.tobytes()
        for k in np.flatnonzero(odd).tolist():
            plain[k] = np.array(self.encoding.encode_ordinary(whole[offsets[k] : offsets[k + 1]].decode("utf-8")), np.int32)
        return np.concatenate(plain), np.fromiter(map(len, plain), np.int64, n)


def _piece_starts(points: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pattern's pieces begin, in code points, and which texts hold a contraction."""
    kind = classes()[points]
    size = len(points)
    opens = np.zeros(size + 1, bool)  # a text begins here
    opens[edge] = True
    start = opens[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last white space before something else leaves its run; a blank joins what follows, others stand alone.
    final = np.zeros(size, bool)
    final[:-1] = space[:-1] & ~space[1:] & ~opens[1:size]
    start |= final
    joins = final & (points == 32)
    start[1:] &= ~joins[:-1]
    mark = np.flatnonzero(points[:-1] == 39)
    mark = mark[np.isin(points[mark + 1], [ord(c) for c in "strvmld"]) & ~opens[mark + 1]]
    odd = np.zeros(len(edge) - 1, bool)
    odd[np.searchsorted(edge, mark, "right") - 1] = True
    return np.flatnonzero(start), odd
