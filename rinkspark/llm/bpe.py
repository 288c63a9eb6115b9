"""Byte-level BPE on ragged arrays: every pre-token of a batch takes its lowest-rank merge at once.

A vocabulary file is read, never trained. ``Bpe`` gives, for a text, the number of tokens or the
ids, as the library that the file belongs to gives them, special strings inside the text included.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

#: White space by Unicode's property of that name; Python's own ``\s`` has four more characters.
SPACE = "\t-\r \x85\xa0  -     　"
#: The contractions and the order of the pre-token pattern that such files are made with.
EXACT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: The same for texts without numerals outside the decimal digits, where ``re`` can tell letters apart.
FAST = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^{SPACE}\w]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
ODD_NUMERALS = np.array([unicodedata.category(chr(c)) in ("Nl", "No") for c in range(sys.maxunicode + 1)])
NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def looked_up(table: dict | ChainMap, found: list[str]) -> list:
    if isinstance(table, dict):
        return list(map(table.__getitem__, found))
    batch, known = table.maps
    return [batch[p] if p in batch else known[p] for p in found]


class Bpe:
    """``cache`` bounds the pre-tokens that one worker remembers; later ones are merged anew in each batch."""

    def __init__(self, path: str, cache: int = 600_000, window: int = 1 << 20, held: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.base = np.array([vocab[c] for c in byte_symbols()], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.bound, self.window, self.held = cache, window, held
        self.counts: dict[str, int] = {}
        self.packed: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.base[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        place = np.arange(len(symbols))
        done_at, done_id = [], []
        rank = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            rank[:-1] = np.where(owner[:-1] == owner[1:], self.ranks(symbols[:-1], symbols[1:]), NONE)
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.minimum.reduceat(rank, first)
            low = np.repeat(lowest, np.diff(first, append=len(owner)))
            idle = low == NONE
            if idle.any():  # those sequences are finished
                done_at.append(place[idle])
                done_id.append(symbols[idle])
                going = ~idle
                symbols, owner, place, rank, low = symbols[going], owner[going], place[going], rank[going], low[going]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == low)
            follows = np.diff(hit, prepend=-2) == 1  # "aaa": of touching hits every second one counts
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(hit))))
            hit = hit[run % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[hit] = True
            back = hit - 1
            back = np.where((back >= 0) & ~keep[back], back - 1, back)
            changed[back[back >= 0]] = True
            symbols, owner, place, rank, changed = symbols[keep], owner[keep], place[keep], rank[keep], changed[keep]
            at = np.flatnonzero(changed)
            right = np.minimum(at + 1, len(symbols) - 1)
            paired = (at + 1 < len(symbols)) & (owner[at] == owner[right])
            rank[at] = np.where(paired, self.ranks(symbols[at], symbols[right]), NONE)
        if not done_at:
            return np.zeros(0, np.int32), np.zeros(len(raw), np.int64)
        at, ids = np.concatenate(done_at), np.concatenate(done_id)
        order = np.argsort(at, kind="stable")
        began = np.concatenate([[0], np.cumsum(sizes)])
        return ids[order], np.diff(np.searchsorted(at[order], began))

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens in bounded runs; a long text is read window by window, cut only where it is settled."""
        odd = not text.isascii() and ODD_NUMERALS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any()
        find = EXACT.findall if odd else FAST.findall
        if len(text) <= self.window:
            yield find(text)
            return
        start, step = 0, self.window
        while start < len(text):
            found = find(text, start, start + step)
            if start + step < len(text):
                if len(found) <= 2:
                    step *= 2
                    continue
                found = found[:-2]
            yield found
            start, step = start + sum(map(len, found)), self.window

    def runs(self, text: str) -> Iterator[list[str] | int]:
        """Runs of pre-tokens, and the ids of special strings between them."""
        for part in self.split.split(text) if self.split and any(s in text for s in self.special) else [text]:
            if part in self.special:
                yield self.special[part]
            elif part:
                yield from self.pre_tokens(part)

    def learnt(self, found: list[str], known: dict) -> dict:
        """A table that holds all of ``found``: the worker's own, with this batch's rest on top if it is full."""
        missing = list(set(found).difference(known))
        if not missing:
            return known
        ids, sizes = self.merge(missing)
        if known is self.counts:
            more = zip(missing, sizes.tolist())
        else:
            whole, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            more = ((p, whole[e - 4 * n : e]) for p, n, e in zip(missing, sizes.tolist(), ends))
        if len(known) + len(missing) > self.bound:
            return ChainMap(dict(more), known)
        known.update(more)
        return known

    def counts_of(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Texts are gathered until their pre-tokens make a batch worth merging."""
        totals, held, spans = [0] * len(texts), [], []

        def settle() -> None:
            n = looked_up(self.learnt(held, self.counts), held)
            for k, a, b in spans:
                totals[k] += sum(n[a:b])
            held.clear()
            spans.clear()

        for k, text in enumerate(texts):
            for run in self.runs(text):
                if isinstance(run, int):
                    totals[k] += 1
                    continue
                spans.append((k, len(held), len(held) + len(run)))
                held.extend(run)
                if len(held) > self.held:
                    settle()
        settle()
        return totals

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        parts: list[list[bytes]] = [[] for _ in texts]
        held, spans = [], []

        def settle() -> None:
            ids = looked_up(self.learnt(held, self.packed), held)
            for part, a, b in spans:
                part.append(a if isinstance(a, bytes) else b"".join(ids[a:b]))
            held.clear()
            spans.clear()

        for part, text in zip(parts, texts):
            for run in self.runs(text):
                if isinstance(run, int):
                    spans.append((part, int(run).to_bytes(4, "little"), 0))
                    continue
                spans.append((part, len(held), len(held) + len(run)))
                held.extend(run)
                if len(held) > self.held:
                    settle()
        settle()
        return [b"".join(p) for p in parts]


@lru_cache(maxsize=2)
def bpe_of(path: str) -> Bpe:
    """One per worker process, so that its memory serves all tasks that the process runs."""
    return Bpe(path)
