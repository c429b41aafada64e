"""Byte-pair merge tables of public tokenizers, applied to many sequences at once."""

from __future__ import annotations

import json

import numpy as np

NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte.

    Printable bytes stand for themselves; the others take the letters from 256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, free = [], 256
    for b in range(256):
        if b in plain:
            letters.append(chr(b))
        else:
            letters.append(chr(free))
            free += 1
    return letters


class MergeTable:
    """Merge ranks in an open hash table that is probed for whole arrays of pairs."""

    BITS = 19

    def __init__(self, state: dict[str, object]) -> None:
        self.__dict__.update(state)

    @classmethod
    def read(cls, path: str) -> MergeTable:
        """From a tokenizer file. Its state is made of plain values, so that it can be broadcast as such."""
        self = cls({})
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.symbols = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last_symbols = np.array([vocab[c + suffix] for c in letters], dtype=np.int32)
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self._fill(left << 20 | right)
        value = {c: b for b, c in enumerate(letters)}
        #: The bytes of each token, at its id.
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, at in vocab.items():
            if all(c in value for c in token):
                self.token_bytes[at] = bytes(value[c] for c in token)
        for token, at in self.special.items():
            self.token_bytes[at] = token.encode()
        return self

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> None:
        size = 1 << self.BITS
        self.keys = np.full(size, -1, dtype=np.int64)
        self.ranks = np.full(size, NONE, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[todo[free]]  # of several with one slot, the last stays
            won = self.keys[slot] == keys[todo]
            self.ranks[slot[won]] = todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & (size - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or NONE."""
        keys = left.astype(np.int64) << 20 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        again = np.flatnonzero((found != keys) & (found >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[again]]
            hit = found == keys[again]
            out[again[hit]] = self.ranks[slot[again[hit]]]
            again = again[~hit & (found >= 0)]
        return out


def merge_ragged(table: MergeTable, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all sequences to the end, in rounds; the symbols left and their counts.

    In a round every sequence merges all places of its own lowest-rank pair at once, from the left
    where places overlap. A token made by a merge takes part only in merges of higher rank, so this
    equals merging one place at a time. Sequences that are done leave the arrays.
    """
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    left_counts = np.zeros(n, dtype=np.int64)
    done_rows, done_symbols = [], []
    while len(symbols):
        rank = np.full(len(symbols), NONE, dtype=np.int32)
        inside = np.flatnonzero(row[:-1] == row[1:])
        rank[inside] = table.rank(symbols[inside], symbols[inside + 1])
        begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        sizes = np.diff(np.append(begins, len(row)))
        best = np.minimum.reduceat(rank, begins)
        over = np.repeat(best == NONE, sizes)
        if over.any():
            left_counts[row[begins[best == NONE]]] = sizes[best == NONE]
            done_rows.append(row[over])
            done_symbols.append(symbols[over])
        marks = np.flatnonzero((rank == np.repeat(best, sizes)) & ~over)
        if len(marks):
            # of places in unbroken succession, every other one
            fresh = np.concatenate(([True], np.diff(marks) > 1))
            since = marks - marks[fresh][np.cumsum(fresh) - 1]
            marks = marks[since % 2 == 0]
            symbols[marks] = table.merged[rank[marks]]
            over[marks + 1] = True
        symbols, row = symbols[~over], row[~over]
    if not done_rows:
        return np.zeros(0, np.int32), left_counts
    rows = np.concatenate(done_rows)
    return np.concatenate(done_symbols)[np.argsort(rows, kind="stable")], left_counts
