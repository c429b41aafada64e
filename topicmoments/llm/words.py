"""Words of whole texts as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SEED = 20240229
#: Bytes that part words: space, and tab to carriage return.
BLANKS = (0x20, *range(0x09, 0x0E))


def byte_class(inside: bool, *bounds: tuple[int, int]) -> np.ndarray:
    """256 flags: the bytes of the given ranges, or all others."""
    flags = np.zeros(256, dtype=bool)
    for low, high in bounds:
        flags[low:high + 1] = True
    return flags if inside else ~flags


NOT_BLANK = byte_class(False, (0x20, 0x20), (0x09, 0x0D))
#: Digits, letters of any case and every byte of a character beyond ASCII.
LETTERS_DIGITS = byte_class(False, (0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


class Words(NamedTuple):
    """Where words begin and end in the bytes, their hashes, and each text's first word (and the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordReader:
    """Finds words made of a class of bytes and hashes them with A-Z lowered (or as they are).

    A word's hash is a polynomial in random numbers for its bytes, taken from running sums, so
    the time does not depend on the number of words.
    """

    def __init__(self, inside: np.ndarray, lower: bool = True) -> None:
        rng = np.random.default_rng(SEED)
        self.inside = inside
        values = rng.integers(1, 2**63, 256, dtype=np.uint64)
        if lower:
            values[0x41:0x5B] = values[0x61:0x7B]
        self.values = values
        self.base = np.uint64(int(rng.integers(1, 2**62)) * 4 + 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        self.powers = np.cumprod(np.full(size, self.base, dtype=np.uint64))
        self.backs = np.cumprod(np.full(size, self.inverse, dtype=np.uint64))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        if len(data) > len(self.powers):
            self._grow(max(len(data), 2 * len(self.powers)))
        inside = self.inside[data]
        # the first and last byte of each text that has any
        filled = offsets[:-1] < offsets[1:]
        begins, lasts = offsets[:-1][filled], offsets[1:][filled] - 1
        left = np.empty(len(data), dtype=bool)
        left[:1] = False
        left[1:] = inside[:-1]
        left[begins] = False
        starts = np.flatnonzero(inside & ~left)
        right = np.empty(len(data), dtype=bool)
        right[-1:] = False
        right[:-1] = inside[1:]
        right[lasts] = False
        ends = np.flatnonzero(inside & ~right) + 1
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.powers[:len(data)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.backs[starts] if len(starts) else np.zeros(0, np.uint64))
        return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for every run of `length` hashes, at the place where the run begins."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, dtype=np.uint64)
    odd = np.random.default_rng(SEED + length).integers(1, 2**62, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(length):
        out += hashes[k:k + n] * odd[k]
    return mixed(out)


def row_of(firsts: np.ndarray) -> np.ndarray:
    """For every word, the text it belongs to."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
