"""Monotone sequences in Elias-Fano form, read in place from mapped files.

A sequence keeps `low` low bits of each value packed one after the other, the high parts as a bitmap (bit high_i + i is
set) and the number of ones before each block of the bitmap. Value i is in the block that these numbers tell, a step or
three from its word, where the one is selected. Zeros tell where a high part's values start, so that a search halves a
few low parts. Nothing is decoded but what is asked for, and no gap or run of values makes a search longer.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np

from storyweft.llm.common import map_file, put_file

U = np.uint64
WORDS = 4  # of 64 bits in a block of the bitmap
FULL, NONE = U(0xFFFFFFFFFFFFFFFF), U(0)
ONES = U(0x0101010101010101)
HIGH = U(0x8080808080808080)
#: In row r, column b: the place of the r-th one of byte b.
PLACE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).T.copy()


def pack_bits(v: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bits each, one after the other, in 64-bit words (one word to spare)."""
    out = np.zeros(len(v) * width // 64 + 2, U)
    if not width or not len(v):
        return out
    at = np.arange(len(v), dtype=U) * U(width)
    word, shift = (at >> U(6)).astype(np.int64), at & U(63)
    np.bitwise_or.at(out, word, v << shift)
    over = shift + U(width) > U(64)
    np.bitwise_or.at(out, word[over] + 1, v[over] >> (U(64) - shift[over]))
    return out


def get_bits(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), U)
    at = index.astype(U) * U(width)
    word, shift = (at >> U(6)).astype(np.int64), at & U(63)
    v = words[word] >> shift
    over = np.flatnonzero(shift + U(width) > U(64))
    v[over] |= words[word[over] + 1] << (U(64) - shift[over])
    return v & U((1 << width) - 1)


def select_in_word(w: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th (from 0) one of each 64-bit word, which has that many."""
    per = np.bitwise_count(w.view(np.uint8)).view(U) * ONES  # byte k: ones in bytes 0 to k
    r = rank.astype(U)
    full = ((((r * ONES) | HIGH) - per) & HIGH) >> U(7)  # bytes that end before the wanted one
    byte = (full * ONES) >> U(56)
    before = np.where(byte > 0, (per >> ((byte - U(1)) & U(7)) * U(8)) & U(255), U(0))
    return (byte * U(8)).astype(np.int64) + PLACE[(r - before).astype(np.int64), ((w >> byte * U(8)) & U(255)).astype(np.int64)]


def select(bits: np.ndarray, before: np.ndarray, rank: np.ndarray, flip: np.uint64) -> np.ndarray:
    """Place of the rank-th one, or zero if flip is all ones; before: how many there are before each block."""
    block = np.searchsorted(before, rank, side="right") - 1
    rank = rank - before[block]
    word = block * WORDS
    w = bits[word] ^ flip
    n = np.bitwise_count(w).astype(np.int64)
    live = np.flatnonzero(n <= rank)
    while len(live):  # WORDS times at most
        rank[live] -= n[live]
        word[live] += 1
        w[live] = bits[word[live]] ^ flip
        n[live] = np.bitwise_count(w[live])
        live = live[n[live] <= rank[live]]
    return word * 64 + select_in_word(w, rank)


@dataclass
class EliasFano:
    n: int
    low: int
    top: int  # largest high part
    lows: np.ndarray
    bits: np.ndarray
    ones: np.ndarray  # before each block

    def __post_init__(self):
        self.zeros = np.arange(len(self.ones)) * (64 * WORDS) - self.ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values: non-decreasing and below universe."""
        n = len(values)
        low = max(0, int(math.floor(math.log2(universe / n)))) if n and universe > n else 0
        v = values.astype(U)
        ones = (v >> U(low)).astype(np.int64) + np.arange(n)
        span = 64 * WORDS
        bitmap = np.zeros(((int(ones[-1]) if n else 0) // span + 2) * span, np.uint8)  # a block of zeros at the end
        bitmap[ones] = 1
        bits = np.packbits(bitmap, bitorder="little").view(U)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).reshape(-1, WORDS).sum(axis=1, dtype=np.int64))[:-1]])
        return cls(n, low, int(ones[-1]) - n + 1 if n else -1, pack_bits(v & U((1 << low) - 1), low), bits, before)

    def access(self, index: np.ndarray) -> np.ndarray:
        """Values at the places in index."""
        high = (select(self.bits, self.ones, index, NONE) - index).astype(U)
        return (high << U(self.low)) | get_bits(self.lows, self.low, index)

    def find(self, start: np.ndarray, stop: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Successor search in the range of each target's context, start to stop: the target's place, -1 if missing.

        Short ranges are halved by their values. Of longer ones the part with the target's high bits is cut out, where
        low bits are halved alone.
        """
        found = np.full(len(targets), -1)
        size = stop - start
        own = np.flatnonzero((size > 0) & (size <= 4))
        found[own] = self._halve(start[own], stop[own], targets[own], self.access)
        high = (targets >> U(self.low)).astype(np.int64)
        own = np.flatnonzero((size > 4) & (high <= self.top))
        high = high[own]
        lo, hi = np.zeros(len(own), np.int64), select(self.bits, self.zeros, high, FULL) - high
        later = np.flatnonzero(high > 0)
        lo[later] = select(self.bits, self.zeros, high[later] - 1, FULL) - high[later] + 1
        lows = lambda index: get_bits(self.lows, self.low, index)
        found[own] = self._halve(np.maximum(lo, start[own]), np.minimum(hi, stop[own]), targets[own] & U((1 << self.low) - 1), lows)
        return found

    @staticmethod
    def _halve(start: np.ndarray, stop: np.ndarray, targets: np.ndarray, value) -> np.ndarray:
        lo, hi = start, stop.copy()
        live = np.flatnonzero(lo < hi)
        lo = lo.copy()
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = value(mid) < targets[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        near = np.flatnonzero(lo < stop)
        near = near[value(lo[near]) == targets[near]]
        found = np.full(len(targets), -1)
        found[near] = lo[near]
        return found

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        parts = {"meta": np.array([self.n, self.low, self.top]), "lows": self.lows, "bits": self.bits, "ones": self.ones}
        return {f"{name}.{k}": a for k, a in parts.items()}

    @classmethod
    def mapped(cls, file: dict[str, np.ndarray], name: str) -> EliasFano:
        return cls(*file[f"{name}.meta"].tolist(), *(file[f"{name}.{k}"] for k in ("lows", "bits", "ones")))


# Files of arrays ------------------------------------------------------------------------------------------------------


def put_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One flat file: the length of a JSON header, the header, then each array at a multiple of 8 bytes."""
    fields, at = [], 0
    for name, a in arrays.items():
        fields.append([name, a.dtype.str, at, len(a)])
        at += -(-a.nbytes // 8) * 8
    header = json.dumps(fields).encode()
    header += b" " * (-len(header) % 8)
    parts = (a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())
    put_file(uri, [np.array([len(header)], "<u8").tobytes(), header, *parts])


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a flat file as views of its mapping."""
    raw = map_file(uri, np.uint8)
    size = int(raw[:8].view("<u8")[0])
    body = raw[8 + size :]
    out = {}
    for name, dtype, at, n in json.loads(raw[8 : 8 + size].tobytes()):
        out[name] = body[at : at + n * np.dtype(dtype).itemsize].view(dtype)
    return out

