"""Fingerprints: FNV-1a, 64-bit simhash, SHA-256 and MD5 keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyweft.functions.text import let

#: Fixed values of FNV-1a 64: offset basis, prime.
FNV_BASIS = 14695981039346656037
FNV_PRIME = 1099511628211


def fnv1a64(word: Column) -> Column:
    """Signed 64-bit FNV-1a of the word's UTF-8. The product is taken in 32-bit halves: ANSI mode forbids overflow."""
    low32 = F.lit(0xFFFFFFFF)

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        lo, hi = x.bitwiseAND(low32), F.shiftrightunsigned(x, 32)
        part = lo * 435
        top = hi * 435 + F.shiftrightunsigned(part, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.shiftleft(top.bitwiseAND(low32), 32).bitwiseOR(part.bitwiseAND(low32))

    basis = F.lit(FNV_BASIS - (1 << 64)).cast("long")
    places = F.sequence(F.lit(1), F.greatest(F.octet_length(word), F.lit(1)))
    bytes_ = let(F.hex(F.encode(word, "UTF-8")), lambda h: F.transform(places, lambda i: F.conv(F.substr(h, i * 2 - 1, F.lit(2)), 16, 10).cast("long")))
    return F.when(F.octet_length(word) > 0, F.aggregate(bytes_, basis, step)).otherwise(basis)


def fnv_words(words: list[bytes]) -> np.ndarray:
    """FNV-1a of many words at once, byte place by byte place, longest words first."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-size, kind="stable")
    starts = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    h = np.full(len(words), FNV_BASIS, np.uint64)
    live = len(words)
    for place in range(int(size.max(initial=0))):
        while live and size[order[live - 1]] <= place:
            live -= 1
        own = order[:live]
        h[own] = (h[own] ^ flat[starts[own] + place]) * np.uint64(FNV_PRIME)
    return h


@F.pandas_udf(T.LongType())
def simhash64(words: pd.Series) -> pd.Series:
    """Signed 64-bit simhash of a token array, repeats counted; null without tokens. A bit is set if its sum is above 0."""
    sizes = np.array([0 if x is None else len(x) for x in words], np.int64)
    full = np.flatnonzero(sizes)
    out = np.full(len(words), None, object)
    if len(full):
        flat = np.concatenate([np.asarray(words.iloc[i], object) for i in full])
        some, back = np.unique(flat.astype(str), return_inverse=True)
        h = fnv_words([w.encode() for w in some.tolist()])[back]
        starts = np.cumsum(sizes[full]) - sizes[full]
        got = np.zeros(len(full), np.uint64)
        for bit in range(64):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
            got |= (2 * ones > sizes[full]).astype(np.uint64) << np.uint64(bit)
        out[full] = got.view(np.int64).tolist()
    return pd.Series(out, dtype="object")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_score(distance: Column) -> Column:
    return 1 - distance / 64


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("\n"), body), 256)


def short_id(x: Column) -> Column:
    """16 hex digits of the MD5."""
    return F.substring(F.md5(x), 1, 16)
