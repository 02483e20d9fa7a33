"""Whole columns of text as byte vectors: words, lines and their hashes, without a Python loop over words.

A word is a run of bytes outside 0x20 and 0x09-0x0D; as UTF-8 never holds those bytes inside a character,
this equals ``[^\\x20\\x09-\\x0D]+`` over characters. Memory is some fifty bytes for a byte of the slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are hashed as polynomials modulo a prime (so that no structure of the text makes them meet, as it does modulo
#: a power of two), under two bases for a hash. Lanes have bases of their own: hashes of two lanes are independent.
PRIME = (1 << 31) - 1
BASES = ((1_779_033_703, 1_013_904_242), (1_359_893_119, 528_734_635))
#: Bytes whose terms are summed at once, below 2^61, and a multiple of the modulus above such sums.
CHUNK, ABOVE = 1 << 22, PRIME << 31
#: Odd base of the rolling hash modulo 2^64, which chooses places and never tells texts apart.
BASE = 0x9E3779B97F4A7C15 | 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for any 64-bit x."""
    x = _fold(_fold(x))
    # below the modulus, x less the modulus is a very large number
    return np.minimum(x, x - np.uint64(PRIME))


def _fold(x: np.ndarray) -> np.ndarray:
    """A number below 2^34 that equals any 64-bit x modulo PRIME, below 2^31 + 2^n for x below 2^(31 + n)."""
    high = x >> np.uint64(31)
    high += x & np.uint64(PRIME)
    return high


def powers(base: int, n: int, modulus: int = PRIME) -> np.ndarray:
    """base^i for i below n at least, modulo PRIME or 2^64; a worker keeps the tables."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, 1 << 19) * 5 // 4
        if modulus == PRIME:
            table, have, step = np.ones(size, np.uint64), 1, base
            while have < size:
                more = min(have, size - have)
                table[have : have + more] = _reduce(table[:more] * np.uint64(step))
                have, step = have + more, step * step % PRIME
            table = table.astype(np.uint32)
        else:
            table = np.full(size, base, np.uint64)
            table[0] = 1
            table = np.cumprod(table, dtype=np.uint64)
        _powers[base] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n + 1 offsets of the texts; a null counts as empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at offsets."""
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each word's text."""
    starts, ends = spans(~_SPACE[raw], offsets)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (texts are split at \\n; an empty text is one line), and their texts."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    doc = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
    end_doc = np.concatenate([doc[len(offsets) - 1 :], np.arange(len(offsets) - 1)])
    by_start, by_end = np.lexsort((starts, doc)), np.lexsort((ends, end_doc))
    return starts[by_start], ends[by_end], doc[by_start]


class Prefixes:
    """Prefix sums of a byte vector, from which any range of it has a hash of 62 bits that its bytes alone decide."""

    def __init__(self, raw: np.ndarray, lane: int = 0) -> None:
        self.bases = BASES[lane]
        self.sums = [np.zeros(len(raw) + 1, np.uint64) for _ in self.bases]
        for begin in range(0, len(raw), CHUNK):
            part = raw[begin : begin + CHUNK].astype(np.uint64)
            part += np.uint64(1)
            for base, sums in zip(self.bases, self.sums, strict=True):
                out = sums[begin + 1 : begin + 1 + len(part)]
                np.multiply(part, powers(base, len(raw) + 1)[begin : begin + len(part)], out=out)
                np.cumsum(out, out=out)
                if begin:
                    out += np.uint64(int(sums[begin]) % PRIME)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each range, spread over 64 bits."""
        halves = []
        for base, sums in zip(self.bases, self.sums, strict=True):
            back = powers(pow(base, -1, PRIME), len(sums))
            # a multiple of the modulus above all sums keeps the difference positive
            value = sums[ends]
            value += np.uint64(ABOVE)
            value -= sums[starts]
            halves.append(_reduce(_fold(value) * back[starts]))
        return mix(halves[0] << np.uint64(31) | halves[1])


def rolling(raw: np.ndarray, width: int) -> np.ndarray:
    """A quick hash of every string of ``width`` bytes. Different strings may meet: it only chooses places."""
    up = powers(BASE, len(raw) + 1, 0)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    back = powers(pow(BASE, -1, 1 << 64), len(raw) + 1, 0)
    return mix((sums[width:] - sums[:-width]) * back[: len(sums) - width])


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    return Prefixes(raw, lane).ranges(starts, ends)


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def strings(values) -> pa.Array:
    return pa.array(values, pa.string())
