"""Words and word sequences of a batch of texts as 64-bit fingerprints, by numpy.

A word is a maximal run of bytes other than space and \\x09-\\x0D. A word of at
most seven bytes is its own fingerprint (its bytes and its length, mixed), one
of up to fifteen is mixed from two halves, a longer one is digested. Sequences
of words get theirs as differences of prefix sums of those of their words. Two
families with constants of their own stand beside each other where 64 bits do
not do.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
#: Of the two families: a key of the words, and the odd multiplier of their sequences.
KEYS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BASES = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
#: Bytes of a word that its own fingerprint holds, and those that two halves do.
SHORT, LONG = 7, 15

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the lowest bytes of a number.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=U)
        have[0] = 1
        have = _powers[base] = np.cumprod(have, dtype=U)
        if len(have) > 1 << 18:  # one very long text: not kept
            del _powers[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Prefix:
    """Prefix sums of values * base**index: the fingerprint of any range of them."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(values * powers(base, n), dtype=U, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(U) * U(0x8CB92BA72F3D8DD7))


@dataclass
class Words:
    data: np.ndarray  # the bytes of all texts
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # of each text, the number of its first word; one more at the end

    def prints(self, family: int = 0) -> np.ndarray:
        key = U(KEYS[family])
        size = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(16, dtype=np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        out = mix((eight[self.start] & _LOW_BYTES[np.minimum(size, SHORT)] | size.astype(U) << U(56)) ^ key)
        more = np.flatnonzero(size > SHORT)
        if len(more):
            n = size[more]
            rest = eight[self.start[more] + SHORT + 1] & _LOW_BYTES[np.clip(n - SHORT - 1, 0, SHORT)] | n.astype(U) << U(56)
            out[more] = mix(mix(eight[self.start[more]] + key) ^ rest * U(KEYS[1 - family]))
        far = np.flatnonzero(size > LONG)
        if len(far):
            raw = memoryview(self.data)
            digests = [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(self.start[far].tolist(), self.end[far].tolist())]
            out[far] = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)[:, family]
        return out

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each begins (one more at the end)."""
        size = self.end - self.start + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = np.append(self.data, np.uint8(0))[np.arange(begin[-1]) + np.repeat(self.start - begin[:-1], size)]
        flat[begin[1:] - 1] = 32
        return flat, begin


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more at the end). Null: empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, at = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # a text begins here
    cut[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return Words(data, starts, ends, np.searchsorted(starts, at))


def sequences(prints: np.ndarray, family: int = 0) -> Prefix:
    return Prefix(prints, BASES[family])
