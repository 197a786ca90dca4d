"""Vectorised tokenising and hashing of text batches.

Texts of an Arrow batch are joined into one byte buffer and handled by numpy as a
whole.  Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D`` after lower-casing
A-Z, which is what ``bytes.lower().split()`` gives; every byte of a multi-byte UTF-8
character is 0x80 or more, so cutting bytes is the same as cutting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: bytes of text handled at once; a longer single text is handled alone
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_pow_cache: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _pow_cache.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * BLOCK_BYTES:
            _pow_cache[name] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a block of texts.

    ``buf`` the lower-cased bytes, ``start``/``end`` byte ranges, ``hash`` 64-bit word
    hashes, ``first`` index of each text's first word (length texts + 1).
    """

    def __init__(self, texts: list[bytes], lower: bool = True, hashes: bool = True, space: np.ndarray = _SPACE):
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.lower()
        self.buf = np.frombuffer(joined, np.uint8)
        gap = space[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.text_at = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, self.text_at)
        self._sums = None
        if hashes:
            self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte range, the same wherever it stands."""
        with np.errstate(over="ignore"):
            if self._sums is None:
                terms = _BYTE_CODE[self.buf] * _powers(_BASE, len(self.buf), "up")
                self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            raw = (self._sums[end] - self._sums[start]) * _powers(_BASE_INV, len(self.buf) + 1, "down")[start]
        return mix(raw + (end - start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) of groups of about ``limit`` bytes; null is empty."""
    at, size, group = 0, 0, []
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        if group and size + len(raw) > limit:
            yield at, group
            at, size, group = i, 0, []
        group.append(raw)
        size += len(raw)
    if group:
        yield at, group


def word_hash(word: str) -> int:
    """The hash that ``Words`` gives to one (lower-cased) word."""
    return int(Words([word.encode()]).hash[0])


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; of the whole sequence if it is shorter; none of nothing."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = mix(out ^ h[i : i + n], i + 1) if i else mix(h[:n], 1)
    return out
