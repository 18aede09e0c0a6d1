"""Words of many texts as 64-bit hashes, computed over whole byte arrays.

Words are maximal runs of bytes other than ASCII white space; A-Z count as a-z. A word's hash depends on its bytes only, so it is the
same in every task. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _MULT), ("down", _INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = _U(1)
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and the byte offsets of their starts and ends (exclusive)."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64), start, end
    return span_hashes(raw, start, end), start, end


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span [start, end); A-Z count as a-z."""
    up, down = _powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (empty when there are fewer)."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * _MULT + words[k : len(words) - n + 1 + k]
    return mix(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; fewer words count as one shingle, no words give none."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    if len(words) < n:
        return ngrams(words, len(words)) ^ _U(len(words))
    return np.unique(ngrams(words, n))


def per_text(texts: list[str | None], block_bytes: int = 4_000_000):
    """Yields (index, word hashes, starts, ends) of each text; short texts are hashed together, block by block."""
    first, parts, size = 0, [], 0

    def flush(first: int, parts: list[bytes]):
        hashes, start, end = words_of(b"\n".join(parts))
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        begin = np.concatenate(([0], np.cumsum(lengths + 1)))
        cut = np.searchsorted(start, begin)
        for i in range(len(parts)):
            a, b = cut[i], cut[i + 1]
            yield first + i, hashes[a:b], start[a:b] - begin[i], end[a:b] - begin[i]

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if parts and size + len(data) > block_bytes:
            yield from flush(first, parts)
            first, parts, size = i, [], 0
        parts.append(data)
        size += len(data) + 1
    if parts:
        yield from flush(first, parts)


def gram_at(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch [start, end) of words."""
    up, down = _powers(len(words) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * up[: len(words)])))
    return mix((total[end] - total[start]) * down[start])
