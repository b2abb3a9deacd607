"""Word shingles as 64-bit hashes, computed on whole batches of texts with numpy."""

from __future__ import annotations

import functools

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random weights of the 256 bytes, powers of the base and of its inverse modulo 2**64."""
    weights = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    powers = np.full(_SEGMENT + 1, _BASE, dtype=np.uint64)
    inverse = np.full(_SEGMENT + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    powers[0] = inverse[0] = 1
    return weights, np.cumprod(powers), np.cumprod(inverse)


def _segment_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of at most ``_SEGMENT`` bytes."""
    weights, powers, inverse = _tables()
    word = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weights[data] * powers[: len(data)], dtype=np.uint64)))
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts (bytes) and hashes of all words ``[^\\x20\\x09-\\x0D]+``; memory is bounded by segments cut at white space."""
    array = np.frombuffer(data, np.uint8)
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(array):
        end = min(len(array), at + _SEGMENT)
        if end < len(array):
            gaps = np.flatnonzero(_SPACE[array[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a segment: hash of its parts
                while end < len(array) and not _SPACE[array[end]]:
                    end += 1
                value = np.array([end - at], dtype=np.uint64)
                for k in range(at, end, _SEGMENT):
                    value = mix(_segment_hashes(array[k:min(end, k + _SEGMENT)])[1] ^ (value * np.uint64(_BASE)))
                starts.append(np.array([at]))
                hashes.append(value)
                at = end
                continue
        s, h = _segment_hashes(array[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct ``size``-word shingles, A-Z in lower case. Fewer words: the whole
    sequence as one shingle; no word: empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    starts, words = word_hashes(b"\n".join(raw))
    begin = np.cumsum([0, *[len(r) + 1 for r in raw]])
    cut = np.searchsorted(starts, begin)
    with np.errstate(over="ignore"):
        count = max(0, len(words) - size + 1)
        joined = np.zeros(count, np.uint64)
        for k in range(size):
            joined = joined * np.uint64(0xD6E8FEB86659FD93) + words[k:k + count]
        joined = mix(joined)
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(joined[a:b - size + 1]))
            elif b > a:
                value = np.uint64(b - a)
                for w in words[a:b]:
                    value = value * np.uint64(0xA0761D6478BD642F) + w
                out.append(mix(np.array([value], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
