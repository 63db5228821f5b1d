"""Hashes of the words and word shingles of whole Arrow batches, by numpy.

A word is a run of bytes other than space and 0x09-0x0D; its hash is a polynomial over its
bytes modulo 2**64, taken from prefix sums, then mixed. Equal on every machine and run.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit."""
    out = h >> np.uint64(33)  # one array of its own, changed in place
    out ^= h
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(33)
    return out


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        m = max(n, _CHUNK + 1)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def _hash_span(data: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the words in ``data``; no word crosses an offset in ``inner``."""
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edge = solid[1:] != solid[:-1]
    starts, ends = solid[1:] & edge, edge & solid[:-1]
    cut = inner[(inner > 0) & (inner < len(data))]
    both = cut[solid[cut] & solid[cut + 1]]  # a word would run over from one text to the next
    starts[both] = True
    ends[both] = True
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * down[s]), s, e


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, bounds): words of text i are hashes[bounds[i]:bounds[i+1]]."""
    out, counts, i = [], np.zeros(len(texts), np.int64), 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= _CHUNK):
            n += len(texts[j])
            j += 1
        if n > 2 * _CHUNK:  # one very long text: in pieces cut at white space
            at, t = 0, texts[i]
            while at < n:
                stop = min(n, at + _CHUNK)
                while stop < n and not _SPACE[t[stop]]:
                    stop += 1
                h, _, _ = _hash_span(np.frombuffer(t[at:stop], np.uint8), np.zeros(0, np.int64))
                out.append(h)
                counts[i] += len(h)
                at = stop
        elif n:
            offsets = np.cumsum([len(t) for t in texts[i:j]])
            h, s, _ = _hash_span(np.frombuffer(b"".join(texts[i:j]), np.uint8), offsets)
            out.append(h)
            counts[i:j] = np.bincount(np.searchsorted(offsets, s, side="right"), minlength=j - i)
        i = j
    return (
        np.concatenate(out) if out else np.zeros(0, np.uint64),
        np.concatenate([[0], np.cumsum(counts)]),
    )


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer words gives its whole sequence as one shingle; without words, none.
    """
    h, bounds = word_hashes(texts)
    n = max(0, len(h) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        m = np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        rolled += h[j : j + n] * m
    rolled = mix(rolled + np.uint64(k))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif b > a:
            v = np.array([b - a], np.uint64)
            for j in range(a, b):
                v = mix(v * np.uint64(3) + h[j : j + 1])
            out.append(v)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
