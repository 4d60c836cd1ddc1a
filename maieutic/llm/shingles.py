"""Words, hashed word runs, and fast similarity sketches, for a whole batch of texts at once."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"\w+")
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_known: dict[str, int] = {}
_KNOWN_MOST = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def words(text: str | None) -> list[str]:
    """The longest runs of letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def word_hashes(tokens: list[str]) -> list[int]:
    if len(_known) > _KNOWN_MOST:
        _known.clear()
    out = []
    for w in tokens:
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return out


def flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and where each text begins; one more entry for the end."""
    hashes: list[int] = []
    starts = [0]
    for t in texts:
        hashes += word_hashes(words(t))
        starts.append(len(hashes))
    return np.array(hashes, dtype=np.uint64), np.array(starts, dtype=np.int64)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive entries; runs may cross from one text into the next."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * _ODD + hashes[i : i + n]
        h ^= h >> np.uint64(29)
    return mix(h)


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set of hashed k-word runs of each text: owners (text numbers, ascending), hashes (ascending in each text), sizes."""
    hashes, starts = flat(texts)
    lengths = np.maximum(np.diff(starts) - k + 1, 0)
    owner = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[:-1], lengths)
    h = runs(hashes, k)[at] if len(at) else np.zeros(0, dtype=np.uint64)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[first], h[first]
    return owner, h, np.bincount(owner, minlength=len(texts))


def fast_similarity_sketch(owner: np.ndarray, h: np.ndarray, n: int, t: int) -> np.ndarray:
    """The n sketches of t coordinates of the sets given as in shingle_sets; EMPTY throughout for an empty set.

    Rounds of hashed bin placement (Dahlgaard, Knudsen and Thorup): in round i < t each
    element falls into one hashed bin, in round i >= t every element falls into bin
    i - t, so that after 2t rounds at the latest all bins of a set that is not empty
    are filled. A bin keeps the least value of the earliest round that reached it. Two
    sets agree in a coordinate with a probability equal to their Jaccard similarity,
    with concentration as of t independent samples; sets of t or more elements take
    O(size + t log t) steps. Only sets that still have an empty bin go on to a round.
    """
    sketch = np.full(n * t, EMPTY, dtype=np.uint64)
    live_owner, live_h = owner, h
    for i in range(2 * t):
        if not len(live_h):
            break
        r = mix(live_h + np.uint64((i + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        bins = (r >> np.uint64(40)).astype(np.int64) % t if i < t else np.int64(i - t)
        at = live_owner * t + bins
        value = (r & np.uint64((1 << 40) - 1)) | np.uint64(i << 40)
        np.minimum.at(sketch, at, value)
        if i % 4 == 3 or i >= t:
            full = (sketch.reshape(n, t) != EMPTY).all(axis=1)
            keep = ~full[live_owner]
            live_owner, live_h = live_owner[keep], live_h[keep]
    # Placement in a later round never lowers a bin that an earlier round filled, as the round is the leading part of a value.
    return mix(np.where(sketch == EMPTY, EMPTY, sketch)).reshape(n, t) if n else sketch.reshape(0, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of so many coordinates, different for different bands."""
    n, t = sketch.shape
    bands = t // rows
    part = sketch[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for j in range(rows):
        key = mix(key * _ODD + part[:, :, j])
    return key
