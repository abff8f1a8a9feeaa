"""Hashes of words and of runs of words, computed for a whole text at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
# fixed values: the six separators between words, as bytes of UTF-8
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (in place)."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def factors(n: int, salt: int = 0) -> np.ndarray:
    """n odd 64-bit factors; the first ones do not depend on n."""
    return mix((np.arange(n, dtype=_U) + _U(salt * 1_000_003 + 1)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_BY_PLACE = factors(64)


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash per word of a UTF-8 text, in order."""
    global _BY_PLACE
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, _U)
    lead = int(starts[0])
    place = np.arange(lead, len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    place[~inside[lead:]] = 0
    longest = int(place.max()) + 1
    if longest > len(_BY_PLACE):
        _BY_PLACE = factors(2 * longest)
    terms = (data[lead:].astype(_U) + _U(1)) * _BY_PLACE[place]
    terms *= inside[lead:]
    out = mix(np.add.reduceat(terms, starts - lead))
    if longest > 1 << 16:  # such a table is not kept
        _BY_PLACE = factors(64)
    return out


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; empty where there are fewer than k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    by = factors(k, salt=k)
    out = hashes[:n] * by[0]
    for j in range(1, k):
        out += hashes[j : j + n] * by[j]
    return mix(out)


def shingles(text: str, k: int) -> np.ndarray:
    """Hashes of all runs of k words, lower case; a shorter text is one run of all its words."""
    hashes = word_hashes(text.lower().encode("utf-8", "surrogatepass"))
    return runs(hashes, min(k, len(hashes))) if len(hashes) else hashes
