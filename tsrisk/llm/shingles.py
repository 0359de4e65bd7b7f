"""Word shingles of texts as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

from tsrisk.llm.common import LOWER

WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: One odd multiplier for each place in a shingle.
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, polynomials of their bytes, and the number of words of each text."""
    joined = b" " + b" ".join([t or b"" for t in texts]) + b" "
    raw = np.frombuffer(joined.translate(LOWER), np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    size = end - begin
    first = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        power = np.ones(int(size.max(initial=1)), np.uint64)
        power[1:] = _BASE
        power = np.cumprod(power)
        letters = raw[~space].astype(np.uint64) + np.uint64(1)
        letters *= power[np.arange(len(letters)) - np.repeat(first, size)]
        sums = np.add.reduceat(letters, first) if len(size) else np.zeros(0, np.uint64)
        hashes = mix(sums + size.astype(np.uint64))
    lengths = np.array([len(t or b"") for t in texts], np.int64)
    at = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    return hashes, np.searchsorted(begin, at + lengths) - np.searchsorted(begin, at)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a text of fewer words is one shingle, one without words none."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, n - WORDS + 1), np.uint64)
        for k in range(WORDS):
            runs += hashes[k : n - WORDS + 1 + k] * _PLACE[k] if len(runs) else runs
        runs = mix(runs)
    out, at = [], 0
    for count in counts.tolist():
        if count >= WORDS:
            out.append(np.unique(runs[at : at + count - WORDS + 1]))
        elif count:
            with np.errstate(over="ignore"):
                short = (hashes[at : at + count] * _PLACE[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out
