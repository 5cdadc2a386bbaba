"""Word shingles of whole texts as sets of 64-bit hashes, computed over Arrow buffers with numpy."""

from __future__ import annotations

import numpy as np

from .common import mix64

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_CHUNK = 1 << 18
#: Bytes at so many first places of a word have their codes in a table.
_NEAR = 64


def _code(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit code of each byte at its place in the word. Codes of different places have nothing in common, so sums of them tell words
    apart whatever pattern their letters form (as powers of one base don't: those cancel in Thue-Morse words)."""
    return mix64((place.astype(np.uint64) * np.uint64(256) + byte + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def _tables():
    word = np.ones(256, bool)
    word[list(SEPARATORS)] = False
    lower = np.arange(256, dtype=np.int64)
    lower[ord("A") : ord("Z") + 1] += 32  # lower-cases A-Z
    near = _code(np.tile(np.arange(256, dtype=np.uint64), _NEAR), np.repeat(np.arange(_NEAR), 256))
    return word, lower, near


_WORD, _LOWER, _NEAR_CODES = _tables()


def _cuts(data: np.ndarray, offsets: np.ndarray):
    """Ranges of about _CHUNK bytes that end at the end of a text or, in long texts, after a separator."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + _CHUNK, end)
        if to < end:
            k = int(np.searchsorted(offsets, to, side="right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:
                limit = int(offsets[k + 1])
                while to < limit:
                    gap = np.flatnonzero(~_WORD[data[to : min(to + _CHUNK, limit)]])
                    if len(gap):
                        to += int(gap[0]) + 1
                        break
                    to = min(to + _CHUNK, limit)
        yield at, to
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin (n + 1 positions)."""
    hashes, begins = [], [np.zeros(0, np.int64)]
    for lo, hi in _cuts(data, offsets):
        b = data[lo:hi]
        m = hi - lo
        word = _WORD[b]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        first[inner] = word[inner]
        last = np.empty(m, bool)
        last[-1] = word[-1]
        last[:-1] = word[:-1] & (~word[1:] | first[1:])
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        start = np.zeros(m, np.int64)
        start[s] = s
        place = np.arange(m) - np.maximum.accumulate(start)
        byte = _LOWER[b]
        codes = _NEAR_CODES[np.minimum(place, _NEAR - 1) * 256 + byte]
        far = np.flatnonzero(place >= _NEAR)
        codes[far] = _code(byte[far].astype(np.uint64), place[far])
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(codes, out=total[1:])
        hashes.append(mix64(total[e] - total[s] + (e - s).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
        begins.append(s + lo)
    begin = np.concatenate(begins)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(begin, offsets)


def _coefficients(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """Yields for each text the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence; without words, none."""
    words, at = word_hashes(data, offsets)
    by = _coefficients(n)
    count = max(0, len(words) - n + 1)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total += words[i : i + count] * by[i]
    total = mix64(total)
    for d in range(len(offsets) - 1):
        lo, hi = at[d], at[d + 1]
        if hi - lo >= n:
            x = np.sort(total[lo : hi - n + 1])
            if len(x) > 1:
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
            yield x
        elif hi > lo:
            few = (words[lo:hi] * by[: hi - lo]).sum(dtype=np.uint64, keepdims=True)
            yield mix64(few + np.array([int(hi - lo) * 0xE7037ED1A0B428DB & (1 << 64) - 1], np.uint64))
        else:
            yield total[:0]
