"""Word shingles and MinHash signatures of UTF-8 texts, a block of texts at a time."""

from __future__ import annotations

import numpy as np

from docmill.llm.common import U, constants, mix, range_hashes, windows

#: Words of a shingle.
WORDS = 5

#: Bytes of plain words: digits, letters and all that is not ASCII.
_PLAIN = np.array([chr(b).isalnum() or b > 127 for b in range(256)])
_POWER = [np.ones(1, U)]


def powers(n: int) -> np.ndarray:
    """The first n powers of a fixed odd number."""
    if len(_POWER[0]) < n:
        size = max(n, 1024)
        out = np.full(size, 0x9E3779B97F4A7C15 | 1, U)
        out[0] = 1
        _POWER[0] = np.cumprod(out)
    return _POWER[0][:n]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def word_hashes(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, how many each text has, and where words begin and end.

    A word is a run of bytes other than blank and 0x09 to 0x0D; A-Z count as a-z.
    plain: punctuation ends words too.
    """
    low = lower_ascii(data)
    if plain:  # the accented capitals of Latin-1 too: 0xC3 0x80 to 0x9E, but the times sign
        wide = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        low[wide] += np.uint8(32)
    h, begin, end = words_in(low, windows(low), offsets[:-1], plain)
    return h, np.diff(np.searchsorted(begin, offsets)), begin, end


def words_in(low: np.ndarray, eight: np.ndarray, starts: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each word. low: lower-case bytes, eight: their windows(), starts: where a word cannot run on."""
    if not len(low):
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none
    solid = _PLAIN[low] if plain else ~((low == 32) | ((low >= 9) & (low <= 13)))
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = starts[starts < len(low)]
    opens[inner] = solid[inner]
    begin = np.flatnonzero(opens)
    shut = np.empty(len(low), bool)
    shut[:-1] = solid[:-1] & (~solid[1:] | opens[1:])
    shut[-1] = solid[-1]
    end = np.flatnonzero(shut) + 1
    return range_hashes(eight, begin, end), begin, end


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and how many each text has.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    odd = constants(7, size)
    short = (counts > 0) & (counts < size)
    total = np.maximum(counts - size + 1, 0) + short
    first = np.cumsum(counts) - counts
    at = np.cumsum(total) - total
    if not total.sum():
        return np.zeros(0, U), total
    start = np.repeat(first - at, total) + np.arange(int(total.sum()))
    out = np.zeros(len(start), U)
    padded = np.append(words, np.zeros(size, U))
    for j in range(size):
        out += padded[start + j] * odd[j]
    for i in np.flatnonzero(short):
        own = words[first[i] : first[i] + counts[i]]
        out[at[i]] = np.sum(own * odd[: len(own)], dtype=U) ^ U(len(own) * 0xE7037ED1A0B428DB % 2**64)
    return mix(out), total


def _sort_each(h: np.ndarray, counts: np.ndarray) -> None:
    """Sorts each run of `counts` hashes in place; many short sorts beat one sort with owners."""
    ends = np.cumsum(counts)
    some = counts > 1
    for a, b in zip((ends - counts)[some].tolist(), ends[some].tolist(), strict=True):
        h[a:b].sort()


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, and how many there are."""
    h = hashes.copy()
    _sort_each(h, counts)
    new = np.ones(len(h) + 1, bool)
    new[1:-1] = h[1:] != h[:-1]
    new[np.cumsum(counts) - counts] = True
    new = new[:-1]
    return h[new], np.diff(np.concatenate(([0], np.cumsum(new)))[np.concatenate(([0], np.cumsum(counts)))])


def signatures(hashes: np.ndarray, counts: np.ndarray, size: int, seed: int = 11, step: int = 1 << 16) -> np.ndarray:
    """MinHash: per text `size` minima of independently permuted hashes, each cut to 16 bits.

    Texts without hashes get zeros. Hashes may repeat within a text.
    """
    n = len(counts)
    out = np.zeros((n, size), np.uint16)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    factors = constants(seed, size).astype(np.uint32) | np.uint32(1)
    low, high = hashes.astype(np.uint32), (hashes >> U(32)).astype(np.uint32)
    at = (np.cumsum(counts) - counts)[full]
    least = np.full((len(full), size), 0xFFFFFFFF, np.uint32)
    # Blocks small enough for the processor's cache; a text may run over several.
    for a in range(0, len(low), step):
        b = min(a + step, len(low))
        i, j = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b, "left")
        cuts = np.maximum(at[i:j], a) - a
        v, y = low[a:b].copy(), high[a:b]
        for k in range(size):  # linear functions of both halves of the hash, each from the one before
            v *= factors[k]
            v += y
            m = np.minimum.reduceat(v, cuts)
            np.minimum(least[i:j, k], m, out=least[i:j, k])
    out[full] = ((least ^ (least >> np.uint32(16))) & np.uint32(0xFFFF)).astype(np.uint16)
    return out


def common(h1: np.ndarray, n1: np.ndarray, h2: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """How many hashes the k-th sets of two lists of distinct() sets have in common."""
    counts = n1 + n2
    at = np.cumsum(counts) - counts
    h = np.empty(len(h1) + len(h2), U)
    h[np.repeat(at - (np.cumsum(n1) - n1), n1) + np.arange(len(h1))] = h1
    h[np.repeat(at + n1 - (np.cumsum(n2) - n2), n2) + np.arange(len(h2))] = h2
    _sort_each(h, counts)
    again = np.zeros(len(h) + 1, bool)
    again[1:-1] = h[1:] == h[:-1]
    again[at] = False
    return np.diff(np.concatenate(([0], np.cumsum(again[:-1])))[np.append(at, len(h))])
