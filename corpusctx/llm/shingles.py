"""Hashed word shingles of texts, computed for many texts at once on their bytes."""

import numpy as np

SLICE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h, salt=0):
    """Spread the bits of unsigned 64-bit numbers (in a new array)."""
    h = h ^ np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base, n):
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """64-bit hashes of the words of texts; keeps its tables of powers between calls."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def hashes(self, data):
        """Hash and first byte of each word of ``data``: a run of bytes that are no ASCII blanks."""
        word = ~_BLANK[data]
        edge = np.diff(np.concatenate([[False], word, [False]]).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return np.zeros(0, np.uint64), starts
        return self.spans(data, starts, ends), starts

    def spans(self, data, starts, ends):
        """Hash of each given stretch of ``data``, the same wherever it stands."""
        n = len(data)
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * self.up[:n], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def of_texts(self, data, offsets):
        """Word hashes of all texts, and how many each has. Words never join texts: a text ends them."""
        hashes, counts = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a <= SLICE:
                own = self.hashes(data[a:b])[0]
            else:  # a long text goes by in pieces that end at blanks
                parts = []
                while a < b:
                    stop = min(a + SLICE, b)
                    while stop < b and not _BLANK[data[stop]]:
                        blank = np.flatnonzero(_BLANK[data[stop : stop + SLICE]])
                        stop = min(stop + (int(blank[0]) if len(blank) else SLICE), b)
                    parts.append(self.hashes(data[a:stop])[0])
                    a = stop
                own = np.concatenate(parts)
            hashes.append(own)
            counts.append(len(own))
        return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(counts, np.int64)


def shingle_sets(words, data, offsets, size):
    """Sorted distinct shingle hashes of each text, end to end, and how many each has.

    A text with fewer than ``size`` words has its whole word sequence as its one shingle; a
    text without words has none.
    """
    hashes, counts = words.of_texts(data, offsets)
    factors = mix(np.arange(size, dtype=np.uint64), 0x5EED) | np.uint64(1)
    sets, sizes, at = [], [], 0
    for n in counts.tolist():
        own = hashes[at : at + n]
        at += n
        width = min(size, n)
        if not n:
            sizes.append(0)
            continue
        total = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            total += own[k : n - width + 1 + k] * factors[k]
        total = mix(total)
        total.sort()
        total = total[np.concatenate([[True], total[1:] != total[:-1]])]
        sets.append(total)
        sizes.append(len(total))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array(sizes, np.int64)
