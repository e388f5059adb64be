"""SetSketch registers of hashed sets and the joint likelihood estimate of their similarity.

Register i holds floor(1 - log_b(x)) of the smallest x that any element draws from the i-th
exponential distribution, truncated to 16 bits. Sketches of parts merge by the larger register.
"""

import numpy as np

from corpusctx.llm.shingles import mix

REGISTERS = 256
BASE = 1.001
RATE = 20.0
BAND_WIDTH = 5
LARGEST = (1 << 16) - 1
_FACTORS = (mix(np.arange(REGISTERS, dtype=np.uint64), 0xFAC7) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ROWS = 512


def registers(elements, sizes):
    """uint16 matrix, one sketch per set; empty sets have registers 0."""
    short = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full((len(sizes), REGISTERS), LARGEST << 16 | LARGEST, np.uint32)
    at = 0
    for row, n in enumerate(sizes.tolist()):
        for a in range(at, at + n, _ROWS):
            drawn = np.multiply.outer(short[a : min(a + _ROWS, at + n)], _FACTORS)
            np.minimum(least[row], drawn.min(axis=0), out=least[row])
        at += n
    uniform = (least + 0.5) / 2.0**32
    level = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    level = np.clip(level, 0, LARGEST).astype(np.uint16)
    level[sizes == 0] = 0
    return level


def merge(a, b):
    """Sketch of the union."""
    return np.maximum(a, b)


def band_keys(sketches, width=BAND_WIDTH):
    """One 64-bit key per band of ``width`` registers; the band's number is part of the key."""
    bands = REGISTERS // width
    parts = sketches[:, : bands * width].reshape(len(sketches), bands, width).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64), 0xBA9D), parts.shape[:2]).copy()
    for k in range(width):
        keys = mix(keys ^ parts[:, :, k]) + np.uint64(k)
    return keys.view(np.int64)


def similarity(a, b, size_a, size_b, steps=24):
    """Most likely Jaccard similarity of pairs of sketches whose set sizes are known.

    The counts of larger, smaller and equal registers are multinomial with probabilities that
    depend on the similarity alone; the log-likelihood is concave and searched by golden section.
    """
    more = (a > b).sum(axis=1)
    less = (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        return more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + same * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        x, y = high - golden * (high - low), low + golden * (high - low)
        left = log_likelihood(x) > log_likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2
