"""Words of many texts at once, as numpy arrays: places, 64-bit hashes, rolling hashes of runs of words."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shifts and odd multiplications)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_INVERSE = _U(pow(int(_ODD), -1, 1 << 64))


#: The longest tables of powers made so far in this process.
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd number and of its inverse modulo 2**64."""
    if _POWERS[0].size < n:
        size = ((n >> 18) + 1) << 18
        for i, base in enumerate((_ODD, _INVERSE)):
            own = np.full(size, base)
            own[0] = 1
            _POWERS[i] = np.cumprod(own)
    return _POWERS[0][:n], _POWERS[1][:n]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[s:e] for each span: equal spans have equal hashes wherever they lie."""
    up, down = powers(values.size + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Words:
    """The words of some texts: ``data`` has each text's words joined by one space and texts by a line feed."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        split = [(t.encode().lower() if lower else t.encode()).split() if t else [] for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.data = b"\n".join([b" ".join(w) for w in split if w])
        raw = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero((raw == 32) | (raw == 10))
        full = raw.size > 0
        self.starts = np.concatenate([[0], gaps + 1]) if full else np.zeros(0, np.int64)
        self.ends = np.append(gaps, raw.size) if full else np.zeros(0, np.int64)
        #: Place of each text's first word, and the end.
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.hashes = spans(_BYTE[raw], self.starts, self.ends) if full else np.zeros(0, np.uint64)


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n neighbouring words; the array is n - 1 shorter (texts' borders are the caller's)."""
    size = max(0, hashes.size - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out += hashes[j : j + size] * powers(n)[0][j]
    return mix(out)


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n neighbouring values, by doubling."""
    width, out = 1, values
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: values.size - n + 1], out[n - width : values.size - width + 1]) if width < n else out
