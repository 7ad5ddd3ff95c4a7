"""Vectorised word and shingle hashing over batches of texts.

A batch is one byte array; words are runs of bytes outside U+0020 and
U+0009-U+000D, which are ASCII and so never split a UTF-8 character. Hashes are
differences of a polynomial prefix sum modulo 2**64, one pass for a whole batch
however long its texts are, finished by a 64-bit mixer.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text handled in one vectorised step; bounds a worker's memory.
STEP = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(33))
    h = h * _M2
    return h ^ (h >> np.uint64(33))


_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INV = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if len(_POW[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, _INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


class Words:
    """Words of a batch of texts.

    ``doc``: the text of each word; ``start``/``end``: its bytes in ``data``,
    where any white space between words has become one blank; ``count``: words
    of each text; ``first``: index of each text's first word.
    """

    def __init__(self, texts: list, lower: bool = True):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        data = LOWER[data] if lower else data
        blank = SPACE[data]
        # keep word bytes and the blank that ends each word
        ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1 if len(data) > 1 else np.empty(0, np.int64)
        keep = ~blank
        keep[ends] = True
        place = np.cumsum(keep, dtype=np.int64)
        self.data = data[keep]
        self.end = place[ends] - 1
        self.data[self.end] = 0x20
        self.start = np.concatenate([[0], self.end[:-1] + 1]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
        stop = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        upto = np.searchsorted(ends, stop, "left") if len(ends) else np.zeros(len(raw), np.int64)
        self.count = np.diff(np.concatenate([[0], upto]))
        self.first = upto - self.count
        self.doc = np.repeat(np.arange(len(raw)), self.count)
        up, self._down = _powers(len(self.data) + 1)
        self._sum = np.zeros(len(self.data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sum[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of ``data``."""
        with np.errstate(over="ignore"):
            return mix((self._sum[end] - self._sum[start]) * self._down[start])

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of every shingle; a text of fewer words is one shingle, one without words has none."""
        n = np.where(self.count >= width, self.count - width + 1, np.minimum(self.count, 1))
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        first = self.first[doc] + at
        last = np.minimum(first + width, self.first[doc] + self.count[doc]) - 1
        return self.spans(self.start[first], self.end[last]), doc


def batches(texts: list) -> list[tuple[int, int]]:
    """Ranges of a batch that hold about STEP bytes each."""
    from ._store import slices

    return list(slices([len(t) if t else 0 for t in texts], STEP))
