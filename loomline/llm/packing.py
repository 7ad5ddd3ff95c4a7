"""Packing token streams into fixed-length sequences by dynamic programming.

Documents keep their order. Each partition is one stream of token ids; windows
of at most ``length`` tokens are cut at document ends, sentence ends or, inside a
sentence of over ``grid`` tokens, every ``grid`` tokens. The cuts minimise

    sum of padding + ``sentence_cost`` or ``hard_cost`` for each cut inside a document

over all cuts of a chunk. The best predecessor of a cut is the smallest value of
cost + position in the window behind it, which a monotone queue yields in
amortised constant time. The last window of a chunk is left open and begins the
next chunk, so only the end of a partition can be short; that rest is cut into
powers of two, which need no padding.

No shuffle: a stream is an input partition, whose rows are the same on a retry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches
from ._tokens import WordTokens, segments
from ._words import STEP, batches

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_LOADED: dict[str, WordTokens] = {}


def cuts(at: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Indices into ``at`` (ascending, from 0) of the cheapest cuts, first and last included.

    Neighbouring positions are at most ``length`` apart. A window from i to j costs
    its padding ``length - (at[j] - at[i])`` and, at its end, ``cost[j]``; the last
    window stays open and costs nothing.
    """
    pos, pen = at.tolist(), cost.tolist()
    best, back = [0] * len(pos), [0] * len(pos)
    queue, value, head = [0], [pos[0]], 0
    for j in range(1, len(pos)):
        p = pos[j]
        low = p - length
        while pos[queue[head]] < low:
            head += 1
        back[j] = queue[head]
        best[j] = f = value[head] + length - p + pen[j]
        f += p
        while len(value) > head and value[-1] >= f:
            value.pop()
            queue.pop()
        value.append(f)
        queue.append(j)
        if head > 8192:
            del queue[:head], value[:head]
            head = 0
    last = len(pos) - 1
    open_from = next(i for i, p in enumerate(pos) if p >= pos[last] - length)
    back[last] = min(range(open_from, max(last, open_from + 1)), key=best.__getitem__)
    out = [last]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


class _Stream:
    """Token ids waiting to be cut: whole documents behind an open window."""

    def __init__(self, length: int, grid: int, sentence_cost: int, hard_cost: int, first_id: int):
        self.length, self.grid, self.costs, self.next_id = length, grid, (sentence_cost, hard_cost), first_id
        self.ids = np.empty(0, np.int32)
        self.marks = np.empty(0, np.int64)  # sentence ends
        self.docs: list[tuple] = []  # (id, tokens, begin in the stream); the first may begin before it
        self.parts: list[np.ndarray] = []
        self.new_marks: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, ids: np.ndarray, marks: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), self.size))
        self.parts.append(ids)
        self.new_marks.append(marks + self.size)
        self.size += len(ids)

    def cut(self, last: bool) -> Iterator[tuple]:
        if not self.size:
            return
        self.ids = np.concatenate([self.ids, *self.parts])
        self.marks = np.concatenate([self.marks, *self.new_marks])
        self.parts, self.new_marks = [], []
        ends = np.fromiter((b + n for _, n, b in self.docs), np.int64, len(self.docs))
        firm = np.unique(np.concatenate([[0], self.marks, ends]))
        firm = firm[firm >= 0]
        gap = np.diff(firm)
        wide = np.flatnonzero(gap > self.grid)
        extra = [np.arange(firm[i] + self.grid, firm[i + 1], self.grid) for i in wide.tolist()]
        at = np.unique(np.concatenate([firm, *extra]))
        cost = np.full(len(at), self.costs[1])
        cost[np.searchsorted(at, firm)] = self.costs[0]
        cost[np.searchsorted(at, ends)] = 0
        cost[0] = 0
        windows = [int(at[i]) for i in cuts(at, cost, self.length)]
        if last:
            rest, begin = windows[-1] - windows[-2], windows[-2]
            while rest:
                take = 1 << (rest.bit_length() - 1)
                begin, rest = begin + take, rest - take
                if rest:
                    windows.insert(-1, begin)
        else:
            windows.pop()
        yield from self._pieces(windows)
        done = windows[-1]
        self.ids = self.ids[done:]
        self.marks = self.marks[self.marks > done] - done
        self.docs = [(d, n, b - done) for d, n, b in self.docs if b + n > done]
        self.size -= done

    def _pieces(self, windows: list[int]) -> Iterator[tuple]:
        k = 0
        for a, b in zip(windows[:-1], windows[1:], strict=True):
            while k < len(self.docs) and self.docs[k][2] < b:
                doc_id, n, begin = self.docs[k]
                lo, hi = max(a, begin), min(b, begin + n)
                if hi > lo:
                    yield doc_id, lo - begin, hi - lo, self.ids[lo:hi].astype("<u4").tobytes(), n, self.next_id, lo - a
                if begin + n > b:
                    break
                k += 1
            self.next_id += 1


def _encoded(tokens: WordTokens, texts: list, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, sentence ends) of each text; long texts are encoded in parts."""
    for lo, hi in batches(texts):
        if hi - lo == 1 and texts[lo] and len(texts[lo]) > 4 * STEP:
            ids = np.concatenate([tokens.texts([s])[0] for s in segments(texts[lo], STEP)])
            sizes = np.array([len(ids)])
        else:
            ids, sizes = tokens.texts(texts[lo:hi])
        at = 0
        for n in sizes.tolist():
            own = np.append(ids[at : at + n], np.int32(end_id))
            yield own, np.flatnonzero(tokens.enders[own[:-1]]) + 1
            at += n


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 4096,
    end_id: int = 2,
    grid: int = 64,
    sentence_cost: int = 4,
    hard_cost: int = 48,
    chunk_tokens: int = 1 << 18,
) -> DataFrame:
    """One row per piece of a document: ``PIECES``; ``ids`` are little-endian unsigned 32-bit token ids.

    A sequence is the pieces of one ``sequence_id`` in the order of ``offset``,
    padded to ``length`` unless its tokens are a power of two. Ids run from
    2**32 times the partition's number.

    Null or empty text: the end token only. Repeated rows and ids: each row is
    packed on its own. Very long texts: encoded in parts and cut like others.
    Empty table: no rows. Columns beside id and text are not read.
    ``chunk_tokens`` is how many tokens one run of the programme holds in memory.
    """
    small_batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = _LOADED.get(tokenizer) or _LOADED.setdefault(tokenizer, WordTokens(tokenizer))
        stream = _Stream(length, grid, sentence_cost, hard_cost, TaskContext.get().partitionId() << 32)

        def out(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for doc_id, (own, marks) in zip(ids, _encoded(tokens, texts, end_id), strict=True):
                stream.add(doc_id, own, marks)
                if stream.size >= chunk_tokens and (rows := list(stream.cut(False))):
                    yield out(rows)
        if rows := list(stream.cut(True)):
            yield out(rows)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
