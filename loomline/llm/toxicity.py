"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their beginnings of 4 and 5 bytes, without closing
punctuation, A-Z lower-cased. The vocabulary holds every term of the examples, a
bounded sample of labelled documents, half of them with the label where there are so many; document frequencies are counted over all
documents. A term's weight is (1 + log tf) * idf * relevance: its relevance is
``FLOOR`` and the root of its log-likelihood ratio with the label for each labelled
document, so that no term is left out and those that go with the label, for it or
against it, decide what is near. A document's neighbours are the ``neighbours``
examples of largest cosine; votes weighted by cosine over distance give a raw
score, which a monotone step function fitted on left-out examples turns into a
probability. The neighbours' ids are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches, staged
from ._words import Words, batches

#: Bounds of the labelled rows that are learned from and of those that serve as examples.
SAMPLE_ROWS, MAX_EXAMPLES = 20_000, 1_024
#: Relevance of a term that says nothing of the label.
FLOOR = 0.02
_CLOSING = np.isin(np.arange(256), list(b".,;:!?\"')"))


def term_hashes(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(term hash, document) of every term occurrence, for batches of the texts."""
    for lo, hi in batches(texts):
        w = Words(texts[lo:hi])
        start, end, doc = w.start, w.end.copy(), w.doc
        for _ in range(3):
            end -= _CLOSING[w.data[end - 1]] & (end - start > 1)
        found = [(w.spans(start, end), doc + lo)]
        for n in (4, 5):
            longer = end - start > n
            s = start[longer]
            found.append((w.spans(s, s + n) ^ np.uint64(0xA5A5 + n), doc[longer] + lo))
        yield np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found])


def _known(h: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the hashes that the sorted vocabulary holds, their term numbers)."""
    at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
    hit = np.flatnonzero(vocabulary[at] == h) if len(vocabulary) else np.empty(0, np.int64)
    return hit, at[hit]


class BlockMaxIndex:
    """Postings by term over unit vectors, in blocks of examples with each term's largest weight per block.

    A cell is a term in a block; only cells with postings are held.
    """

    #: Blocks opened at first; places to which products are rounded before they are compared.
    FIRST, DIGITS = 4, 12

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = 64):
        self.n = len(vectors)
        self.blocks = -(-self.n // block)
        example = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in vectors])
        term = np.concatenate([np.empty(0, np.int32), *(t for t, _ in vectors)])
        weight = np.concatenate([np.empty(0), *(w for _, w in vectors)])
        order = np.lexsort((example, term))
        self.example, self.weight, term = example[order].astype(np.int32), weight[order], term[order]
        cell = term.astype(np.int64) * max(self.blocks, 1) + self.example // block
        begin = np.flatnonzero(np.diff(cell, prepend=-1))
        self.begin = np.append(begin, len(cell))
        self.block_of = (cell[begin] % max(self.blocks, 1)).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.empty(0)
        self.first_cell = np.searchsorted(term[begin], np.arange(terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive dot product, ties by number: (numbers, products). Exact.

        The blocks of largest bound are opened first; their k-th product then tells
        which others can hold an example as good, and those are opened together.
        """
        cell, held = _ranges(self.first_cell, terms)
        weight = np.repeat(weights, held)
        bound = np.bincount(self.block_of[cell], weight * self.most[cell], self.blocks)
        order = np.argsort(-bound, kind="stable")
        score = self._opened(cell, weight, order[: self.FIRST], skip)
        rest = order[self.FIRST :]
        if len(rest) and (score > 0).sum() >= k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            rest = rest[bound[rest] >= least - 10.0**-self.DIGITS]
        if len(rest):
            score = score + self._opened(cell, weight, rest, skip)
        number = np.flatnonzero(score > 0)
        number = number[np.argsort(-np.round(score[number], self.DIGITS), kind="stable")[:k]]
        return number, score[number]

    def _opened(self, cell: np.ndarray, weight: np.ndarray, blocks: np.ndarray, skip: int) -> np.ndarray:
        """Products of all examples, 0 outside the blocks."""
        wanted = np.zeros(self.blocks, bool)
        wanted[blocks] = True
        inside = wanted[self.block_of[cell]]
        posting, held = _ranges(self.begin, cell[inside])
        score = np.bincount(self.example[posting], np.repeat(weight[inside], held) * self.weight[posting], self.n)
        if skip >= 0:
            score[skip] = 0
        return score


def _ranges(begin: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places from begin[i] to begin[i + 1] of each item, how many each has)."""
    lo = begin[items]
    size = begin[items + 1] - lo
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum())), size


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted term hashes
    factor: np.ndarray  # idf * relevance of each term
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    neighbours: int
    base: float
    steps: tuple[np.ndarray, np.ndarray]  # raw scores from which on a probability holds

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts.astype(float))) * self.factor[terms]
        return w / np.linalg.norm(w)

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray]:
        """Share of the votes for the label, each weighted by cosine / distance; ``base`` counts as a faint vote."""
        n, s = self.index.search(terms, weights, self.neighbours, skip)
        w = s / np.maximum(1 - s, 0.05)
        return float((self.labels[n] @ w + 0.05 * self.base) / (w.sum() + 0.05)), n

    def probability(self, raw: float) -> float:
        return float(self.steps[1][max(np.searchsorted(self.steps[0], raw, "right") - 1, 0)])


def vectors_of(texts: list, vocabulary: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each text."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(texts)
    for h, doc in term_hashes(texts):
        hit, term = _known(h, vocabulary)
        if not len(hit):
            continue
        pair, count = np.unique(doc[hit] * (len(vocabulary) + 1) + term, return_counts=True)
        d, t = pair // (len(vocabulary) + 1), pair % (len(vocabulary) + 1)
        cut = np.flatnonzero(np.diff(d)) + 1
        for own, ts, cs in zip(d[np.concatenate([[0], cut])].tolist(), np.split(t, cut), np.split(count, cut), strict=True):
            found[own] = (ts, cs)
    return found


def _steps(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of label on raw score for rows that stand for ``weight`` rows, each pool shrunk by half a row of either label."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for x, y, w in zip(raw[order].tolist(), label[order].tolist(), weight[order].tolist(), strict=True):
        if pools and pools[-1][0] == x:
            pools[-1][1] += y * w
            pools[-1][2] += w
        else:
            pools.append([x, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, y2, n2 = pools.pop()
            pools[-1][1] += y2
            pools[-1][2] += n2
    value = [(y + 0.5) / (n + 1) for _, y, n in pools]
    return np.array([p[0] for p in pools]), np.maximum.accumulate(value)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    max_examples: int = MAX_EXAMPLES,
    neighbours: int = 10,
) -> Model | None:
    """Learns from ``labels`` (id_col, label_col 0/1; one of several labels of an id wins by being larger).

    ``sample_rows`` labelled rows at most, those of smallest hash, are read. Of these the
    first with the label, up to half of ``max_examples``, and the first without it, up
    to ``max_examples`` in all, are the examples; in the calibration each stands for as
    many rows of its label as there are for an example. Document frequencies are those
    of all ``docs``. Without labelled texts: None.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("long").alias("y"))
    marks = staged(marks.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "tox-marks")  # its bound: sample_rows rows of 16 bytes
    sample = staged(own.filter(F.length("text") > 0).join(F.broadcast(marks), "id"), "tox-sample")

    def examples(parts):
        for pdf in parts:
            found = [(np.empty(0, np.uint64), np.empty(0, np.int64))] * len(pdf)
            for h, doc in term_hashes(pdf["text"].tolist()):
                for i in np.unique(doc).tolist():
                    found[i] = np.unique(h[doc == i], return_counts=True)
            some = [len(t) > 0 for t, _ in found]
            yield pdf[["id", "y"]].assign(terms=[t.tobytes() for t, _ in found], counts=[c.astype(np.int32).tobytes() for _, c in found])[some]

    first = lambda y, most: sample.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
    marked = staged(first(1, max_examples // 2), "tox-examples")
    chosen = marked.unionByName(first(0, max_examples - marked.count()))
    kept = chosen.mapInPandas(examples, "id long, y long, terms binary, counts binary").toPandas()  # its bound: max_examples texts
    if not len(kept):
        return None
    terms = [np.frombuffer(t, np.uint64) for t in kept["terms"]]
    vocabulary = np.unique(np.concatenate(terms))
    shared = spark.sparkContext.broadcast(vocabulary)

    def counted(parts):
        n, pos, rows = np.zeros(len(shared.value), np.int64), np.zeros(len(shared.value), np.int64), [0, 0]
        for pdf in parts:
            rows[0] += len(pdf)
            rows[1] += int(pdf["y"].sum())
            for y, (t, _) in zip(pdf["y"].tolist(), vectors_of(pdf["text"].tolist(), shared.value), strict=True):
                n[t] += 1
                pos[t] += y
        seen = np.flatnonzero(n)
        yield pd.DataFrame({"term": [-1, *seen.tolist()], "n": [rows[0], *n[seen].tolist()], "pos": [rows[1], *pos[seen].tolist()]})

    def counts(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(rows with each term, of these those with the label), all rows in the last place."""
        found = df.mapInPandas(counted, "term long, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toPandas()
        out = np.zeros((2, len(vocabulary) + 1))
        out[:, found["term"].to_numpy()] = found[["n", "pos"]].to_numpy().T
        return out[0], out[1]

    df, _ = counts(own.withColumn("y", F.lit(0).cast("long")))
    n, pos = counts(sample.select("id", "text", "y"))
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    factor = idf * (FLOOR + np.sqrt(likelihood_ratio(n[:-1], pos[:-1], n[-1], pos[-1]) / n[-1]))
    # neighbours in the order of their strongest terms share blocks, which keeps the bounds sharp
    vectors = [(np.searchsorted(vocabulary, t), np.frombuffer(c, np.int32)) for t, c in zip(terms, kept["counts"], strict=True)]
    lead = [t[np.lexsort((t, -factor[t]))[:8]].tolist() for t, _ in vectors]
    order = sorted(range(len(kept)), key=lead.__getitem__)
    model = Model(vocabulary, factor, None, kept["id"].to_numpy()[order], kept["y"].to_numpy(float)[order], neighbours, pos[-1] / n[-1], None)
    del terms, kept, lead
    vectors = [(vectors[i][0].astype(np.int32), model.vector(*vectors[i])) for i in order]
    model.index = BlockMaxIndex(vectors, len(vocabulary))
    stands = np.where(model.labels == 1, pos[-1] / max(1, model.labels.sum()), (n[-1] - pos[-1]) / max(1, (1 - model.labels).sum()))
    model.steps = _steps(np.array([model.vote(t, w, skip=i)[0] for i, (t, w) in enumerate(vectors)]), model.labels, stands)
    return model


def likelihood_ratio(n: np.ndarray, pos: np.ndarray, rows: float, positive: float) -> np.ndarray:
    """Twice the log-likelihood ratio of each term's presence and the label; n of the rows have the term, pos of these the label."""
    out = np.zeros(len(n))
    for with_label, all_of in ((pos, positive), (n - pos, rows - positive)):
        for seen, share in ((with_label, n), (all_of - with_label, rows - n)):
            expected = share * all_of / rows
            out += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return np.maximum(2 * out, 0)


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``threshold``), evidence (ids of the neighbours, nearest first).

    Null and empty texts, and texts without a known term: the lowest score, no
    evidence. Of examples at one distance those first in the index count. Whole texts are read, however long. Repeated rows score alike; an
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(parts):
        m = shared.value
        for pdf in parts:
            texts = [t or "" for t in pdf["text"]]
            out, why = np.full(len(texts), m.steps[1][0] if m else 0.0), [[] for _ in texts]
            for i, (t, c) in enumerate(vectors_of(texts, m.vocabulary) if m and len(m.ids) else ()):
                if len(t):
                    raw, n = m.vote(t, m.vector(t, c.astype(float)))
                    out[i], why[i] = m.probability(raw), m.ids[n].tolist()
            yield pd.DataFrame({"doc_id": pdf["id"], "score": out, "predicted": (out >= threshold).astype(np.int32), "evidence": why})

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, "doc_id long, score double, predicted int, evidence array<long>")
