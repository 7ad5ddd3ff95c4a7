"""Cross-entropy difference: documents scored by two matched n-gram models.

A target model (texts labelled good) and a background model (all texts) share one
vocabulary, every word of the corpus and one unknown word. They are of one form, a
bigram estimate drawn towards the unigram one by ``PULL`` tokens, and matched in
size: background counts are scaled to the target's number of tokens, which is what a
sample of that size would hold on average. A document's own counts are left out of
both models. Its score is its mean loss per token under the target model less that
under the background model: the lower, the more it is like the target.

Counts of all words, first words and bigrams of the corpus are gathered, whatever
their number. Texts are read in batches of some ``TOKENS`` tokens, kept as word
numbers. A batch sends each distinct feature once, with its counts, to the bucket of
its hash; the bucket adds the batches up and answers each of them. So no feature's
frequency can make a hot key, and what is moved grows with the batches' distinct
features. Losses are added as whole numbers of 2**-30 bits, so that the order of
additions does not decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import IdFilter
from ._store import small_batches, staged
from ._tokens import segments
from ._words import BASE, STEP, Words, batches, mix

#: Tokens by which a bigram estimate is drawn towards the unigram one; share of a token that every word has in advance.
PULL, PRIOR = 4.0, 0.1
#: Tokens of a batch, features of a bucket.
TOKENS, FEATURES = 1 << 20, 1 << 20
UNIT = 1 << 30
_WORD, _FIRST = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_MARK = np.uint64(1 << 16)
_BATCH = "batch long, tokens long, counted long, good long, ids array<long>, marks binary, sizes binary, words binary, places binary"
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """An array of whole numbers, its bytes by place value, compressed; of ``rising`` unsigned ones the differences."""
    import zstandard

    values = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if rising else values


def word_hashes(texts: list) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order."""
    for lo, hi in batches(texts):
        if hi - lo == 1 and texts[lo] and len(texts[lo]) > 64 * STEP:
            yield np.concatenate([Words([piece]).hashes() for piece in segments(texts[lo], 16 * STEP)])
            continue
        w = Words(texts[lo:hi])
        yield from np.split(w.hashes(), np.cumsum(w.count)[:-1])


def _gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole texts: marks (1 counted, 2 good), numbers of words, distinct words, places of the words in these."""
    from pyspark import TaskContext

    names = [c.split()[0] for c in _BATCH.split(", ")]
    held: list[tuple] = []
    number = TaskContext.get().partitionId() << 32

    def out() -> pa.RecordBatch:
        ids, marks, hashes = zip(*held, strict=True)
        size, mark = np.array([len(h) for h in hashes], np.int64), np.array(marks, np.uint8)
        words, places = np.unique(np.concatenate(hashes), return_inverse=True)
        good = int(size[mark == 3].sum())
        row = [number, int(size.sum()), int(size[mark > 0].sum()), good, list(ids), mark.tobytes(), packed(size), packed(words, True), packed(places.astype(np.uint32))]
        held.clear()
        kinds = [*[pa.int64()] * 4, pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    n = 0
    for part in parts:
        ids, marks = part.column(0).to_pylist(), part.column(2).to_pylist()
        for i, m, h in zip(ids, marks, word_hashes(part.column(1).to_pylist()), strict=True):
            held.append((i, m, h))
            n += len(h)
            if n >= TOKENS or len(held) >= TOKENS >> 4:
                yield out()
                number, n = number + 1, 0
    if held:
        yield out()


@dataclass
class _Text:
    """A batch's tokens and their features; places are those in ``keys``, which are sorted."""

    place: np.ndarray  # of each token's word among the words
    doc: np.ndarray
    follows: np.ndarray  # whether a token has a word before it
    size: np.ndarray
    marks: np.ndarray
    keys: np.ndarray
    nb: np.ndarray
    nt: np.ndarray
    of_word: np.ndarray  # by word
    of_first: np.ndarray  # by word
    of_gram: np.ndarray  # by token that follows another

    @classmethod
    def of(cls, marks: bytes, sizes: bytes, words: bytes, places: bytes) -> _Text:
        mark, size = np.frombuffer(marks, np.uint8), unpacked(sizes, np.int64)
        word, place = unpacked(words, np.uint64, True), unpacked(places, np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        follows = np.ones(len(doc), bool)
        follows[(np.cumsum(size) - size)[size > 0]] = False
        second = np.flatnonzero(follows)
        with np.errstate(over="ignore"):
            gram = mix(word[place[second - 1]] * BASE + mix(word[place[second]])) & ~_MARK
        grams, of_gram = np.unique(gram, return_inverse=True)
        counted, good = mark[doc] > 0, mark[doc] == 3
        n, g = len(word), len(grams)
        sums = lambda which: np.concatenate([np.bincount(place, which, n), np.bincount(place[second - 1], which[second], n), np.bincount(of_gram, which[second], g)]).astype(np.int64)
        keys = np.concatenate([mix(word ^ _WORD) | _MARK, mix(word ^ _FIRST) & ~_MARK, grams])
        order = np.argsort(keys, kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        return cls(place, doc, follows, size, mark, keys[order], sums(counted)[order], sums(good)[order], at[:n], at[n : 2 * n], at[2 * n + of_gram])


def _asked(bits: int):
    """Each batch's features by bucket, the first ``bits`` bits of a key."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch, *blobs in zip(*(part.column(c).to_pylist() for c in ("batch", "marks", "sizes", "words", "places")), strict=True):
                t = _Text.of(*blobs)
                bucket = (t.keys >> np.uint64(32)) >> np.uint64(32 - bits)
                cut = np.flatnonzero(np.diff(bucket)) + 1
                rows = []
                for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
                    if lo < hi:
                        key = (t.keys[lo:hi] << np.uint64(bits)) >> np.uint64(16)
                        rows.append((batch, int(bucket[lo]), packed(key, True), packed(t.nb[lo:hi]), packed(t.nt[lo:hi])))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["batch", "bucket", "keys", "nb", "nt"])

    return run


def _answered(bits: int):
    """The corpus counts of a bucket's features, for each batch in its order, and how many distinct words there are."""
    mark = np.uint64(1 << bits)  # where a word's mark is in a stored key

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(data, np.uint64, True) for data in pdf["keys"]]
        known, at = np.unique(np.concatenate(parts), return_inverse=True)
        nb, nt = (np.bincount(at, np.concatenate([unpacked(x, np.int64) for x in pdf[c]]), len(known)).astype(np.int64) for c in ("nb", "nt"))
        cut = np.cumsum([len(p) for p in parts])[:-1]
        out = pdf[["batch", "bucket"]].assign(nb=[packed(nb[i]) for i in np.split(at, cut)], nt=[packed(nt[i]) for i in np.split(at, cut)], distinct=0)
        out.iloc[0, out.columns.get_loc("distinct")] = int(((nb > 0) & (known & mark != 0)).sum())
        return out

    return run


def losses(t: _Text, nb: np.ndarray, nt: np.ndarray, words: int, counted: int, good: int) -> tuple[np.ndarray, np.ndarray]:
    """(target, background) loss of each document, in units; ``nb``, ``nt``: corpus counts of its keys."""

    def own(at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """How often its document has a token's feature."""
        _, i, n = np.unique(doc * (len(t.keys) + 1) + at, return_inverse=True, return_counts=True)
        return n[i]

    second = np.flatnonzero(t.follows)
    word, first, gram = t.of_word[t.place], t.of_first[t.place[second - 1]], t.of_gram
    mine = [own(word, t.doc), own(first, t.doc[second]), own(gram, t.doc[second])]
    tokens_t = good - np.where(t.marks == 3, t.size, 0)
    tokens_b = counted - np.where(t.marks > 0, t.size, 0)
    scale = tokens_t / np.maximum(tokens_b, 1)
    out = []
    for count, inside, total, factor in ((nt, t.marks == 3, tokens_t, np.ones(len(t.size))), (nb, t.marks > 0, tokens_b, scale)):
        left = lambda at, m, d: (count[at] - np.where(inside[d], m, 0)) * factor[d]  # noqa: B023, E731
        d, e = t.doc, t.doc[second]
        p = (left(word, mine[0], d) + PRIOR) / (total[d] * factor[d] + PRIOR * (words + 1))
        p[second] = (left(gram, mine[2], e) + PULL * p[second]) / (left(first, mine[1], e) + PULL)
        units = np.round(-np.log2(p) * UNIT).astype(np.int64)
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(units)])
        end = np.cumsum(t.size)
        out.append(upto[end] - upto[end - t.size])
    return out[0], out[1]


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    others: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (their difference, bits per token).

    All ``docs`` train the background model, those with 1 in ``label_col`` of any of
    their ``labels`` the target model. With ``others`` these are scored in place of
    ``docs``. Null, empty and wordless texts: 0 tokens and null losses and score. Whole
    texts count, however long. Repeated rows are documents of their own and score
    alike; without good texts all scores are 0; an empty table gives no rows; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    good = staged(labels.filter(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("id"), F.lit(3).alias("mark")).distinct(), "lm-good")
    near = IdFilter(good, "id").mark(own, "id", "maybe")  # so that only texts that may be good are joined, by shuffles at every size
    rows = near.filter("not maybe").select("id", "text", F.lit(1).alias("mark"))
    rows = rows.unionByName(near.filter("maybe").join(good.hint("merge"), "id", "left").select("id", "text", F.coalesce("mark", F.lit(1)).alias("mark")))
    if others is not None:
        rows = rows.unionByName(others.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(0).alias("mark")))
    gathered = staged(rows.mapInArrow(_gathered, _BATCH), "lm-batches")
    tokens, counted, target = (n or 0 for n in gathered.agg(F.sum("tokens"), F.sum("counted"), F.sum("good")).first())
    bits = max(0, (tokens // FEATURES).bit_length())
    asked = gathered.select("batch", "marks", "sizes", "words", "places").mapInArrow(_asked(bits), "batch long, bucket long, keys binary, nb binary, nt binary")
    answers = asked.groupBy("bucket").applyInPandas(_answered(bits), "batch long, bucket long, nb binary, nt binary, distinct long")
    answers = staged(answers, "lm-answers")
    words = answers.agg(F.sum("distinct")).first()[0] or 0
    wanted = others is None

    def run(batch: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        found = []
        answer = answer.sort_values("bucket")
        for row in batch.itertuples():
            t = _Text.of(row.marks, row.sizes, row.words, row.places)
            nb, nt = (np.concatenate([np.empty(0, np.int64), *(unpacked(x, np.int64) for x in answer[c])]) for c in ("nb", "nt"))
            n = t.size.astype(float)
            n[n == 0] = np.nan
            lt, lb = (x / UNIT / n for x in losses(t, nb, nt, words, counted, target))
            ids = pd.Series(list(row.ids), dtype="Int64")
            out = pd.DataFrame({"doc_id": ids, "n_tokens": t.size, "target_loss": lt, "background_loss": lb, "score": lt - lb})
            found.append(out[(t.marks > 0) == wanted])
        return pd.concat(found) if found else pd.DataFrame(columns=[c.split()[0] for c in _SCORES.split(", ")])

    return gathered.groupBy("batch").cogroup(answers.drop("distinct").groupBy("batch")).applyInPandas(run, _SCORES)
