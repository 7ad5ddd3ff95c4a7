"""Character bigrams as numbers: counting and substring search of a stated set of queries over all rows.

A set of at most ``SMALL`` grams is handed to every task, which then reads each text
once; a larger one is joined with the corpus by gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Grams of a query set that tasks are given; cells of a matrix of texts by grams; characters of known grams whose pairs make a table.
SMALL, CELLS, CHARS = 1 << 14, 1 << 21, 1 << 10


def codes(text: str) -> np.ndarray:
    """A number for each two neighbouring characters; of a single character its own. No two grams share one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c << 21 if len(c) < 2 else c[:-1] << 21 | c[1:] + 1


def gram(code: int) -> str:
    """The gram of a number."""
    second = code & ((1 << 21) - 1)
    return chr(code >> 21) + (chr(second - 1) if second else "")


def tallies(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the text, number of the gram, times) of the distinct grams of each text, by portions of some ``CELLS`` grams."""
    held, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        held.append(codes(t))
        size += len(held[-1])
        if size >= CELLS or i == len(texts) - 1 or i - lo == CELLS - 1:
            key, n = np.unique(np.repeat(np.arange(len(held)) << 42, [len(c) for c in held]) | np.concatenate(held), return_counts=True)
            yield lo + (key >> 42), key & ((1 << 42) - 1), n
            held, lo, size = [], i + 1, 0


def _texts(rows: DataFrame) -> DataFrame:
    """row_idx, text; null texts are empty. Tasks squeeze them by ``solid``."""
    return rows.select(F.col("row_idx").cast("long").alias("row_idx"), F.coalesce("text", F.lit("")).alias("text"))


def solid(texts: list[str]) -> list[str]:
    """``T.squeeze`` of texts: what Python splits at is ``T.SPACE_CHARS``. A pattern in Spark tries its ranges at every character."""
    return ["".join(t.split()) for t in texts]


def gram_table(rows: DataFrame) -> DataFrame:
    """gram, df (rows that hold it), tf (times in all), summed in each task before anything is moved."""

    def batch(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([gram(c) for c in held[0].tolist()], pa.string()), *map(pa.array, held[1:])], ["gram", "df", "tf"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for part in parts:
            for _, code, n in tallies(solid(part.column(0).to_pylist())):
                new = [code, np.ones(len(code), np.int64), n]
                both = [np.concatenate(x) for x in zip(held, new, strict=True)]
                order = np.argsort(both[0], kind="stable")
                both = [x[order] for x in both]
                cut = np.flatnonzero(np.diff(both[0], prepend=-1))
                held = [both[0][cut], *(np.add.reduceat(x, cut) if len(cut) else x for x in both[1:])]
                if len(held[0]) > CELLS:
                    yield batch(held)
                    held = [np.empty(0, np.int64)] * 3
        yield batch(held)

    found = _texts(rows).select("text").mapInArrow(run, "gram string, df long, tf long")
    return found.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def gram_sizes(rows: DataFrame) -> DataFrame:
    """row_idx, grams, distinct_grams of each row that has a gram; nothing is moved."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            all_, distinct = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for row, _, n in tallies(solid(part.column(1).to_pylist())):
                all_ += np.bincount(row, n, part.num_rows).astype(np.int64)
                distinct += np.bincount(row, minlength=part.num_rows)
            some = np.flatnonzero(all_)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(all_[some]), pa.array(distinct[some])], ["row_idx", "grams", "distinct_grams"])

    return _texts(rows).mapInArrow(run, "row_idx long, grams long, distinct_grams long")


def numbered(rows: DataFrame) -> bool:
    """Whether no two rows share a row_idx."""
    return rows.groupBy("row_idx").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def counts(texts: list[str], known: np.ndarray) -> np.ndarray:
    """matrix[i, j]: how often texts[i] holds the gram known[j]; ``known`` is sorted and not empty."""
    first, second = known >> 21, (known & ((1 << 21) - 1)) - 1
    chars = np.unique(np.concatenate([first, second[second >= 0]]))
    if len(chars) >= CHARS or chars[0] < 0:
        own = [codes(t) for t in texts]
        flat = np.concatenate(own)
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[at] == flat
        row, at = np.repeat(np.arange(len(texts)), [len(c) for c in own])[hit], at[hit]
    else:  # characters of known grams are numbered from 1, others are 0; a text's end has the last number
        number = np.zeros(int(chars[-1]) + 2, np.int32)
        number[chars] = np.arange(1, len(chars) + 1)
        end, width = len(chars) + 1, len(chars) + 2
        column = np.full(width * width, -1, np.int32)
        pair = np.flatnonzero(second >= 0)
        column[number[first[pair]] * width + number[second[pair]]] = pair
        size = np.array([len(t) for t in texts], np.int64) + 1
        flat = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = number[np.minimum(flat, len(number) - 1)]
        flat[np.cumsum(size) - 1] = end
        at = column[flat[:-1] * width + flat[1:]]
        hit = np.flatnonzero(at >= 0)
        row, at = np.repeat(np.arange(len(texts)), size)[hit], at[hit]
        single = {int(c): int(j) for j, c in zip(np.flatnonzero(second < 0), first[second < 0], strict=True)}
        alone = [(i, single[ord(t)]) for i, t in enumerate(texts) if len(t) == 1 and ord(t) in single] if single else []
        if alone:
            row, at = np.append(row, [i for i, _ in alone]), np.append(at, [j for _, j in alone])
    return np.bincount(row * len(known) + at, minlength=len(texts) * len(known)).reshape(len(texts), len(known))


def portions(part: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose matrix of counts stays small."""
    step = max(1, CELLS // max(1, width))
    for lo in range(0, part.num_rows, step):
        yield part.slice(lo, step)


def best(key: np.ndarray, order: list[np.ndarray], k: int | None) -> np.ndarray:
    """Places of the first ``k`` of each key by the columns of ``order``, the first of them deciding."""
    at = np.lexsort((*order[::-1], key))
    if k is None or not len(at):
        return at
    begin = np.flatnonzero(np.diff(key[at], prepend=key[at[0]] - 1))
    return at[np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at)))) < k]


def few(df: DataFrame, most: int = SMALL) -> list | None:
    """The rows of ``df``, or None if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def _pairs(needles: DataFrame) -> DataFrame:
    """qid, needle, gram: the needles' neighbouring characters that no white space parts."""
    words = needles.select("qid", "needle", F.explode(F.array_distinct(T.query_grams(F.col("needle")))).alias("gram"))
    return words.filter(F.length("gram") == 2)


def containing(rows: DataFrame, needles: DataFrame, k: int | None = None) -> DataFrame:
    """qid, row_idx, position (from 1): which texts of rows (row_idx, text) hold which needles (qid, needle) verbatim.

    Texts are first tested for the needles' grams. With ``k`` the rows are only those
    that can be among a needle's first k by position, then row_idx. An empty needle is
    in every text, none is in a null text.
    """
    needles = needles.select("qid", "needle").filter("needle is not null").distinct()
    asked = few(needles, SMALL // 8)
    wanted = None if asked is None else few(_pairs(needles))
    if wanted is None:
        return _joined(rows, needles)
    number = {(r.qid, r.needle): i for i, r in enumerate(asked)}
    pairs = [(number[r.qid, r.needle], int(codes(r.gram)[0])) for r in wanted]
    known = np.unique(np.array([c for _, c in pairs] or [-1], np.int64))
    holds = np.zeros((len(known), len(asked)), np.float32)
    holds[np.searchsorted(known, [c for _, c in pairs]), [q for q, _ in pairs]] = 1
    shared = rows.sparkSession.sparkContext.broadcast((known, holds, [r.needle for r in asked]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, holds, texts = shared.value
        need = holds.sum(0)
        held = [np.empty(0, np.int64)] * 3
        for whole in parts:
            for part in portions(whole, len(known)):
                ids, raw = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist()
                there = (counts(solid([t or "" for t in raw]), known) > 0).astype(np.float32)
                i, q = np.nonzero(there @ holds >= need)
                place = np.array([(raw[a] or "").find(texts[b]) if raw[a] is not None else -1 for a, b in zip(i.tolist(), q.tolist(), strict=True)], np.int64)
                found = place >= 0
                new = [q[found], ids[i[found]], place[found] + 1]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
                held = [x[best(held[0], [held[2], held[1]], k)] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], ["_q", "row_idx", "position"])

    seen = rows.select(F.col("row_idx").cast("long").alias("row_idx"), "text")
    return named(seen.mapInArrow(run, "_q long, row_idx long, position long"), asked, needles).select("qid", "row_idx", F.col("position").cast("int").alias("position"))


def named(found: DataFrame, asked: list, queries: DataFrame) -> DataFrame:
    """``found`` with the qid of the query number ``_q``."""
    kind = queries.schema["qid"].dataType.simpleString()
    names = found.sparkSession.createDataFrame([(i, r.qid) for i, r in enumerate(asked)], f"_q long, qid {kind}")
    return found.join(F.broadcast(names), "_q").drop("_q")


def _joined(rows: DataFrame, needles: DataFrame) -> DataFrame:
    """``containing`` of many needles: rows come from the postings of a needle's rarest gram."""
    pairs = _pairs(needles)
    grams = rows.select("row_idx", F.explode(F.array_distinct(T.char_ngrams(F.col("text")))).alias("gram"))
    postings = grams.join(pairs.select("gram").distinct(), "gram", "left_semi")
    df = postings.groupBy("gram").agg(F.count("*").alias("_df"))
    rarest = pairs.join(df, "gram", "left").groupBy("qid", "needle").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)), "gram"))["gram"].alias("gram"))
    some = rarest.join(postings, "gram").select("qid", "needle", "row_idx").join(rows.select("row_idx", "text"), "row_idx")
    # needles without a gram, such as single characters, can be in any text
    rest = needles.join(pairs.select("qid", "needle").distinct(), ["qid", "needle"], "left_anti").crossJoin(rows.select("row_idx", "text"))
    both = some.select("qid", "needle", "row_idx", "text").unionByName(rest.select("qid", "needle", "row_idx", "text"))
    return both.withColumn("position", F.expr("locate(needle, text)")).filter("position > 0").select("qid", "row_idx", "position")


def bm25_matrix(corpus: DataFrame, asked: list, pairs: list, k: int | None, settings: list[tuple[float, float]]) -> DataFrame:
    """_q, setting, row_idx, score of the queries ``asked``: the first k rows of each task by score.

    pairs: rows of (qid, gram, times); settings: (k1, b). One pass counts how many rows
    hold a gram and how long rows are, another scores.
    """
    number = {r.qid: i for i, r in enumerate(asked)}
    grams = sorted({r.gram for r in pairs}, key=lambda g: int(codes(g)[0])) or ["\x00\x00"]
    place = {g: i for i, g in enumerate(grams)}
    known = np.array([int(codes(g)[0]) for g in grams], np.int64)
    times = np.zeros((len(grams), len(asked)))
    for r in pairs:
        times[place[r.gram], number[r.qid]] += r.times
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast((known, times))
    rows = _texts(corpus)

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = shared.value
        df, total = np.zeros(len(known), np.int64), np.zeros(2, np.int64)
        for whole in parts:
            for part in portions(whole, len(known)):
                texts = solid(part.column(0).to_pylist())
                df += (counts(texts, known) > 0).sum(0)
                total += [len(texts), sum(len(t) if len(t) < 2 else len(t) - 1 for t in texts)]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([total, df[some]]))], ["at", "n"])

    found = rows.select("text").mapInArrow(tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # a row a gram
    df, total = np.zeros(len(known)), {-2: 0, -1: 0}
    for r in found:
        if r["at"] < 0:
            total[r["at"]] = r["n"]
        else:
            df[r["at"]] = r["n"]
    n, mean = total[-2], total[-1] / max(1, total[-2])
    idf = np.where(df > 0, np.log((n - df + 0.5) / np.maximum(df, 1) + 1.0), 0)
    weights = spark.sparkContext.broadcast(times * idf[:, None])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = shared.value[0], weights.value
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for whole in parts:
            for part in portions(whole, len(known)):
                ids, texts = part.column(0).to_numpy(zero_copy_only=False), solid(part.column(1).to_pylist())
                tf = counts(texts, known).astype(float)
                length = np.array([len(t) if len(t) < 2 else len(t) - 1 for t in texts], float)[:, None]
                for s, (k1, b) in enumerate(settings):
                    score = np.round((tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / max(mean, 1e-9)))) @ value, 6)
                    i, q = np.nonzero(((tf > 0).astype(np.float32) @ (value != 0).astype(np.float32)) > 0)
                    new = [q * len(settings) + s, ids[i], score[i, q]]
                    held = [np.concatenate(x) for x in zip(held, new, strict=True)]
                held = [x[best(held[0], [-held[2], held[1]], k)] for x in held]
        columns = [pa.array(held[0] // len(settings)), pa.array((held[0] % len(settings)).astype(np.int32)), pa.array(held[1]), pa.array(held[2])]
        yield pa.RecordBatch.from_arrays(columns, ["_q", "setting", "row_idx", "score"])

    return rows.mapInArrow(run, "_q long, setting int, row_idx long, score double")
