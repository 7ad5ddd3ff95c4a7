"""Near-duplicate texts by HyperMinHash banding, confirmed on whole shingle sets.

Signature: one hash per shingle; its top bits choose one of ``REGISTERS`` buckets,
and of each bucket's smallest hash a register keeps the count of leading zeros (6
bits) and ten mantissa bits. Buckets that stay empty are filled from further rounds
of hashing, the last of them by a hash function of their own, so that a register of
two sets agrees with the chance of their Jaccard similarity, however small they are.

Equal sets are one class from the start. Bands of ``ROWS`` registers give bucket
keys; a pair of similarity 0.75 shares none of 32 bands with a chance of 5e-6.
Only connected components are asked for, so no bucket's pairs are all put out:

1. Each class is compared with the smallest class of the bucket it shares most often.
2. In buckets left with more than one component, signatures are compared between
   the largest component and the others and among these, in blocks; a task puts out
   a spanning forest of the components of likely pairs.
3. The groups so connected are compared in the same way by whole sets, every likely
   pair of different components, and a task puts out a spanning forest of the links.

A pair is likely unless its estimate, which is corrected for chance agreement, lies
``MARGIN`` below the threshold; only likely pairs are confirmed. The rule is the same for
buckets of every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import IdFilter, components
from ._store import small_batches, staged, unsent
from ._words import BASE, STEP, Words, batches, mix

WIDTH, REGISTERS, ROWS, MANTISSA = 5, 128, 4, 10
#: How far below the threshold an estimate may lie; 4.7 standard deviations at 128 registers.
MARGIN = 0.18
#: Most members and bytes on a side of a block of comparisons; pairs of sets formed at once.
BLOCK, BYTES, PAIRS = 1024, 4 << 20, 1 << 22
#: Rounds of hashing that may fill a register before it gets a hash function of its own.
ROUNDS = 8
_TOP = REGISTERS.bit_length() - 1
_EMPTY = np.uint64((1 << 64) - 1)
_SALT = mix(np.arange(1, ROUNDS + REGISTERS + 1, dtype=np.uint64) * BASE)
_SIGNATURE = "doc_id long, n_shingles long, digest binary, registers binary"


def shingle_sets(texts: list, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in batches(texts):
        if hi - lo == 1 and texts[lo] and len(texts[lo]) > 64 * STEP:
            yield _long_set(texts[lo], width)
            continue
        h, doc = Words(texts[lo:hi]).shingles(width)
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = np.sort(h[a:b])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def _long_set(text: str, width: int) -> np.ndarray:
    """A very long text's set, read in overlapping parts."""
    from ._tokens import segments

    parts, tail = [], []
    pieces = segments(text, 16 * STEP)
    for k, piece in enumerate(pieces):
        whole = " ".join([*tail, piece])
        w = Words([whole])
        n = int(w.count[0])
        if n >= width or k == len(pieces) - 1 and not parts:
            parts.append(np.unique(w.shingles(width)[0]))
        blob, at = w.data.tobytes(), range(max(0, n - width + 1), n)
        tail = [blob[w.start[i] : w.end[i]].decode("utf-8", "surrogatepass") for i in at]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """The signatures of sorted sets that are not empty, a row each."""
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
    least = np.full((len(sets), REGISTERS), _EMPTY)
    for k in range(ROUNDS):
        h = flat if k == 0 else mix(flat ^ _SALT[k])
        new = np.full(least.size, _EMPTY)
        np.minimum.at(new, doc * REGISTERS + (h >> np.uint64(64 - _TOP)).astype(np.int64), h << np.uint64(_TOP))
        least = np.where(least == _EMPTY, new.reshape(least.shape), least)
        open_ = (least == _EMPTY).any(1)
        flat, doc = flat[open_[doc]], doc[open_[doc]]
        if not len(flat):
            break
    for i in np.flatnonzero(open_).tolist():
        empty = np.flatnonzero(least[i] == _EMPTY)
        for at in range(0, len(empty), 16):
            some = empty[at : at + 16]
            least[i, some] = mix(sets[i][None, :] ^ _SALT[ROUNDS + some][:, None]).min(1)
    # leading zeros, from the exponent of the top 53 bits
    top = (least >> np.uint64(11)).astype(np.float64)
    zeros = np.where(top > 0, 53 - np.frexp(top)[1], 53).astype(np.uint64)
    mantissa = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def _signed(held: list[np.ndarray]) -> list[bytes | None]:
    """The signatures of ``held``, which is emptied; None for empty sets."""
    some = [own for own in held if len(own)]
    found = iter(registers_of(some)) if some else iter(())
    out = [next(found).tobytes() if len(own) else None for own in held]
    held.clear()
    return out


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set, registers; the last two null without words."""
    import hashlib

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, digests, signs, held = [], [], [], []
            for own in shingle_sets(part.column(1).to_pylist()):
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own, digest_size=16).digest() if len(own) else None)
                held.append(own)
                if sum(map(len, held)) > STEP:
                    signs += _signed(held)
            signs += _signed(held)
            columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SIGNATURE.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SIGNATURE)


def _zeros(n: np.ndarray) -> np.ndarray:
    """A row per set size: the chances of so many leading zeros of a bucket's smallest hash."""
    per = np.maximum(np.asarray(n, float) / REGISTERS, 1.0)[:, None]
    some = 1 - np.exp(-per * 2.0 ** -np.arange(0, 55))
    return some[:, :-1] - some[:, 1:]


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected agreement of a register of two unrelated sets of n and m elements."""
    return (_zeros(n) * _zeros(m)).sum(1) / (1 << MANTISSA)


def likely(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """matrix[i, j]: whether sets of signatures p[i], q[j] and sizes n[i], m[j] may reach ``percent``.

    The share of equal registers, less what chance gives, must not be safely below
    it, and the sizes must leave room for it.
    """
    if len(p) * len(q) <= 4096:
        same = (p[:, None, :] == q[None, :, :]).sum(2, dtype=np.int64)
    else:
        same = np.zeros((len(p), len(q)), np.uint8)
        for r in range(REGISTERS):
            same += p[:, r, None] == q[None, :, r]
    c = _zeros(n) @ _zeros(m).T / (1 << MANTISSA)
    room = 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
    return room & ((same / REGISTERS - c) / (1 - c) >= percent / 100 - MARGIN)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """matrix[i, j]: elements that the sets left[i] and right[j] share.

    Elements that many sets hold are columns of two 0/1 matrices and counted by their
    product; pairs of sets are formed for the others.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    da, db = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    common = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    if not len(common):
        return out
    (ia, da), (ib, db) = (_placed(x, d, common) for x, d in ((a, da), (b, db)))
    fa, fb = np.bincount(ia, minlength=len(common)), np.bincount(ib, minlength=len(common))
    dense = np.flatnonzero(fa * fb * 64 >= out.size)
    place = np.full(len(common), -1)
    place[dense] = np.arange(len(dense))
    for lo in range(0, len(dense), 2048):
        width = min(2048, len(dense) - lo)
        x, y = (_matrix(place[i] - lo, d, len(s), width) for i, d, s in ((ia, da, left), (ib, db, right)))
        out += (x @ y.T).astype(np.int64)
    for (ja, ea), (jb, eb) in _sparse(ia, da, ib, db, place < 0, fa * fb):
        # every holder on the left meets all holders on the right
        start, size = np.searchsorted(jb, ja), np.searchsorted(jb, ja, "right") - np.searchsorted(jb, ja)
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        out += np.bincount(np.repeat(ea, size) * out.shape[1] + eb[at], minlength=out.size).reshape(out.shape)
    return out


def _placed(elements: np.ndarray, doc: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``common``, set) of the elements that it holds, in the order of places."""
    at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
    hit = common[at] == elements
    at, doc = at[hit], doc[hit]
    order = np.argsort(at, kind="stable")
    return at[order], doc[order]


def _matrix(column: np.ndarray, row: np.ndarray, rows: int, width: int) -> np.ndarray:
    inside = (column >= 0) & (column < width)
    out = np.zeros((rows, width), np.float32)
    out[row[inside], column[inside]] = 1
    return out


def _sparse(ia: np.ndarray, da: np.ndarray, ib: np.ndarray, db: np.ndarray, rare: np.ndarray, pairs: np.ndarray) -> Iterator[tuple]:
    """Both sides of the rare elements, in portions of a few million pairs."""
    ka, kb = rare[ia], rare[ib]
    ia, da, ib, db = ia[ka], da[ka], ib[kb], db[kb]
    portion = np.cumsum(np.where(rare, pairs, 0)) // PAIRS
    for k in np.unique(portion[ia]).tolist():
        x, y = portion[ia] == k, portion[ib] == k
        yield (ia[x], da[x]), (ib[y], db[y])


def forest(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of fields that are set in ``good`` and connect all that its set fields connect; fewer than its rows and columns."""
    if good.sum() < sum(good.shape):
        return np.nonzero(good)
    rows, columns, left = [], [], np.ones(good.shape[1], bool)
    seen = np.zeros(len(good), bool)
    for begin in range(len(good)):
        todo = [] if seen[begin] else [begin]
        seen[begin] = True
        while todo:
            i = todo.pop()
            new = np.flatnonzero(good[i] & left)
            left[new] = False
            for j in new.tolist():
                rows.append(i)
                columns.append(j)
                more = np.flatnonzero(good[:, j] & ~seen)
                seen[more] = True
                rows += more.tolist()
                columns += [j] * len(more)
                todo += more.tolist()
    return np.array(rows, np.int64), np.array(columns, np.int64)


def whole_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, s: the whole shingle sets, as bytes, of the documents among ``ids`` (rep); of rows of one id, one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [own.tobytes() for own in shingle_sets(part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["rep", "s"])

    texts = IdFilter(ids, "rep").apply(docs.select(F.col("doc_id").alias("rep"), "text"), "rep")
    sets = texts.mapInArrow(run, "rep long, s binary").join(unsent(ids), "rep", "left_semi")
    return staged(sets, "dup-sets")


def _cells(members: DataFrame) -> DataFrame:
    """key, i, j, side, rep, component: every pair of a key's members of different components meets in a cell.

    members: key, rep, component, bytes. A key's largest component is compared with the
    others only: the others are the left side, all members the right one, both in
    blocks of at most some ``BLOCK`` members and ``BYTES`` bytes.
    """
    per = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    keys = per.groupBy("key").agg(F.sum("n").alias("m"), F.sum("b").alias("mb"), F.max(F.struct("n", "b", "component")).alias("top")).filter("m > top.n")
    blocks = lambda n, b: F.greatest(F.ceil(n / BLOCK), F.ceil(b / BYTES))
    n, b = F.col("m") - F.col("top.n"), F.col("mb") - F.col("top.b")
    keys = keys.select("key", F.col("top.component").alias("_main"), blocks(n, b).alias("_rows"), blocks(F.col("m"), F.col("mb")).alias("_columns"))
    held = staged(members.join(unsent(keys), "key"), "dup-held")
    own = lambda c: F.pmod(F.xxhash64("rep"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = held.filter("component <> _main").select("key", own("_rows").alias("i"), each("_columns").alias("j"), F.lit(0).alias("side"), "rep", "component", "bytes")
    right = held.select("key", each("_rows").alias("i"), own("_columns").alias("j"), F.lit(1).alias("side"), "rep", "component", "bytes")
    return left.union(right)


def _compared(cells: DataFrame, shown: DataFrame, percent: int, *, by_set: bool) -> DataFrame:
    """a, b: links that connect whatever the pairs of a cell's sides connect, and few more.

    By signature alone these are the components of likely pairs; with the members'
    whole sets (``s`` in ``shown``) they are members whose link is confirmed on these.
    """
    total = cells.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bundles = int(max(1, total[0] // (4 * BLOCK), total[1] // (2 * BYTES)))
    joined = cells.drop("bytes").join(unsent(shown), "rep").withColumn("bundle", F.pmod(F.xxhash64("key", "i", "j"), F.lit(bundles)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        pdf = pdf.sort_values(["key", "i", "j", "side", "rep"], ignore_index=True)
        key, side = pdf[["key", "i", "j"]].to_numpy(), pdf["side"].to_numpy()
        rep, component, n = (pdf[c].to_numpy() for c in ("rep", "component", "n"))
        signs = np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(-1, REGISTERS)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)], strict=True):
            mid = lo + int((side[lo:hi] == 0).sum())
            if not lo < mid < hi:
                continue
            good = likely(signs[lo:mid], n[lo:mid], signs[mid:hi], n[mid:hi], percent) & (component[lo:mid, None] != component[None, mid:hi])
            if by_set and good.any():
                x, y = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
                shared = intersections(*([np.frombuffer(pdf["s"].iat[i], np.uint64) for i in part.tolist()] for part in (lo + x, mid + y)))
                good[np.ix_(x, y)] &= 100 * shared >= percent * (n[lo + x][:, None] + n[mid + y][None, :] - shared)
            u, v = forest(good)
            own = rep if by_set else component
            a.append(own[lo + u])
            b.append(own[mid + v])
        return pd.DataFrame({"a": np.concatenate([*a, np.empty(0, np.int64)]), "b": np.concatenate([*b, np.empty(0, np.int64)])}).drop_duplicates()

    wanted = ["bundle", "key", "i", "j", "side", "rep", "component", "n", "registers", *(["s"] if by_set else [])]
    return staged(joined.select(wanted).groupBy("bundle").applyInPandas(lambda pdf: run(pdf), "a long, b long"), "dup-links")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (doc_id = component_id): a row per row.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their
    sets of 5-word shingles. Null, empty and wordless texts have 0 shingles and are
    linked with nothing; shorter texts are one shingle. Rows of one id are one
    document and share its component. A row without an id takes its class's
    component. Whole texts count however long; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signs = staged(signatures(docs), "dup-signs")
    some = signs.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = some.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("c"))
    classes = staged(classes.select("digest", F.col("c.doc_id").alias("rep"), F.col("c.n_shingles").alias("n"), "c.registers"), "dup-classes")

    sizes, bytes_per = unsent(classes.select("rep", (F.col("n") * 8).alias("bytes"))), 2 * ROWS
    bands = classes.select("rep", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1))).alias("band"), "registers")
    bands = bands.select("rep", F.xxhash64("band", F.expr(f"substring(registers, band * {bytes_per} + 1, {bytes_per})")).alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("_last"), F.count("*").alias("m")).filter("pivot <> _last").drop("_last")
    members = staged(bands.join(unsent(shared), "key"), "dup-members")

    votes = members.filter("rep <> pivot").groupBy("rep", "pivot").agg(F.count("*").alias("_n"))
    stars = votes.groupBy("rep").agg(F.max(F.struct("_n", -F.col("pivot"))).alias("v")).select((-F.col("v.col2")).alias("key"), "rep")
    sets = whole_sets(staged(members.select("rep").distinct(), "dup-ids"), docs)
    shown = classes.join(unsent(sets), "rep").select("rep", "n", "registers", "s")
    sized = staged(stars.join(sizes, "rep").withColumn("component", F.col("rep")), "dup-stars")
    pivots = sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    pivots = pivots.select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("b") / BYTES)).alias("_rows"))
    zero = F.lit(0).cast("long")
    left = sized.join(unsent(pivots), "key").select("key", F.pmod(F.xxhash64("rep"), F.col("_rows")).alias("i"), zero.alias("j"), F.lit(0).alias("side"), "rep", "component", "bytes")
    right = pivots.select("key", F.explode(F.sequence(zero, F.col("_rows") - 1)).alias("i"), zero.alias("j"), F.lit(1).alias("side"), F.col("key").alias("rep"), F.col("key").alias("component"))
    right = right.join(sizes, "rep").select(left.columns)
    links = _compared(left.union(right), shown, percent, by_set=True)
    labels = components(links)

    placed = members.select("key", "rep").join(unsent(labels.withColumnRenamed("node", "rep")), "rep", "left")
    placed = placed.select("key", "rep", F.coalesce("component", "rep").alias("component"), F.lit(2 * REGISTERS + 64).alias("bytes"))
    cells = staged(_cells(placed), "dup-cells")
    near = _compared(cells, classes.select("rep", "n", "registers"), percent, by_set=False)
    groups = components(near).select(F.col("node").alias("component"), F.col("component").alias("key"))
    inside = cells.select("rep", "component").distinct().join(unsent(groups), "component").join(sizes, "rep")
    more = _compared(_cells(inside.select("key", "rep", "component", "bytes")), shown, percent, by_set=True)
    labels = components(links.union(more))

    member = signs.join(unsent(classes.select("digest", "rep")), "digest", "left").join(unsent(labels.withColumnRenamed("node", "rep")), "rep", "left")
    label = F.coalesce("component", "rep", "doc_id")
    return member.select("doc_id", "n_shingles", label.alias("component_id"), F.col("doc_id").eqNullSafe(label).alias("kept"))
