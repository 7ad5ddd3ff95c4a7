"""Near-duplicate vectors by a robust-pruned flat graph, searched within a range and verified in double precision.

Equal vectors of a label are one point. A point's home is the cell of its nearest
centre; centres are drawn from a bounded sample. It also visits every later cell
that a vector within its range can lie in, so that any two linked points meet in
exactly one cell, at home or as home and visitor. Cells too large for a task are
cut into blocks, and a task gets two blocks at most.

There the points are dealt to overlapping cluster shards. Each shard gives every point
out-neighbours, the nearest and some random candidates pruned so that none hides
behind another; the shards' adjacency lists are united, both ways, into one flat graph.
Every point then searches it, greedily from the medoid of its nearest shard and from
its own place, and expands whatever lies within the range. Cosines near the threshold
are verified from the raw vectors. Each task audits its recall: every
``AUDITED``-th search is repeated by brute force, and where that finds a link that the
graph has not, the task's blocks are compared as a whole by matrix products.

A task gives a number of links and a link to a representative for each point, not its
pairs. ``audit`` measures the recall of the whole by brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import small_batches, staged

#: Points sampled for centres, centres at most, aimed-at size of a region and of a shard of the graph.
SAMPLE, CENTRES, REGION, SHARD = 16_384, 4_096, 8_192, 256
#: Products computed at once, rows dealt at once.
CELLS, DEALT = 1 << 21, 4_096
#: Out-degree, nearest and random candidates looked at, pruning slack, beam, searches at once, one in how many is audited.
DEGREE, CANDIDATES, RANDOM, ALPHA, BEAM, TOGETHER, AUDITED = 16, 40, 8, 1.2, 8, 128, 20


def clean(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v (doubles), usable: whether the vector can be linked at all."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    return own.withColumn("usable", F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & nonzero, F.lit(False)))


def unit(values) -> np.ndarray:
    """Rows of length 1; scaled first so that squares neither overflow nor vanish."""
    v = np.stack([np.asarray(x, np.float64) for x in values])
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def robust_prune(x: np.ndarray) -> np.ndarray:
    """(row, out-neighbour) of the unit vectors of a shard; candidates are the nearest rows and a few random ones."""
    n, near = len(x), min(len(x) - 1, CANDIDATES)
    if near < 1:
        return np.empty((0, 2), np.int64)
    some = np.random.default_rng(n).integers(0, n, (n, RANDOM))
    out = []
    for lo in range(0, n, 128):
        block = x[lo : lo + 128] @ x.T
        rows = np.arange(len(block))
        block[rows, rows + lo] = -np.inf
        c = np.argpartition(-block, near - 1, axis=1)[:, :near]
        c = np.concatenate([c, some[lo : lo + 128]], axis=1)
        c = np.take_along_axis(c, np.argsort(-np.take_along_axis(block, c, 1), axis=1, kind="stable"), 1)
        own = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(block, c, 1), 0))
        among = np.sqrt(np.maximum(2 - 2 * np.matmul(x[c], x[c].transpose(0, 2, 1)), 0))
        alive, chosen = c != (rows + lo)[:, None], np.zeros(c.shape, bool)
        for _ in range(min(DEGREE, near)):
            k = alive.argmax(1)
            left = alive[rows, k]
            if not left.any():
                break
            chosen[rows[left], k[left]] = True
            alive &= (ALPHA * among[rows, k] > own) | ~left[:, None]
            alive[rows, k] = False
        i, k = np.nonzero(chosen)
        out.append(np.stack([i + lo, c[i, k]], 1))
    return np.concatenate(out)


def centres_of(x: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, count).astype(np.int64)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def flat_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, neighbours, medoids): the united adjacency of the overlapping shards and the medoid of each shard; row i has neighbours[begin[i] : begin[i + 1]]."""
    c = centres_of(x, max(1, round(len(x) / SHARD)))
    near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :2]
    edges, medoids = [np.empty((0, 2), np.int64)], []
    for k in range(len(c)):
        rows = np.flatnonzero((near == k).any(1))
        if not len(rows):
            continue
        medoid = rows[(x[rows] @ x[rows].mean(0)).argmax()]
        medoids.append(medoid)
        # large shards, as of one dense group, are cut: their parts share their medoid
        for part in np.array_split(rows, -(-len(rows) // (4 * SHARD))):
            edges.append(part[robust_prune(x[part])])
            edges.append(np.stack([part[:: max(1, len(part) // 8)], np.full(len(part[:: max(1, len(part) // 8)]), medoid)], 1))
    e = np.concatenate(edges)
    e = np.concatenate([e, e[:, ::-1]])  # both ways, so that every point can be reached
    key = np.unique(e[e[:, 0] != e[:, 1]] @ np.array([len(x), 1]))
    return np.searchsorted(key, np.arange(len(x) + 1) * len(x)), key % len(x), np.array(medoids)


def range_search(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``queries``, row) of the rows with dot product >= least that searches from the nearest medoids and from the queries' own rows find."""
    begin, neighbours, medoids = graph
    found = []
    for lo in range(0, len(queries), TOGETHER):
        own = queries[lo : lo + TOGETHER]
        seen = np.zeros((len(own), len(x)), bool)
        entry = medoids[(x[own] @ x[medoids].T).argmax(1)]
        q, v = np.concatenate([np.arange(len(own))] * 2), np.concatenate([own, entry])
        key = np.unique(q * len(x) + v)
        q, v = key // len(x), key % len(x)
        seen[q, v] = True
        s, opened = (x[own[q]] * x[v]).sum(1), np.zeros(len(q), bool)
        while True:
            order = np.lexsort((-s, q))
            q, v, s, opened = q[order], v[order], s[order], opened[order]
            first = np.searchsorted(q, np.arange(len(own)))
            keep = (np.arange(len(q)) - first[q] < BEAM) | (s >= least)
            q, v, s, opened = q[keep], v[keep], s[keep], opened[keep]
            todo = np.flatnonzero(~opened)
            if not len(todo):
                break
            opened[todo] = True
            size = begin[v[todo] + 1] - begin[v[todo]]
            at = np.repeat(begin[v[todo]] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            nq, nv = np.repeat(q[todo], size), neighbours[at]
            fresh = ~seen[nq, nv]
            key = np.unique(nq[fresh] * len(x) + nv[fresh])
            nq, nv = key // len(x), key % len(x)
            seen[nq, nv] = True
            new = np.concatenate([np.einsum("ij,ij->i", x[own[nq[i : i + CELLS // 64]]], x[nv[i : i + CELLS // 64]]) for i in range(0, len(nq), CELLS // 64)] or [np.empty(0)])
            q, v, s = np.concatenate([q, nq]), np.concatenate([v, nv]), np.concatenate([s, new])
            opened = np.concatenate([opened, np.zeros(len(nq), bool)])
        inside = s >= least
        found.append((q[inside] + lo, v[inside]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def visits(x: np.ndarray, c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's home) of unit vectors among centres.

    A vector y whose cosine with x is ``least`` or more is nearer to centre k than to
    x's own centre h only if x . (k - h) >= -sin(range) * |k - h|.
    """
    near = x @ c.T
    home = near.argmax(1)
    reach = np.sqrt(1 - least * least) if least > 0 else np.inf
    square = (c * c).sum(1)
    apart = np.sqrt(np.maximum(square[home][:, None] + square[None, :] - 2 * (c[home] @ c.T), 0))
    touched = near - near[np.arange(len(x)), home][:, None] >= -reach * (apart + 1e-6) - 1e-6
    touched &= np.arange(len(c))[None, :] > home[:, None]
    touched[np.arange(len(x)), home] = True
    row, cell = np.nonzero(touched)
    return row, cell, cell == home[row]


def _regions(points: DataFrame, least: float) -> DataFrame:
    """Points with the region, their own block and the blocks (i, j) that meet in a task.

    Centres come from the SAMPLE points of smallest hash, CENTRES at most, by
    label. A region's home points and its visitors are cut by hash into blocks of
    about twice REGION at most; a home block meets every block, a visiting block the home blocks.
    """
    spark = points.sparkSession
    total = points.count()
    drawn = points.orderBy(F.xxhash64("point", "label"), "point").limit(SAMPLE).select("label", "v").toPandas()
    centres, share = {}, min(CENTRES, max(1, round(total / REGION))) / max(1, len(drawn))
    for (label, dim), own in drawn.assign(dim=drawn["v"].map(len)).groupby(["label", "dim"], sort=True):
        x = unit(own["v"])
        centres[label, dim] = centres_of(x, max(1, min(len(x), round(len(x) * share))))
    shared = spark.sparkContext.broadcast(centres)

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for (label, dim), own in pdf.assign(dim=pdf["v"].map(len)).groupby(["label", "dim"], sort=False):
                c = shared.value.get((label, dim))
                own = own.drop(columns=["dim", "label"])
                if c is None:
                    yield own.assign(region=f"{dim}:{label}", home=True)
                    continue
                row, cell, home = visits(unit(own["v"]), c, least)
                for lo in range(0, len(row), DEALT):
                    at = slice(lo, lo + DEALT)
                    yield own.iloc[row[at]].assign(region=[f"{dim}:{k}:{label}" for k in cell[at]], home=home[at])

    dealt = staged(points.mapInPandas(deal, "point long, v array<double>, copies long, region string, home boolean"), "vec-regions")
    blocks = lambda mine: F.ceil(F.count_if(mine) / (2 * REGION))
    sizes = dealt.groupBy("region").agg(blocks(F.col("home")).alias("nh"), blocks(~F.col("home")).alias("nv"))
    hashed = F.xxhash64("point")
    own = F.when(F.col("home"), F.pmod(hashed, F.col("nh"))).otherwise(F.col("nh") + F.pmod(hashed, F.col("nv")))
    last = F.when(F.col("home"), F.col("nh") + F.col("nv")).otherwise(F.col("nh")) - 1
    # a region without home points has no link to give: its visitors have none to meet
    sized = dealt.join(sizes.filter("nh > 0"), "region").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return sized.select("region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "point", "v", "copies")


def verified(raw: np.ndarray, norm: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs with products ``s`` whose cosine is ``least`` or more, not of a row with itself; close ones are computed anew."""
    sure = s > least + 1e-9
    edge = np.flatnonzero(~sure & (s >= least - 1e-9))
    sure[edge] = [raw[i] @ raw[j] >= least * norm[i] * norm[j] for i, j in zip(a[edge], b[edge], strict=True)]
    sure &= a != b
    return a[sure], b[sure]


def linked(raw: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of ``left``, of ``right``) of rows, not the same row, whose cosine is ``least`` or more, by the flat graph; by products where the audit finds that it misses some."""
    raw = raw / np.abs(raw).max(1, keepdims=True)
    norm = np.sqrt((raw * raw).sum(1))
    x = raw / norm[:, None]
    is_right = np.zeros(len(x), bool)
    is_right[right] = True
    graph = flat_graph(x)
    if _misses(x, graph, left[::AUDITED], is_right, least):
        yield from _products(raw, norm, x, left, right, least)
        return
    for lo in range(0, len(left), 8 * TOGETHER):
        some = left[lo : lo + 8 * TOGETHER]
        q, v = range_search(x, graph, some, least - 1e-9)
        q, v = some[q[is_right[v]]], v[is_right[v]]
        yield verified(raw, norm, q, v, np.einsum("ij,ij->i", x[q], x[v]), least)


def _misses(x: np.ndarray, graph: tuple, queries: np.ndarray, is_right: np.ndarray, least: float) -> bool:
    """Whether brute force finds more rows within the range of the audited queries than the graph does."""
    q, v = range_search(x, graph, queries, least)
    found = np.bincount(q[is_right[v]], minlength=len(queries))
    right = x[is_right]
    step = max(1, CELLS // max(1, len(right)))
    true = [(x[queries[lo : lo + step]] @ right.T >= least + 1e-9).sum(1) for lo in range(0, len(queries), step)]
    return bool((found < np.concatenate(true)).any()) if true else False


def _products(raw: np.ndarray, norm: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, CELLS // max(1, len(right)))
    for lo in range(0, len(left), step):
        some = left[lo : lo + step]
        s = x[some] @ x[right].T
        a, b = np.nonzero(s >= least - 1e-9)
        yield verified(raw, norm, some[a], right[b], s[a, b], least)


def named_groups(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``name`` (of each row, a row of its group) with the groups that the pairs join made one, named by its smallest row."""
    while len(a):
        low = np.minimum(name[a], name[b])
        new = name.copy()
        for end in (name[a], name[b]):
            np.minimum.at(new, end, low)
        new = new[new[name]]
        if (new == name).all():
            break
        name = new
    return name


def _found(regions: DataFrame, least: float) -> DataFrame:
    """(a, b, far) of points with links in a task: a representative of those linked with a there, rows linked with it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack([np.asarray(v, np.float64) for v in pdf["v"]])
        ids, copies, own = pdf["point"].to_numpy(), pdf["copies"].to_numpy(), pdf["own"].to_numpy()
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        far, name = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a, b in linked(raw, left, right, least) if len(left) and len(right) else ():
            far += np.bincount(a, weights=copies[b], minlength=len(ids)).astype(np.int64)
            if i != j:  # within a block a pair is seen from both sides
                far += np.bincount(b, weights=copies[a], minlength=len(ids)).astype(np.int64)
            name = named_groups(name, a, b)
        some = np.flatnonzero(far)
        return pd.DataFrame({"a": ids[some], "b": ids[name[some]], "far": far[some]})

    return regions.groupBy("region", "i", "j").applyInPandas(run, "a long, b long, far long")


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93
) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept: a row per row.

    Vectors of equal labels, not null, are linked when their cosine is ``least`` or
    more. Null and zero vectors, those with null, infinite or undefined components
    and those without a label are linked with nothing, as are vectors of different
    lengths. Repeated rows are equal vectors and so linked. A row without an id
    counts as a vector and takes its point's component. An empty table gives no
    rows; other columns are not read.
    """
    small_batches(vectors.sparkSession)
    own = staged(clean(vectors, id_col, vec_col, label_col), "vec-clean")
    groups = own.filter("usable").groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # a point's number: its class, told apart even where ids repeat
    points = staged(groups.withColumn("point", F.xxhash64("label", F.to_json(F.col("v")), "first")), "vec-points")
    links = staged(_found(_regions(points.select("point", "label", "v", "copies"), least), least), "vec-links")
    far = links.groupBy(F.col("a").alias("point")).agg(F.sum("far").alias("far"))
    labels = components(links.select("a", "b")).withColumnRenamed("node", "point")
    placed = points.join(far, "point", "left").join(labels, "point", "left").withColumn("component", F.coalesce("component", "point"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = placed.join(smallest, "component").select("label", "v", "component_id", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    rows = own.join(placed, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def audit(vectors: DataFrame, *, least: float = 0.93, one_in: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> float:
    """Share of the links of the vectors whose id is divisible by ``one_in``, by brute force in blocks, that are found."""
    own = clean(vectors, id_col, vec_col, label_col).filter("usable")
    queries = own.filter(F.col("vec_id") % one_in == 0).select(F.col("vec_id").alias("q"), F.col("label").alias("ql"), F.col("v").alias("qv"))
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    norm = lambda c: F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, p: s + p * p))
    true = own.join(queries, (F.col("label") == F.col("ql")) & (F.col("vec_id") != F.col("q"))).filter(dot >= least * norm("v") * norm("qv"))
    expected = true.groupBy("q").count()
    got = near_duplicates(vectors, least=least, id_col=id_col, vec_col=vec_col, label_col=label_col)
    both = expected.join(got, expected["q"] == got["vec_id"]).agg(F.sum(F.least("count", "n_links")), F.sum("count")).first()
    return float(both[0] / both[1]) if both[1] else 1.0
