import numpy as np
import pytest

from loomline.llm import embeddings, minhash, mixing
from loomline.llm._graph import components

from .test_text_kernels import shingles_of

SCHEMA = "doc_id long, text string, component_id string, n_shingles string, rep int"


def brute(rows, percent=75):
    """component of each row by all pairs."""
    sets = [set(shingles_of(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_minhash_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for base in range(12):
        text = list(rng.choice(words, 120))
        for copy in range(6):
            own = list(text)
            for _ in range(copy * 2):
                own[rng.integers(len(own))] = f"n{rng.integers(10**6)}"
            rows.append((n := n + 1, " ".join(own)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "a b"), (504, "A  b"), (505, rows[0][1]), (505, rows[0][1]), (506, "long " * 3 + "word " * 200_000)]
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == sorted(brute(rows))


def test_minhash_empty_table_and_null_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "z")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {(None, 1, 4, False), (4, 1, 4, True), (None, 1, None, True)}


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 3000):
        for share in (0.5, 0.75, 1.0):
            common = int(n * share)
            seen = []
            for _ in range(60):
                h = np.unique(rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64))
                rng.shuffle(h)
                a, b = minhash.registers_of([np.sort(h[:n]), np.sort(h[n - common :])])
                seen.append((a == b).mean())
            c = minhash.chance(np.array([n]), np.array([n]))[0]
            assert abs((np.mean(seen) - c) / (1 - c) - common / (2 * n - common)) < 0.06


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 31)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    x[150:200] = x[:50] + 0.1 * rng.normal(size=(50, 16))
    x[200:230] = x[0]
    rows = [(i, [float(v) for v in x[i]], int(i % 3 if i < 150 else (i - 150) % 3), "z") for i in range(300)]
    rows += [(900, None, 1, "z"), (901, [0.0] * 16, 1, "z"), (902, [float("nan")] + [1.0] * 15, 1, "z"), (903, [None] + [1.0] * 15, 1, "z"), (904, rows[0][1], None, "z"), (905, [1e300] * 16, 2, "z"), (906, [1e300] * 16, 2, "z"), (907, [1.0, 2.0], 2, "z")]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component_id string")).collect()}
    usable = {r[0]: (np.array(r[1]) / np.abs(r[1]).max(), r[2]) for r in rows if r[0] < 900 or r[0] in (905, 906)}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    true = {i: sum(1 for j in usable if j != i and usable[i][1] == usable[j][1] and cos(usable[i][0], usable[j][0]) >= 0.93) for i in usable}
    assert len(got) == len(rows)
    assert all(got[i].n_links <= n for i, n in true.items())
    assert sum(got[i].n_links for i in true) >= 0.95 * sum(true.values())
    for i in (900, 901, 902, 903, 904, 907):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("kind", ["one", "few", "random", "dense", "tight"])
def test_flat_graph_finds_what_is_near(kind):
    rng = np.random.default_rng(3)
    x = {
        "one": rng.normal(size=(1, 8)), "few": rng.normal(size=(5, 8)), "random": rng.normal(size=(3000, 8)),
        "dense": rng.normal(size=64) + 0.23 * rng.normal(size=(2500, 64)), "tight": np.repeat(rng.normal(size=(8, 64)), 120, axis=0) + 0.05 * rng.normal(size=(960, 64)),
    }[kind]
    x = embeddings.unit(list(x))
    graph = embeddings.flat_graph(x)
    queries = np.arange(len(x))[::7]
    q, v = embeddings.range_search(x, graph, queries, 0.93)
    assert ((x[queries[q]] * x[v]).sum(1) >= 0.93 - 1e-12).all() and len(set(zip(q.tolist(), v.tolist(), strict=True))) == len(q)
    assert len(q) >= 0.99 * (x[queries] @ x.T >= 0.93).sum()


def test_graph_that_misses_is_replaced(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=16) + 0.2 * rng.normal(size=(300, 16))
    monkeypatch.setattr(embeddings, "range_search", lambda x, graph, queries, least: (np.empty(0, np.int64), np.empty(0, np.int64)))
    found = [p for a, b in embeddings.linked(x, np.arange(300), np.arange(300), 0.93) for p in zip(a.tolist(), b.tolist(), strict=True)]
    u = embeddings.unit(list(x))
    assert set(found) == {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.93), strict=True) if i != j}


@pytest.mark.parametrize("region", [60, 400])
def test_audit_over_several_overlapping_regions(spark, monkeypatch, region):
    monkeypatch.setattr(embeddings, "REGION", region)
    rng = np.random.default_rng(10)
    x = np.repeat(rng.normal(size=(300, 16)), 4, axis=0) + 0.15 * rng.normal(size=(1200, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v], i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert embeddings.audit(df) >= 0.9


def test_cosine_at_the_threshold(spark):
    a = [1.0, 0.0]
    edge = [0.93, float(np.sqrt(1 - 0.93**2))]
    rows = [(1, a, 1), (2, edge, 1), (3, [0.9299999, float(np.sqrt(1 - 0.9299999**2))], 1), (4, [-1.0, 0.0], 1)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    cos = np.dot(a, edge) / (np.linalg.norm(a) * np.linalg.norm(edge))
    assert got[4] == 0 and got[1] == int(cos >= 0.93) and got[3] == 1


def _all_pairs(x):
    x = embeddings.unit(list(x))
    return ((x @ x.T >= 0.93).sum(1) - 1).tolist()


def _embedded(spark, x):
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    return sorted(embeddings.near_duplicates(df).collect(), key=lambda r: r.vec_id)


@pytest.mark.parametrize("region", [8, 60])
def test_hot_group_over_many_regions_keeps_every_link(spark, monkeypatch, region):
    monkeypatch.setattr(embeddings, "REGION", region)
    rng = np.random.default_rng(8)
    hot = rng.normal(size=64) + 0.23 * rng.normal(size=(300, 64))  # most pairs are links, distinct, some are just not
    got = _embedded(spark, np.concatenate([hot, rng.normal(size=(100, 64))]))
    assert [r.n_links for r in got] == _all_pairs(hot) + [0] * 100
    assert {r.component_id for r in got[:300]} == {0} and sum(r.kept for r in got) == 101


def test_tight_groups_without_vectors_between_them(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(8, 64)), 60, axis=0) + 0.05 * rng.normal(size=(480, 64))
    got = _embedded(spark, x)
    assert [r.n_links for r in got] == _all_pairs(x) == [59] * 480
    assert [r.component_id for r in got] == [i - i % 60 for i in range(480)]


def test_components_cost_the_driver_two_jobs(spark):
    """Small graphs are not connected by rounds of shuffles and broadcasts; larger ones give the same result."""
    from loomline.llm import _graph

    rng = np.random.default_rng(12)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 3000, (2500, 2))] + [(5000 + i, 5001 + i) for i in range(300)] + [(-4, -4)]
    df = spark.createDataFrame(links, "a long, b long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("cc-test", "components")
    try:
        got = components(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("cc-test")) <= 5
    assert sorted(got.collect()) == sorted(_graph._by_rounds(df.filter("a <> b")).collect())


def test_id_filter_is_broadcast_in_few_rows(spark):
    from loomline.llm._graph import IdFilter

    ids = spark.range(0, 90_000, 3).withColumnRenamed("id", "doc_id")
    held = IdFilter(ids, "doc_id")
    assert held.blocks.count() <= held.bits // 4096
    rows = spark.range(100_000).union(spark.sql("select cast(null as long)"))
    got = {r.id for r in held.apply(rows, "id").collect()}
    assert set(range(0, 90_000, 3)) <= got and None not in got
    assert len(got) < 30_000 + 7_000


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """Only the filter of ids, which is bounded, may pass through the driver; Spark alone would broadcast every table of this size."""
    plans, staged = {}, minhash.staged

    def watched(df, what):
        plans.setdefault(what, []).append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, what)

    monkeypatch.setattr(minhash, "staged", watched)
    rows = [(i, " ".join(f"w{(i // 3) * 50 + k}" for k in range(40)) + (" x" if i % 3 else "")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs)
    plans["labels"] = [found._jdf.queryExecution().executedPlan().toString()]
    assert {r.component_id for r in found.collect()} == set(range(0, 30, 3))
    sent = {what: plan.count("BroadcastHashJoin") for what, parts in plans.items() for plan in parts if "BroadcastHashJoin" in plan}
    assert sent == {"dup-sets": 1}
    mixed = mixing.mix(docs.selectExpr("*", "'s' as source"))
    assert "BroadcastHashJoin" not in mixed._held()._jdf.queryExecution().executedPlan().toString()
