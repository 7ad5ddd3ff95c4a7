import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import evaluate, retrieval, semantic
from loomline.operators import grams as G

TEXTS = ["劳动合同应当以书面形式订立", "书面形式的合同 由双方签订", "用人单位应当支付工资", "工资应当按月支付", "", "合"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, 100 + i, f"法{i % 2}", f"第{i}条", t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "row_idx long, id long, law string, num string, text string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid long, query string")


def grams(s):
    return list(s) if len(s) < 2 else [s[i : i + 2] for i in range(len(s) - 1)]


def plain_bm25(query):
    docs = [Counter(grams("".join(t.split()))) for t in TEXTS]
    sizes = [sum(d.values()) for d in docs]
    mean, out = sum(sizes) / len(docs), {}
    for g in [g for w in query.split() for g in grams(w)]:
        df = sum(g in d for d in docs)
        for i, d in enumerate(docs):
            if d[g]:
                idf = math.log((len(docs) - df + 0.5) / df + 1)
                out[i] = out.get(i, 0) + idf * d[g] * 2.5 / (d[g] + 1.5 * (0.4 + 0.6 * sizes[i] / mean))
    return sorted(((round(s, 6), i) for i, s in out.items()), key=lambda x: (-x[0], x[1]))


def test_bm25(spark, corpus):
    queries = ["书面合同", "工资 支付", "合", "", "应当应当", "不存在"]
    got = retrieval.bm25(corpus, asked(spark, *queries), None).collect()
    for q, text in enumerate(queries):
        mine = [(r.score, r.row_idx) for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])]
        want = plain_bm25(text)
        assert [i for _, i in mine] == [i for _, i in want], text
        assert [s for s, _ in mine] == pytest.approx([s for s, _ in want], abs=2e-6)


def test_like_ranks_by_position_and_hits_all_for_nothing(spark, corpus):
    got = retrieval.like(corpus, asked(spark, "应当", "  ", "书面形式的合同 由"), None).collect()
    assert [r.row_idx for r in sorted((r for r in got if r.qid == 0), key=lambda r: r["rank"])] == [3, 0, 2]
    assert sum(r.qid == 1 for r in got) == len(TEXTS)
    assert [r.row_idx for r in got if r.qid == 2] == [1]


def test_weighted_fusion(spark):
    rows = [(0, "a", 1.0, i + 1, d) for i, d in enumerate([1, 2])] + [(0, "b", 2.5, i + 1, d) for i, d in enumerate([9, 10])]
    lists = spark.createDataFrame(rows, "qid long, channel string, weight double, rank int, row_idx long")
    got = sorted(retrieval.rrf(lists).collect(), key=lambda r: r["rank"])
    assert [r.row_idx for r in got] == [9, 10, 1, 2] and got[0].score == pytest.approx(2.5 / 61, abs=1e-9)
    even = sorted(retrieval.rrf(lists.withColumn("weight", F.lit(1.0))).collect(), key=lambda r: r["rank"])
    assert [r.row_idx for r in even] == [1, 9, 2, 10]


def test_pool_follows_and_verbatim_queries_pass_it_over(spark, corpus):
    queries = asked(spark, "工资应当", "书面工资")
    pool = spark.createDataFrame([(q, r, d) for q in (0, 1) for r, d in ((1, 5), (2, 3), (3, 4))], "qid long, rank int, row_idx long")
    seen = []

    def reranker(hits):
        seen.extend(r.qid for r in hits.select("qid").distinct().collect())
        return hits

    got = retrieval.Hybrid(corpus, pool=pool).recall_with_trace(queries, reranker).collect()
    assert seen == [1]
    rows = {q: [r.row_idx for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] for q in (0, 1)}
    assert 5 not in rows[0] and len(set(rows[1])) == len(rows[1]) and rows[1][-2:] == [5, 4]
    assert [sorted(r["rank"] for r in got if r.qid == q) for q in (0, 1)] == [list(range(1, len(rows[q]) + 1)) for q in (0, 1)]


def test_k_only_truncates(spark, corpus):
    queries = asked(spark, "书面合同", "工资")
    hybrid = retrieval.Hybrid(corpus)
    deep = {(r.qid, r["rank"], r.id) for r in hybrid.search(queries, 20).collect()}
    assert {(r.qid, r["rank"], r.id) for r in hybrid.search(queries, 2).collect()} == {x for x in deep if x[1] <= 2}
    assert hybrid.search(asked(spark, "不存在的"), 5).collect() == []


def test_guard(spark):
    got = retrieval.guarded(asked(spark, " a　b ", "x" * 300, None)).orderBy("qid").collect()
    assert [(r.query, r.truncated, r.empty) for r in got] == [("a b", False, False), ("x" * 200, True, False), ("", False, True)]


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, [10, 11]), (2, [20]), (3, [30])], "qid long, gold_ids array<long>")
    ranking = spark.createDataFrame([(1, 3, 11), (1, 7, 10), (2, 1, 20), (3, 31, 30)], "qid long, rank int, row_idx long")
    hits = evaluate.first_hits(gold, ranking)
    r = evaluate.recall_mrr(hits).first()
    assert (r.n, r.recall_at_k, r.mrr) == (3, pytest.approx(2 / 3, abs=1e-6), pytest.approx((1 / 3 + 1) / 3, abs=1e-6))
    assert {(x.k, x.recall_at_k) for x in evaluate.multi_k(hits, (1, 5)).collect()} == {(1, 0.333333), (5, 0.666667)}
    assert dict(evaluate.rank_histogram(hits).collect()) == {"1": 1, "2-5": 1, "6-10": 0, "11-30": 0, "miss": 1}
    better = evaluate.first_hits(gold, ranking.withColumn("rank", F.when(F.col("qid") == 3, 1).otherwise(9)))
    assert tuple(evaluate.rescues(hits, better).first()) == (1, 2)
    one = spark.createDataFrame([(1, None, 7), (2, [None, 5], 7)], "qid long, gold_ids array<long>, gold_id long")
    assert dict(evaluate.gold_set(one).collect()) == {1: [7], 2: [5]}


def test_semantic_ranks_and_unknown_rows(spark):
    vectors = spark.createDataFrame([(101, "m", [1.0, 0.0]), (102, "m", [0.0, 1.0]), (103, "m", [0.0, 0.8])], "row_idx long, model string, vec array<double>")
    queries = spark.createDataFrame([(1, "m", "q", [0.0, 1.0]), (1, "m", "e", [1.0, 0.1])], "qid long, model string, variant string, vec array<double>")
    ranks = semantic.semantic_ranks(vectors, queries)
    assert {r.row_idx: r.sem for r in ranks.collect()} == {101: 1, 102: 1, 103: 2}
    assert [r.row_idx for r in semantic.semantic_pool(vectors, queries, 2).orderBy("rank").collect()] == [101, 102]
    hits = spark.createDataFrame([(1, 1, 999), (1, 2, 103), (1, 3, 102)], "qid long, rank int, row_idx long")
    got = semantic.semantic_rerank(hits, ranks).orderBy("rank").collect()
    assert got[0].row_idx == 102 and {r.row_idx: r.semantic_rank for r in got} == {102: 1, 103: 2, 999: 3}
    cross = spark.createDataFrame([(1, 103, 0.9), (1, 102, 0.1), (1, 999, 0.5)], "qid long, row_idx long, cross double")
    blended = semantic.semantic_rerank(hits, ranks, cross).orderBy("rank").collect()
    assert blended[0].row_idx == 103 and {r.row_idx: r.rerank_score for r in blended} == {r.row_idx: r.rerank_score for r in got}


def test_judges(spark):
    hits = spark.createDataFrame([(1, i, 100 + i) for i in range(1, 6)] + [(2, 1, 7)], "qid long, rank int, row_idx long")
    answers = spark.createDataFrame([(1, "take [3, 1, 99, 3] or [2]"), (2, "nothing [x]")], "qid long, answer string")
    got = semantic.promote(hits, semantic.pick_numbers(answers)).orderBy("qid", "rank").collect()
    assert [r.row_idx for r in got] == [103, 101, 102, 104, 105, 7]
    scores = spark.createDataFrame([(1, 100 + i, s) for i, s in ((1, 0.1), (2, 0.05), (3, 0.7), (4, 0.1), (5, 0.05))], "qid long, row_idx long, judge_score double")
    assert [r.row_idx for r in semantic.judge_rerank(hits, scores).filter("qid = 1").orderBy("rank").collect()] == [103, 101, 104, 102, 105]


def test_models_that_fail_give_no_scores(spark):
    pairs = spark.createDataFrame([(1, 1, "q", "good"), (1, 2, "q", "boom")], "qid long, row_idx long, query string, text string")

    def scorer():
        def score(queries, texts):
            if "boom" in texts:
                raise OSError("down")
            return [float(len(t)) for t in texts]

        return score

    assert [tuple(r) for r in semantic.model_scores(pairs.coalesce(1), scorer, 1).collect()] == [(1, 1, 4.0)]
    texts = spark.createDataFrame([(1, "ab"), (2, "c")], "k long, text string")
    got = semantic.encode(texts, lambda: lambda batch: [[3.0 * len(t), 4.0 * len(t)] for t in batch], "k").collect()
    assert all(r.vec == pytest.approx([0.6, 0.8]) for r in got)


def test_recall_searches_the_texts_once(spark):
    rows = spark.createDataFrame([(i, i, "l", "n", t) for i, t in enumerate(["ab cd", "abcd", "zz", None])], "row_idx long, id long, law string, num string, text string")
    asked = spark.createDataFrame([(1, "abc"), (2, "b c"), (3, "qq"), (4, "zy")], "qid long, query string")
    pool = spark.createDataFrame([(q, r, i) for q in (1, 3, 4) for r, i in enumerate((2, 1, 9), 1)], "qid long, rank int, row_idx long")
    found = retrieval.Hybrid(rows, {}, pool).recall_with_trace(asked)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    got = [(r.qid, r.rank, r.row_idx, r.channels) for r in found.orderBy("qid", "rank").collect()]
    said = ["semantic"]
    assert [x for x in got if x[0] != 2] == [
        (1, 1, 1, ["bm25", "like"]), (1, 2, 0, ["bm25"]), (3, 1, 2, said), (3, 2, 1, said), (3, 3, 9, said), (4, 1, 2, said), (4, 2, 1, said), (4, 3, 9, said)]


def test_gram_counts_by_table_and_by_search(monkeypatch):
    texts = ["", "a", "ab", "aab", "\n\na", "😀a😀a", "\U0010ffff", "b\U0010ffffb", "a"]
    known = np.unique(np.concatenate([G.codes(t) for t in ("a", "aab", "\n\na", "😀a", "\U0010ffff", "b\U0010ffff", "\x00\x00")]))
    table = G.counts(texts, known)
    assert table.tolist() == [[int((G.codes(t) == k).sum()) for k in known] for t in texts]
    monkeypatch.setattr(G, "CHARS", 1)
    assert (G.counts(texts, known) == table).all()
