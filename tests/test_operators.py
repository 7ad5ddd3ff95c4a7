"""The operators for experiments, producers, demonstration corpora, readers and reports on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import audit, demo, etl, evaluate, gold, grams, produce, retrieval, semantic, variants
from loomline.sources import files, sinks

CORPUS = "row_idx long, id long, law string, num string, text string"


def test_many_needles_are_joined_alike(spark, monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab \n"), 30)) for _ in range(40)] + [None, ""]
    needles = ["".join(rng.choice(list("ab "), rng.integers(0, 5))) for _ in range(25)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_idx long, text string")
    asked = spark.createDataFrame(list(enumerate(needles)), "qid long, needle string")
    want = {(q, i, t.find(n) + 1) for q, n in enumerate(needles) for i, t in enumerate(texts) if t is not None and n in t}
    assert {tuple(r) for r in grams.containing(rows, asked).collect()} == want
    monkeypatch.setattr(grams, "SMALL", 8)
    assert {tuple(r) for r in grams.containing(rows, asked).collect()} == want


def test_bm25_of_many_queries_is_joined_alike(spark, monkeypatch):
    rng = np.random.default_rng(1)
    corpus = spark.createDataFrame([(i, i, "l", "n", "".join(rng.choice(list("甲乙丙丁 "), 20))) for i in range(30)], CORPUS)
    asked = spark.createDataFrame([(q, "".join(rng.choice(list("甲乙丙丁 "), 6))) for q in range(8)], "qid long, query string")
    few = [tuple(r) for r in retrieval.bm25(corpus, asked, 5).orderBy("qid", "rank").collect()]
    monkeypatch.setattr(retrieval, "few", lambda df: None)
    many = [tuple(r) for r in retrieval.bm25(corpus, asked, 5).orderBy("qid", "rank").collect()]
    assert [t[:3] for t in few] == [t[:3] for t in many] and np.allclose([t[3] for t in few], [t[3] for t in many], atol=2e-6)


def test_candidate_phrases_equal_brute_force(spark):
    import math

    texts = ["甲乙丙丁戊己庚 辛", "甲乙丙丁戊己壬癸", "子丑寅卯", None]
    corpus = spark.createDataFrame([(i, i, "l", "n", t) for i, t in enumerate(texts)], CORPUS)
    plain = ["".join((t or "").split()) for t in texts]
    pairs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    df = {g: sum(g in pairs(s) for s in plain) for s in plain for g in pairs(s)}
    want = []
    for i, s in enumerate(plain):
        value = lambda p: round(sum(math.log(5.0 / (df[p[k : k + 2]] + 1)) for k in range(5)) / 5, 6)
        best = sorted({s[k : k + 6] for k in range(len(s) - 5)}, key=lambda p: (-value(p), p))[:3]
        want += [(i, r + 1, p, value(p)) for r, p in enumerate(best)]
    got = gold.candidate_phrases(corpus, gold.gram_frequencies(corpus), 4, 3).orderBy("row_idx", "rank").collect()
    assert [tuple(r)[:3] for r in got] == [w[:3] for w in want] and np.allclose([r.idf for r in got], [w[3] for w in want], atol=2e-6)


def test_ranks_of_few_rows_are_those_of_all(spark):
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, m, [float(x) for x in np.round(rng.normal(size=3), 1)]) for i in range(60) for m in ("a", "b")], "row_idx long, model string, vec array<double>")
    queries = spark.createDataFrame([(q, m, "v", [float(x) for x in rng.normal(size=3)]) for q in range(4) for m in ("a", "b")], "qid long, model string, variant string, vec array<double>")
    hits = spark.createDataFrame([(q, 5 * q + j) for q in range(4) for j in range(6)] + [(0, 999)], "qid long, row_idx long")
    every = {(r.qid, r.row_idx): r.sem for r in semantic.semantic_ranks(vectors, queries).collect()}
    got = {(r.qid, r.row_idx): r.sem for r in semantic.ranks_among(vectors, queries, hits).collect()}
    assert got == {k: every[k] for k in got} and len(got) == 24


def test_reranker_contract_and_retries(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 20)], "qid long, rank int, row_idx long")
    assert semantic.contract_violations(hits, hits.filter("rank = 1")).collect() == []
    bad = spark.createDataFrame([(1, 1, 10), (1, 3, 10), (1, 4, 99)], "qid long, rank int, row_idx long")
    assert {tuple(r) for r in semantic.contract_violations(hits, bad).collect()} == {(1, "strange row"), (1, "repeated row"), (1, "ranks with gaps"), (2, "nothing left")}
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("later")
        return x

    assert semantic.retried(flaky, pauses=(0,))(7) == 7 and len(calls) == 3
    with pytest.raises(ValueError):
        semantic.retried(lambda: (_ for _ in ()).throw(ValueError("no")), pauses=(0,))()
    assert semantic.first_available({"a": lambda: False, "b": lambda: True}) == "b" and semantic.first_available({"a": lambda: False}, "a") is None


def test_judge_requests_and_void_answers(spark):
    hits = spark.createDataFrame([(1, r, r, "问", "法", f"第{r}条", "文" * 500) for r in (1, 2)], "qid long, rank int, row_idx long, query string, law string, num string, text string")
    asked = json.loads(semantic.judge_requests(hits, most=5).first().request)
    assert asked["state"] == "问" and asked["questions"]["rank"]["criteria"] == {"1": "[1] 《法》第1条：文文文文文", "2": "[2] 《法》第2条：文文文文文"}
    assert set(json.loads(semantic.judge_requests(hits, "score").first().request)["questions"]) == {"c1", "c2"}
    void = spark.createDataFrame([(1, "[2 3, 5]"), (2, "[5, , 1]")], "qid long, answer string")
    assert [(r.qid, r.number) for r in semantic.pick_numbers(void).orderBy("ord").collect()] == [(2, 5), (2, 1)]
    scores = spark.createDataFrame([(1, 2, 0.9)], "qid long, row_idx long, judge_score double")
    got = semantic.judge_rerank(hits.select("qid", "rank", "row_idx"), scores, pick=1).orderBy("rank").collect()
    assert [(r.row_idx, r.judge_rank, r.judge_pick) for r in got] == [(2, 1, 1), (1, 2, 0)]
    untouched = semantic.judge_rerank(hits.select("qid", "rank", "row_idx"), scores.limit(0)).orderBy("rank").collect()
    assert [(r.row_idx, r.judge_pick) for r in untouched] == [(1, 0), (2, 0)]


def test_demonstration_corpus(spark):
    corpus = demo.synthetic_corpus(spark, 60)
    rows = corpus.collect()
    assert len({r.text for r in rows}) == 60 and {r.law for r in rows} == set(demo.LAWS) and rows[5].num == "第二条"
    assert corpus.collect() == demo.synthetic_corpus(spark, 60).collect() != demo.synthetic_corpus(spark, 60, 1).collect()
    made = gold.make_gold(corpus, 10)
    assert made.count() == 10 and demo.faults(corpus, made).collect() == []
    wrong = spark.createDataFrame([("a", "无此文", 1), ("b", "x", 999)], "qid string, query string, gold_id long")
    assert dict(demo.faults(corpus.union(corpus.limit(1)), wrong).collect()) == {"repeated id": 1, "query not in its article": 2, "gold without article": 1}


def paragraphs(spark, docs):
    return spark.createDataFrame([(d, i, x) for d, lines in docs.items() for i, x in enumerate(lines)], "doc long, pos int, line string")


def test_whole_documents(spark):
    body = ["正文" * 40 + "。"] * 3
    docs = {1: ["前言到此为止。", "某某法院", "关于某事的批复", *body], 2: ["关于某事的批复"], 3: ["通知", *body], 4: ["本规定已于某日通过）", "关于\ue001的规定", "关于他事的规定", *body], 5: ["关于某事的批复", *body[:-1], "没有句号" * 10]}
    got = {r.doc: r.text for r in produce.whole_documents(paragraphs(spark, docs)).collect()}
    assert got == {1: "某某法院关于某事的批复" + "".join(body), 4: "关于他事的规定" + "".join(body)}


def test_fragments(spark):
    good = ["第一条 甲方应当履行。", "第二条 乙方应当履行。"]
    docs = {1: good, 2: ["无条文"], 3: good}
    titles = spark.createDataFrame([(1, "甲法"), (3, "丙法")], "doc long, law string")
    got = produce.fragment(paragraphs(spark, docs), titles, 970000).orderBy("id").collect()
    assert [(r.id, r.law, r.num) for r in got] == [(970001, "甲法", "第一条"), (970002, "甲法", "第二条"), (970003, "丙法", "第一条"), (970004, "丙法", "第二条")]
    assert {r.doc: r.passes for r in produce.report(paragraphs(spark, docs)).collect()} == {1: True, 2: False, 3: True}
    d = spark.createDataFrame([(["2019年修订", "x", "y", "z", "2030"], "法2021.docx")], "p array<string>, n string")
    assert d.select(produce.source_year(F.col("p"), F.col("n")), produce.version_line(F.col("p"))).first()[:] == (2021, "2019年修订")
    s = spark.createDataFrame([(1, 2019, "2020-01-01"), (2, 2020, "2020"), (3, None, "2020"), (4, 2019, "")], "doc long, source_year int, base_date string")
    assert dict(produce.stale(s).collect()) == {1: True, 2: False, 3: False, 4: False}
    corpus = spark.createDataFrame([(1, 1, "法", "一", "有 此文"), (2, 2, "法", "二", "别的")], CORPUS)
    own = spark.createDataFrame([("a", [9], ["无"], "旧"), ("b", [2], ["法 二"], "别")], "qid string, gold_ids array<long>, gold_laws array<string>, evidence string")
    patch = spark.createDataFrame([("a", [1], ["法 一"], "有此文")], own.schema)
    assert {r.qid: r.gold_ids for r in produce.patched(own, patch, corpus).collect()} == {"a": [1], "b": [2]}
    with pytest.raises(ValueError):
        produce.patched(own, patch.withColumn("evidence", F.lit("没有")), corpus)


def test_rebuild_rules(spark):
    base = spark.createDataFrame([(1, 1, "甲", "一", "x"), (2, 2, "乙", "一", "第一条 a 第二条 b"), (3, 3, "乙", "二", "第三条 c"), (4, 4, "丙", "一", "z"), (5, 5, "丁", "一", "w")], CORPUS)
    new = spark.createDataFrame([("甲", 1, "一", "n", 1), ("丁", 2, "二", "q", 1), ("丁", 1, "一", "p", 1)], "law string, ord long, num string, text string, priority int")
    rules = spark.createDataFrame([("甲", "keep"), ("乙", "drop-pageblock"), ("丙", "drop")], "law string, rule string")
    got = etl.rebuild(base, new, rules=rules).orderBy("row_idx").collect()
    assert [(r.row_idx, r.id, r.text) for r in got] == [(1, 1, "x"), (3, 3, "第三条 c"), (6, 995001, "p"), (7, 995002, "q")]


def test_mean_vectors_and_tokens(spark):
    rows = spark.createDataFrame([(1, 1, "ab", "1", "cd 甲"), (2, 2, "x", "y", None)], CORPUS)
    lists = variants.token_lists(rows)
    assert {r.row_idx: r.tokens for r in lists.collect()} == {1: ["ab", "1", "ab", "1", "cd", "甲"], 2: ["x", "y", "x", "y"]}
    vocabulary = spark.createDataFrame([("ab", [1.0, 0.0]), ("cd", [0.0, 1.0])], "token string, vec array<double>")
    idf = spark.createDataFrame([("ab", 1.5), ("cd", 4.0)], "token string, idf double")
    assert {r.row_idx: r.vec for r in variants.mean_vectors(lists, vocabulary, idf, 2).collect()} == {1: pytest.approx([0.6, 0.8])}
    k = spark.createDataFrame([("7",), ("x",), ("0",), ("99",), (None,)], "k string")
    assert [r[0] for r in k.select(variants.clamped(F.col("k"))).collect()] == [7, 5, 1, 50, 5]


def test_readers_and_reports(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"id": str(i), "law": "l", "num": "n", "text": f"t{i}"}) + "\n" * (i % 3 == 0) for i in range(20)))
    assert [(r.row_idx, r.text) for r in files.corpus_lines(spark, str(tmp_path / "c.jsonl")).orderBy("row_idx").collect()] == [(i, f"t{i}") for i in range(20)]
    rows = spark.createDataFrame([(1, "a", "一", "x " * 30), (2, "a", "二", "(cid:3)" + "y" * 40), (3, "a", "三", "short"), (4, "a", "四", " "), (5, "a", "五", None)], "id long, law string, num string, text string")
    assert sinks.write_corpus(rows, str(tmp_path / "out")) == {"total": 5, "imported": 1, "cid": 1, "short": 1, "empty": 2}
    assert spark.read.json(str(tmp_path / "out")).first().text == " ".join(["x"] * 30)
    vectors = spark.createDataFrame([(1, "m", [0.5, -1.25])], "row_idx long, model string, vec array<double>")
    sinks.write_vectors(vectors, str(tmp_path / "v"))
    assert [tuple(r) for r in sinks.read_vectors(spark, str(tmp_path / "v")).collect()] == [(1, "m", [0.5, -1.25])]
    np.savez(tmp_path / "a.npz", ids=np.array([3, 4]), vecs=np.eye(2, dtype=np.float16))
    assert {tuple(map(str, r)) for r in files.npz_vectors(spark, str(tmp_path), "m").collect()} == {("3", "m", "[1.0, 0.0]"), ("4", "m", "[0.0, 1.0]")}
    corpus = spark.createDataFrame([(1, 1, "l", "n", "t"), (2, 2, "l", "n", "t")], CORPUS)
    assert {tuple(r) for r in files.misaligned(vectors.union(vectors).union(vectors.withColumn("row_idx", F.lit(9))), corpus).collect()} == {(1, "several vectors"), (2, "no vector"), (9, "no row")}
    assert files.labelled_path("a = b") == ("a", "b") and files.labelled_path("x/y.jsonl") == ("y.jsonl", "x/y.jsonl")
    lines = files.database_lines(spark.createDataFrame([(1, " a \n\n　b\n")], "k long, c string"), "k", "c")
    assert [r.line for r in lines.orderBy("pos").collect()] == ["a", "b"]
    tree = json.dumps([{"title": "科目", "children": [{"title": "甲", "id": 1, "children": [{"title": "乙", "id": 2}]}, {"title": "丙"}]}])
    got = audit.catalog_tree(spark.createDataFrame([(tree,)], "value string"))
    assert {tuple(r) for r in got.collect()} == {("科目", "甲", 1, True), ("科目", "丙", None, False), ("科目", "乙", 2, False)}
    found = spark.createDataFrame([("like", 5, 3, 0.5, 0.25)], "retriever string, k int, n long, recall_at_k double, mrr double")
    assert "| like | 5 | 50.0% | 0.250 |" in sinks.metrics_report(found, 10, "x")
    review = spark.createDataFrame([("q1", "问" * 40, "法", "一", ["法 一", "法 二"], "证|据", None, None, "pending"), ("q2", "问", "法", "一", ["法 一"], "e", "s", "u", "✓")], "qid string, query string, law string, num string, gold_laws array<string>, evidence string, source_site string, source_url string, status string")
    sheet = sinks.worksheet(review)
    assert "☐ 1" in sheet and "✓ 1" in sheet and "问" * 30 + "…" in sheet and "法 一; 法 二" in sheet and "证\\|据" in sheet
    status = evaluate.with_review(spark.createDataFrame([("a",), ("b",)], "qid string"), spark.createDataFrame([("a", "ok", None, None)], "qid string, status string, reviewer string, date string"))
    assert {r.qid: r.status for r in status.collect()} == {"a": "ok", "b": "pending"}


def _grid(spark, monkeypatch):
    """Vectors with many ties over more blocks than one, and two variants of each query; sims by numpy."""
    monkeypatch.setattr(semantic, "QUERY_BLOCK", 7)
    monkeypatch.setattr(semantic, "VECTOR_BLOCK", 30)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (200, 4)) / 4
    vectors = spark.createDataFrame([(i, "m", v.tolist()) for i, v in enumerate(x)], "row_idx long, model string, vec array<double>")
    queries = spark.createDataFrame([(i - i % 10, "m", "qe"[i % 10], x[i].tolist()) for i in range(200) if i % 10 < 2], "qid long, model string, variant string, vec array<double>")
    sem = {}
    for i in range(200):
        if i % 10 < 2:
            sim = np.round(x @ x[i], 6)
            for r, j in enumerate(np.lexsort((np.arange(200), -sim)).tolist()):
                sem[i - i % 10, j] = min(sem.get((i - i % 10, j), 999), r + 1)
    return vectors, queries, x, sem


def test_semantic_ranks_over_a_grid_of_blocks(spark, monkeypatch):
    vectors, queries, _, sem = _grid(spark, monkeypatch)
    # no set of query vectors is too large, as none is collected
    got = {(r.qid, r.row_idx): r.sem for r in semantic.semantic_ranks(vectors, queries, 9).collect()}
    assert got == {k: v for k, v in sem.items() if v <= 9}
    hits = spark.createDataFrame([(q, (q * 3 + k) % 230) for q in range(0, 200, 10) for k in range(4)], "qid long, row_idx long")
    few = {(r.qid, r.row_idx) for r in hits.collect()}
    assert {(r.qid, r.row_idx): r.sem for r in semantic.ranks_among(vectors, queries, hits).collect()} == {k: v for k, v in sem.items() if k in few}
    both = [(r.qid, r.row_idx, r.sem) for r in semantic.ranks_and_pool(vectors, queries, hits, 9).collect()]
    assert sorted(both) == sorted((*k, v) for k, v in sem.items() if v <= 9 or k in few)


def test_pair_similarities_form_no_other_pairs(spark, monkeypatch):
    vectors, queries, x, _ = _grid(spark, monkeypatch)
    hits = spark.createDataFrame([(0, 5), (0, 999), (10, 6), (77, 1)], "qid long, row_idx long")
    got = {(r.qid, r.variant, r.row_idx): r.sim for r in semantic.pair_similarities(vectors, queries, hits).collect()}
    assert got == {(0, "q", 5): round(x[0] @ x[5], 6), (0, "e", 5): round(x[1] @ x[5], 6), (10, "q", 6): round(x[10] @ x[6], 6), (10, "e", 6): round(x[11] @ x[6], 6)}


def test_grams_are_counted_where_they_are_read(spark):
    texts = ["ab ab", None, "", "x", "x\x00", "ab" * 9, "😀ab"]
    rows = spark.createDataFrame([(i, i, "l", "n", t) for i, t in enumerate(texts)], CORPUS)
    own = [[t[i : i + 2] for i in range(max(1, len(t) - 1))] if t else [] for t in ((t or "").replace(" ", "") for t in texts)]
    every = {g: (sum(g in o for o in own), sum(o.count(g) for o in own)) for o in own for g in o}
    table = grams.gram_table(rows)
    assert {r.gram: (r.df, r.tf) for r in table.collect()} == every
    sizes = grams.gram_sizes(rows)
    assert {r.row_idx: (r.grams, r.distinct_grams) for r in sizes.collect()} == {i: (len(o), len(set(o))) for i, o in enumerate(own) if o}
    assert "Exchange" not in sizes._jdf.queryExecution().executedPlan().toString()
    assert grams.numbered(rows) and not grams.numbered(rows.union(rows))


def test_phrases_and_gold_move_no_windows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrst "), n)) for n in [0, 5, 6, 12, 40] * 8] + ["ab" * 200, None]
    rows = spark.createDataFrame([(i, i, "l", "n", t) for i, t in enumerate(texts)], CORPUS)
    df = gold.gram_frequencies(rows)
    found = gold.candidate_phrases(rows, df, 42, 5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, gold._joined_phrases(rows, df, 42, 5).collect()))
    phrases = [r.phrase for r in found.select("phrase").distinct().collect()]
    want = {r.phrase for r in gold.phrase_frequency(found, rows).filter("rows = 1").collect()}
    assert want and gold._own_phrases(phrases, rows) == want
    made = gold.make_gold(rows, 30).collect()
    monkeypatch.setattr(gold, "PORTION", 3)
    assert gold.make_gold(rows, 2).count() == 2 and {r.gold_id for r in gold.make_gold(rows, 1).collect()} <= {r.gold_id for r in made}


def test_gold_and_channels_are_searched_once(spark):
    once = lambda df: df.mapInArrow(lambda parts: parts, df.schema)
    gold_rows = once(spark.createDataFrame([(1, [7, 8]), (2, []), (3, [9])], "qid long, gold_ids array<long>"))
    lists = once(spark.createDataFrame([(1, "bm25", 1.0, 2, 7), (1, "like", 1.0, 1, 8), (1, "expand", 1.5, 1, 5), (3, "expand", 1.5, 1, 9)], "qid long, channel string, weight double, rank int, row_idx long"))
    hits = evaluate.hits_in(gold_rows, retrieval.told_apart(lists), ["like", "bm25", "hybrid"])
    assert {tuple(r) for r in hits.collect()} == {(1, 1, 2, 2), (2, None, None, None), (3, None, None, 1)}
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    one = evaluate.first_hits(gold_rows, retrieval.rrf(lists))
    assert {tuple(r) for r in one.collect()} == {(1, 2), (2, None), (3, 1)}
    assert one._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
