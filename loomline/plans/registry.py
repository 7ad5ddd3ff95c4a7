"""Every query of the retrieval engine with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.expansion import expand_query
from ..operators import audit, demo, etl, evaluate, gold, grams, produce, retrieval, semantic, variants
from . import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name`` with its SQL."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: S.plain(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


# --- retrieval


@query("x1_bm25_top10", f"WITH {S.SQL_CORPUS}, {S.SQL_QUERIES}, {S.SQL_GRAMS}, {S.sql_bm25('b', 'q')} SELECT qid, rank, row_idx, score FROM b")
def _(spark, sf):
    return retrieval.bm25(S.corpus(spark, sf), S.questions(spark, sf)).select("qid", "rank", "row_idx", "score")


@query("x2_like_top10", f"WITH {S.SQL_CORPUS}, {S.SQL_QUERIES}, {S.sql_like('l')} SELECT qid, rank, row_idx, position FROM l")
def _(spark, sf):
    return retrieval.like(S.corpus(spark, sf), S.questions(spark, sf)).select("qid", "rank", "row_idx", "position")


@query("x3_channels", f"WITH {S.sql_channels()} SELECT qid, channel, weight::DOUBLE AS weight, rank, row_idx FROM ch")
def _(spark, sf):
    return retrieval.channels(S.corpus(spark, sf), S.questions(spark, sf), S.SYNONYMS)


@query("x4_rrf_hybrid", f"WITH {S.sql_channels()} SELECT qid, rank, row_idx, score, channels FROM f WHERE rank <= 20")
def _(spark, sf):
    fused = retrieval.rrf(retrieval.channels(S.corpus(spark, sf), S.questions(spark, sf), S.SYNONYMS), 20)
    return fused.select("qid", "rank", "row_idx", "score", F.array_join("channels", ",").alias("channels"))


def _pool(spark, sf):
    """The semantic pool of the questions that have a vector, that of their own number."""
    asked = S.read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    own = S.vectors(spark, sf).withColumnRenamed("row_idx", "qid").join(asked, "qid").select("qid", "model", F.lit("q").alias("variant"), "vec")
    return semantic.semantic_pool(S.vectors(spark, sf), own)


@query(
    "x5_recall_with_trace",
    f"""WITH {S.sql_channels()}, gate AS (SELECT DISTINCT qid FROM l), v AS (SELECT vec_id AS row_idx, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
pv AS (SELECT item_id AS qid, x AS y FROM benchmark JOIN v ON row_idx = item_id),
pr AS (SELECT * FROM (SELECT qid, row_idx, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(x, y), 6) DESC, row_idx) AS sem FROM v CROSS JOIN pv) WHERE sem <= 50),
p AS (SELECT qid, row_idx, row_number() OVER (PARTITION BY qid ORDER BY sem) AS place FROM pr z WHERE qid NOT IN (SELECT qid FROM gate) AND NOT EXISTS (SELECT 1 FROM f WHERE f.qid = z.qid AND f.row_idx = z.row_idx)),
n AS (SELECT qid, max(rank) AS n FROM f GROUP BY qid)
SELECT qid, rank, row_idx, score, channels FROM f
UNION ALL SELECT qid, place + coalesce(n, 0), row_idx, 0.0::DOUBLE, 'semantic' FROM p LEFT JOIN n USING (qid)""",
)
def _(spark, sf):
    hybrid = retrieval.Hybrid(S.corpus(spark, sf), S.SYNONYMS, _pool(spark, sf))
    out = hybrid.recall_with_trace(S.questions(spark, sf))
    return out.select("qid", "rank", "row_idx", "score", F.array_join("channels", ",").alias("channels"))


@query(
    "x6_search_citations",
    f"""WITH {S.sql_channels()} SELECT qid, rank, doc_id AS id, source AS law, lang AS num, md5(d.text) AS text_md5, round(score, 6) AS score, 'hybrid' AS retriever
FROM f JOIN documents d ON d.doc_id = f.row_idx WHERE rank <= 5""",
)
def _(spark, sf):
    hits = retrieval.Hybrid(S.corpus(spark, sf), S.SYNONYMS).search(S.questions(spark, sf), 5)
    return hits.select("qid", "rank", "id", "law", "num", F.md5(F.encode("text", "utf-8")).alias("text_md5"), "score", "retriever")


@query(
    "x11_parameter_scan",
    f"WITH {S.SQL_CORPUS}, {S.SQL_GRAMS}, q AS (SELECT qid, query, v.b FROM (SELECT item_id AS qid, trim(regexp_replace(substr(text, 1, 20), '{S.WS}', ' ', 'g')) AS query FROM benchmark) CROSS JOIN (VALUES (0.75::DOUBLE), (0.6), (0.5), (0.0)) v(b)), {S.sql_bm25('p', 'q', 'b', 5, 'b')} SELECT b, qid, rank, row_idx, score FROM p",
)
def _(spark, sf):
    return retrieval.parameter_scan(S.corpus(spark, sf), S.questions(spark, sf), [0.75, 0.6, 0.5, 0.0], 5).select("b", "qid", "rank", "row_idx", "score")


@query(
    "a1_index_stats",
    f"WITH {S.SQL_CORPUS}, {S.SQL_GRAMS}, p AS (SELECT gram, row_idx, count(*) AS tf FROM dg GROUP BY ALL) SELECT (SELECT n FROM tt) AS n, (SELECT round(avg_dl, 6) FROM tt) AS avg_dl, count(*) AS postings, count(DISTINCT gram) AS grams, sum(tf)::BIGINT AS tokens FROM p",
)
def _(spark, sf):
    rows = S.corpus(spark, sf)
    index = retrieval.Index(rows)
    p = grams.gram_table(rows) if grams.numbered(rows) else index.postings().groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    p = p.agg(F.sum("df").alias("postings"), F.count("*").alias("grams"), F.sum("tf").alias("tokens"))
    return index.totals.select("n", F.round("avg_dl", 6).alias("avg_dl")).crossJoin(p)  # one row each


@query("a2_gram_frequency_top", f"WITH {S.SQL_CORPUS}, {S.SQL_GRAMS} SELECT gram, count(DISTINCT row_idx) AS df FROM dg GROUP BY gram ORDER BY df DESC, gram LIMIT 100")
def _(spark, sf):
    return gold.gram_frequencies(S.corpus(spark, sf)).orderBy(F.desc("df"), "gram").limit(100)


@query("p19_query_guard", f"SELECT conv_id, turn, substr(s, 1, 200) AS query, length(s) > 200 AS truncated, s = '' AS empty FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '{S.WS}', ' ', 'g')) AS s FROM conversations)")
def _(spark, sf):
    q = S.read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("query"))
    return retrieval.guarded(q).select("qid.conv_id", "qid.turn", "query", "truncated", "empty")


@query("s22_query_source", "SELECT doc_id AS qid, substr(text, 1, 12) AS query FROM documents ORDER BY doc_id LIMIT 100")
def _(spark, sf):
    return S.corpus(spark, sf).select(F.col("row_idx").alias("qid"), F.substring("text", 1, 12).alias("query")).orderBy("qid").limit(100)


# --- evaluation

_HITS = f"""{S.sql_channels()}, {S.SQL_GOLD},
h AS (SELECT z.qid, min(f.rank) AS hit FROM (SELECT DISTINCT qid FROM g) z LEFT JOIN g ON g.qid = z.qid LEFT JOIN f ON f.qid = g.qid AND f.row_idx = g.row_idx GROUP BY z.qid),
hb AS (SELECT z.qid, min(b.rank) AS hit FROM (SELECT DISTINCT qid FROM g) z LEFT JOIN g ON g.qid = z.qid LEFT JOIN b ON b.qid = g.qid AND b.row_idx = g.row_idx GROUP BY z.qid)"""


def _hits(spark, sf):
    return evaluate.first_hits(S.gold(spark, sf), retrieval.Hybrid(S.corpus(spark, sf), S.SYNONYMS).recall_with_trace(S.questions(spark, sf)))


_RETRIEVERS = ["like", "bm25", "hybrid"]


def _told_hits(spark, sf):
    """First hits of the three retrievers: the first two are channels of the third, at the same depth."""
    lists = retrieval.channels(S.corpus(spark, sf), S.questions(spark, sf), S.SYNONYMS)
    return evaluate.hits_in(S.gold(spark, sf), retrieval.told_apart(lists), _RETRIEVERS)


@query("a6_recall_mrr", f"WITH {_HITS} SELECT count(*) AS n, 5::BIGINT AS k, round(avg(CASE WHEN hit <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_k, round(avg(CASE WHEN hit <= 5 THEN 1.0::DOUBLE / hit ELSE 0 END), 6) AS mrr FROM h")
def _(spark, sf):
    return evaluate.recall_mrr(_hits(spark, sf))


@query("a7_multi_k", f"WITH {_HITS} SELECT k, count(*) AS n, round(avg(CASE WHEN hit <= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_k, round(avg(CASE WHEN hit <= k THEN 1.0::DOUBLE / hit ELSE 0 END), 6) AS mrr FROM h CROSS JOIN (VALUES (5::BIGINT), (10), (20), (30)) v(k) GROUP BY k")
def _(spark, sf):
    return evaluate.multi_k(_hits(spark, sf))


@query(
    "a8_rank_histogram",
    f"WITH {_HITS}, bk AS (SELECT CASE WHEN hit IS NULL OR hit > 30 THEN 'miss' WHEN hit = 1 THEN '1' WHEN hit <= 5 THEN '2-5' WHEN hit <= 10 THEN '6-10' ELSE '11-30' END AS bucket FROM h) SELECT v.bucket, count(bk.bucket) AS n FROM (VALUES ('1'), ('2-5'), ('6-10'), ('11-30'), ('miss')) v(bucket) LEFT JOIN bk ON bk.bucket = v.bucket GROUP BY v.bucket",
)
def _(spark, sf):
    return evaluate.rank_histogram(_hits(spark, sf))


@query("a9_rerank_metrics", "WITH " + _HITS + " SELECT " + ", ".join(f"round(avg(CASE WHEN hit <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS r{k}" for k in (1, 5, 10, 20, 30)) + ", round(avg(CASE WHEN hit <= 5 THEN 1.0::DOUBLE / hit ELSE 0 END), 6) AS mrr5, count(*) FILTER (hit IS NULL) AS miss_in_pool FROM h")
def _(spark, sf):
    return evaluate.rerank_metrics(_hits(spark, sf))


@query("a10_rescues", f"WITH {_HITS} SELECT count(*) FILTER (NOT coalesce(hb.hit <= 5, false) AND coalesce(h.hit <= 5, false)) AS rescued, count(*) FILTER (coalesce(hb.hit <= 5, false) AND NOT coalesce(h.hit <= 5, false)) AS demoted FROM hb JOIN h USING (qid)")
def _(spark, sf):
    return evaluate.rescued(_told_hits(spark, sf), "bm25", "hybrid")


@query("a11_latency", "WITH s AS (SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, list_sort(list(value)) AS v FROM events GROUP BY event_type) SELECT event_type, n, mean, median, v[least(floor(n * 0.95)::INT, n::INT - 1) + 1] AS p95, v[greatest(least(round_even(0.5 * n + 0.5, 0)::INT - 1, n::INT - 1), 0) + 1] AS rank_p50, v[greatest(least(round_even(0.99 * n + 0.5, 0)::INT - 1, n::INT - 1), 0) + 1] AS rank_p99 FROM s")
def _(spark, sf):
    return evaluate.latency(S.read(spark, sf, "events"), "value", "event_type")


_LIKE_HITS = "hl AS (SELECT z.qid, min(l.rank) AS hit FROM (SELECT DISTINCT qid FROM g) z LEFT JOIN g ON g.qid = z.qid LEFT JOIN l ON l.qid = g.qid AND l.row_idx = g.row_idx GROUP BY z.qid)"


@query("x9_three_retrievers", f"WITH {_HITS}, {_LIKE_HITS}, ev AS (SELECT 'like' AS retriever, hit FROM hl UNION ALL SELECT 'bm25', hit FROM hb UNION ALL SELECT 'hybrid', hit FROM h) SELECT retriever, k, count(*) AS n, round(avg(CASE WHEN hit <= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_k, round(avg(CASE WHEN hit <= k THEN 1.0::DOUBLE / hit ELSE 0 END), 6) AS mrr FROM ev CROSS JOIN (VALUES (5::BIGINT), (10), (20), (30)) v(k) GROUP BY retriever, k")
def _(spark, sf):
    return evaluate.compared_hits(_told_hits(spark, sf), _RETRIEVERS)


@query("x10_per_question", f"WITH {_HITS}, {_LIKE_HITS} SELECT qid, coalesce(hl.hit, 0) AS \"like\", coalesce(hb.hit, 0) AS bm25, coalesce(h.hit, 0) AS hybrid, coalesce(least(hl.hit, hb.hit, h.hit), 0) AS best, array_to_string(list_filter([CASE WHEN hl.hit IS NULL THEN 'like' END, CASE WHEN hb.hit IS NULL THEN 'bm25' END, CASE WHEN h.hit IS NULL THEN 'hybrid' END], lambda x: x IS NOT NULL), ',') AS missed_by FROM h JOIN hb USING (qid) JOIN hl USING (qid)")
def _(spark, sf):
    return evaluate.told_hits(_told_hits(spark, sf), _RETRIEVERS).fillna(0)


@query("x11_weight_grid", f"WITH {S.sql_channels()}, {S.SQL_GOLD}, w(weight) AS (VALUES (1.0::DOUBLE), (1.25), (1.5), (1.75), (2.5), (5.0)), fw AS (SELECT *, row_number() OVER (PARTITION BY gw, qid ORDER BY score DESC, row_idx) AS rank FROM (SELECT w.weight AS gw, qid, row_idx, round(sum((CASE WHEN channel = 'expand' THEN w.weight ELSE ch.weight::DOUBLE END) / (60 + rank)), 9) AS score FROM ch CROSS JOIN w GROUP BY ALL)), hw AS (SELECT w.weight, z.qid, min(fw.rank) AS hit FROM (SELECT DISTINCT qid FROM g) z CROSS JOIN w LEFT JOIN g ON g.qid = z.qid LEFT JOIN fw ON fw.gw = w.weight AND fw.qid = g.qid AND fw.row_idx = g.row_idx GROUP BY w.weight, z.qid) SELECT weight, k, count(*) AS n, round(avg(CASE WHEN hit <= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_k, round(avg(CASE WHEN hit <= k THEN 1.0::DOUBLE / hit ELSE 0 END), 6) AS mrr FROM hw CROSS JOIN (VALUES (5::BIGINT), (10), (20), (30)) v(k) GROUP BY weight, k")
def _(spark, sf):
    return variants.weight_grid(S.corpus(spark, sf), S.questions(spark, sf), S.SYNONYMS, S.gold(spark, sf))


@query("p18_gates", f"WITH {S.SQL_CORPUS}, {S.SQL_QUERIES}, e AS (SELECT DISTINCT qid FROM q JOIN c ON instr(text, query) > 0) SELECT qid, qid NOT IN (SELECT qid FROM e) AS gate_a, qid NOT IN (SELECT qid FROM e) AND length(query) <= 12 AS gate_b FROM q")
def _(spark, sf):
    asked = S.questions(spark, sf)
    return variants.gates(asked, retrieval.like(S.corpus(spark, sf), asked, 1))


@query("j15_gold_by_pair", "WITH g AS (SELECT item_id AS qid, 'src' || (item_id % 25) AS law, 'en' AS num, CASE WHEN item_id % 4 = 0 THEN [item_id] END AS own FROM benchmark) SELECT qid, coalesce(array_to_string(CASE WHEN own IS NOT NULL THEN own ELSE (SELECT list(doc_id ORDER BY doc_id) FROM documents WHERE source = law AND lang = num) END, ','), '') AS gold_ids FROM g")
def _(spark, sf):
    b = S.read(spark, sf, "benchmark")
    g = b.select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 25).alias("law"), F.lit("en").alias("num"), F.when(F.col("item_id") % 4 == 0, F.array("item_id")).alias("gold_ids"))
    return evaluate.gold_by_pair(g, S.corpus(spark, sf)).select("qid", F.array_join(F.transform("gold_ids", lambda x: x.cast("string")), ",").alias("gold_ids"))


@query("j14_review_status", "SELECT item_id AS qid, coalesce(CASE quality WHEN 1 THEN 'ok' WHEN 0 THEN 'doubt' END, 'pending') AS status FROM benchmark LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) ON doc_id = item_id")
def _(spark, sf):
    gold_rows = S.read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    none = F.lit(None).cast("string")
    status = S.read(spark, sf, "labels").groupBy(F.col("doc_id").alias("qid")).agg(F.max("quality").alias("q")).select("qid", F.when(F.col("q") == 1, "ok").when(F.col("q") == 0, "doubt").alias("status"), none.alias("reviewer"), none.alias("date"))
    return evaluate.with_review(gold_rows, status).select("qid", "status")


@query("a23_distribution", "SELECT 'role' AS field, coalesce(role, '-') AS value, count(*) AS n FROM conversations GROUP BY role UNION ALL SELECT 'turn', coalesce(turn::VARCHAR, '-'), count(*) FROM conversations GROUP BY turn")
def _(spark, sf):
    return evaluate.distribution(S.read(spark, sf, "conversations"), "role", "turn")


@query("a25_validation_totals", "WITH c AS (SELECT o_orderstatus AS source, o_custkey AS law, count(*) AS g, count(*) FILTER (o_orderpriority <> '5-LOW') AS e FROM orders GROUP BY ALL) SELECT source, sum(g)::BIGINT AS gold, sum(e)::BIGINT AS exact, count(*) FILTER (g = e) AS \"full\" FROM c GROUP BY source")
def _(spark, sf):
    o = S.read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("source"), F.col("o_custkey").alias("law")).agg(F.count("*").alias("gold_rows"), F.count_if(F.col("o_orderpriority") != "5-LOW").alias("exact_hits"))
    return evaluate.validation_totals(o)


@query("a13_cost", "SELECT p_brand AS model, round(sum((p_size * 2.0::DOUBLE + p_partkey * 6.0::DOUBLE) / 1e6), 6) AS usd FROM part GROUP BY p_brand")
def _(spark, sf):
    part = S.read(spark, sf, "part")
    prices = part.select(F.col("p_brand").alias("model")).distinct().select("model", F.lit(2.0).alias("price_in"), F.lit(6.0).alias("price_out"))
    return evaluate.cost(part.select(F.col("p_brand").alias("model"), F.col("p_size").alias("tokens_in"), F.col("p_partkey").alias("tokens_out")), prices)


@query("f27_token_lists", "WITH t AS (SELECT doc_id AS row_idx, regexp_extract_all(lower(nfc_normalize(source || ' ' || lang)), '[a-z0-9]+') AS head, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[a-z0-9]+') AS body FROM documents) SELECT row_idx, 2 * len(head) + len(body) AS tokens, list_distinct(head)[1] IS NOT NULL AS headed FROM t")
def _(spark, sf):
    t = variants.token_lists(S.corpus(spark, sf))
    return t.select("row_idx", F.size("tokens").alias("tokens"), (F.size("tokens") > 0).alias("headed"))


# --- gates, audit, coverage


@query("p2_import_classes", f"WITH s AS (SELECT regexp_replace(coalesce(text, ''), '^{S.WS}|{S.WS}$', '', 'g') AS t FROM documents) SELECT CASE WHEN t = '' THEN 'empty' WHEN contains(t, '(cid:') THEN 'cid' WHEN length(t) < 30 THEN 'short' ELSE 'imported' END AS status, count(*) AS n FROM s GROUP BY 1")
def _(spark, sf):
    return S.corpus(spark, sf).groupBy(etl.import_status(F.col("text")).alias("status")).agg(F.count("*").alias("n"))


_AUTHORED = [
    (-1, 1, "甲法", "第一条", "公 报 全国人民代表大会常务委员会公报 各 栏 的 文 字 都 很 短"), (-2, 2, "甲法", "第二条", "左 栏 右 栏 交 错 —１２— 的 文 字 页 面"), (-3, 3, "甲法", "全文", "整 篇 单 元 的 文 字 都 在 这 一 行 里 了"),
    (-4, 900001, "乙法", "第一条", "窄 栏 但 来 源 不 是 公 报 的 一 行 文 字"), (-5, 5, "乙法", "第二条", "太短"), (-6, 6, "乙法", "第二条", ""),
]
_AUTHORED_SQL = ", ".join(f"({a}, {b}, '{c}', '{d}', '{e}')" for a, b, c, d, e in _AUTHORED)


def _rows(spark, sf):
    """Documents as audited rows, numbers running over all id ranges, and authored rows that raise the other flags."""
    none = F.lit(None).cast("string")
    rows = S.corpus(spark, sf).withColumn("id", F.col("id") * 1000).withColumns({"source": none, "unit": none, "num_origin": F.when(F.col("row_idx") % 7 == 0, "x")})
    return rows.unionByName(spark.createDataFrame([(*r, None, None, None) for r in _AUTHORED], "row_idx long, id long, law string, num string, text string, source string, unit string, num_origin string"))


_FLAGS = f"""c AS (SELECT *, count(*) OVER (PARTITION BY law, num) AS twice FROM (SELECT doc_id AS row_idx, doc_id * 1000 AS id, source AS law, lang AS num, coalesce(text, '') AS text, CASE WHEN doc_id % 7 = 0 THEN 'x' END AS num_origin FROM documents
  UNION ALL SELECT *, NULL FROM (VALUES {_AUTHORED_SQL}))),
m AS (SELECT *, CASE WHEN id >= 980000 THEN 'flk' WHEN id >= 970000 THEN 'zhuma' WHEN id >= 900000 THEN 'docx' ELSE 'gazette' END AS origin,
  list_sort(list_transform(list_filter(regexp_split_to_array(text, '{S.WS}'), lambda w: w <> ''), lambda w: length(w))) AS ls FROM c),
k AS (SELECT *, len(ls) > 0 AND ls[len(ls) // 2 + 1] < 20 AND origin = 'gazette' AS narrow, contains(text, '{audit.FURNITURE}') OR regexp_matches(text, '{audit.PAGE_MARK}') AS furniture FROM m),
fl AS (SELECT *, list_filter([CASE WHEN length(regexp_replace(text, '{S.WS}', '', 'g')) < 10 THEN 'empty-or-tiny' END, CASE WHEN length(text) > 2000 THEN 'very-long' END,
  CASE WHEN num = '{audit.WHOLE}' THEN 'whole-document' END, CASE WHEN num_origin IS NOT NULL AND num_origin IS DISTINCT FROM num THEN 'num-mapped' END, CASE WHEN twice > 1 THEN 'dup-law-num' END,
  CASE WHEN narrow AND furniture THEN 'polluted-interleave' END, CASE WHEN narrow AND NOT furniture THEN 'narrow-no-furniture' END], lambda x: x IS NOT NULL) AS flags FROM k)"""


@query("p11_row_flags", f"WITH {_FLAGS} SELECT row_idx, origin, array_to_string(flags, ',') AS flags FROM fl")
def _(spark, sf):
    return audit.row_flags(_rows(spark, sf)).select("row_idx", "origin", F.array_join("flags", ",").alias("flags"))


@query("a14_corpus_stats", f"WITH {_FLAGS} SELECT origin, count(*) AS rows, count(DISTINCT law) AS laws FROM fl GROUP BY origin")
def _(spark, sf):
    return audit.corpus_stats(audit.row_flags(_rows(spark, sf)))


@query("a16_flag_counts", f"WITH {_FLAGS} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM fl) GROUP BY flag")
def _(spark, sf):
    return audit.flag_counts(audit.row_flags(_rows(spark, sf)))


@query("t8_problem_laws", f"WITH {_FLAGS} SELECT law, count(*) AS rows, sum(len(flags))::BIGINT AS flagged FROM fl GROUP BY law HAVING sum(len(flags)) > 0 ORDER BY flagged DESC, law LIMIT 20")
def _(spark, sf):
    return audit.problem_laws(audit.row_flags(_rows(spark, sf)))


_BY_FLAG = ", ".join(f"count(*) FILTER (list_contains(flags, '{n}')) AS {n.replace('-', '_')}" for n in audit.FLAGS)


@query("a16_audit_by_source", f"WITH {_FLAGS} SELECT origin, count(*) AS rows, sum(len(flags))::BIGINT AS flagged, {_BY_FLAG} FROM fl GROUP BY origin")
def _(spark, sf):
    return audit.audit(audit.row_flags(_rows(spark, sf)), "origin")


@query("a16_audit_by_law", f"WITH {_FLAGS} SELECT law, count(*) AS rows, sum(len(flags))::BIGINT AS flagged, {_BY_FLAG} FROM fl GROUP BY law")
def _(spark, sf):
    return audit.audit(audit.row_flags(_rows(spark, sf)), "law")


@query("a14_multi_source", f"WITH {_FLAGS} SELECT law AS title, count(DISTINCT origin) AS origins FROM fl GROUP BY law HAVING count(DISTINCT origin) > 1")
def _(spark, sf):
    return audit.multi_source(audit.row_flags(_rows(spark, sf)))


@query("a15_uncovered", "SELECT DISTINCT 'src' || (p_partkey % 40) AS title FROM part WHERE 'src' || (p_partkey % 40) NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def _(spark, sf):
    catalog = S.read(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("src"), F.col("p_partkey") % 40).alias("title"))
    return audit.uncovered(audit.coverage(catalog, S.corpus(spark, sf)))


@query("a15_title_duplicates", "SELECT 't' || (p_partkey % 50) AS key, 't ' || (p_partkey % 50) || '; t' || (p_partkey % 50) || '; 中华人民共和国t' || (p_partkey % 50) AS titles FROM part GROUP BY p_partkey % 50 HAVING count(DISTINCT p_partkey % 3) = 3")
def _(spark, sf):
    n = (F.col("p_partkey") % 50).cast("string")
    forms = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("t"), n)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("t "), n)).otherwise(F.concat(F.lit("中华人民共和国t"), n))
    found = audit.title_duplicates(S.read(spark, sf, "part").select(forms.alias("title"))).filter(F.size("titles") == 3)
    return found.select("key", F.array_join("titles", "; ").alias("titles"))


@query("p13_title_matches", "WITH k AS (SELECT DISTINCT substr(p_name, 2) AS key FROM part WHERE p_partkey % 50 = 0), t AS (SELECT p_partkey, p_name AS title FROM part) SELECT p_partkey, count(*) AS n FROM t JOIN k ON length(key) > 0 AND (title = key OR ends_with(title, key)) GROUP BY p_partkey")
def _(spark, sf):
    part = S.read(spark, sf, "part")
    keys = part.filter("p_partkey % 50 = 0").select(F.substring("p_name", 2, 1000).alias("key")).distinct()
    return part.join(F.broadcast(keys), audit.title_matches(F.col("key"), F.col("p_name"))).groupBy("p_partkey").agg(F.count("*").alias("n"))  # a key in fifty parts


@query("a17_duplicate_pairs", "SELECT source AS law, lang AS num, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return audit.duplicate_pairs(S.corpus(spark, sf))


@query("a18_law_directory", "SELECT source AS law, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY source")
def _(spark, sf):
    return audit.law_directory(S.corpus(spark, sf))


@query("a15_coverage", "WITH t AS (SELECT DISTINCT 'src' || (p_partkey % 40) AS title FROM part) SELECT count(*) AS total, count(*) FILTER (title IN (SELECT source FROM documents)) AS covered, round(avg((title IN (SELECT source FROM documents))::INT), 6) AS rate FROM t")
def _(spark, sf):
    catalog = S.read(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("src"), F.col("p_partkey") % 40).alias("title"))
    return audit.coverage_rate(audit.coverage(catalog, S.corpus(spark, sf)))


_BLOCKS = [("丙法", "第一条 甲。第二条 乙。"), ("丙法", "第三条 丙。"), ("丁法", "第一条 甲。第二条 乙。"), ("丁法", "第三条"), ("丁法", "第四条"), ("戊法", "第一条，第十条之一")]


@query("p14_page_blocks", f"WITH d AS (SELECT source AS law, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _BLOCKS)})), r AS (SELECT law, round(avg(CASE WHEN len(regexp_extract_all(text, '第[一二三四五六七八九十百千零〇]+条')) > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ratio FROM d GROUP BY law) SELECT * FROM r WHERE ratio >= 0.5")
def _(spark, sf):
    rows = S.corpus(spark, sf).select("law", "text").unionByName(spark.createDataFrame(_BLOCKS, "law string, text string"))
    return audit.page_blocks(rows)


@query("m1_meta", "SELECT count(*) AS rows, count(DISTINCT source) AS laws, sum(length(text))::BIGINT AS chars FROM documents")
def _(spark, sf):
    return audit.meta(S.corpus(spark, sf))


@query("m3_articles_of_law", "SELECT doc_id AS row_idx, doc_id AS id, source AS law, lang AS num, md5(text) AS text_md5 FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 50")
def _(spark, sf):
    return audit.articles_of_law(S.corpus(spark, sf), "src3", 50).withColumn("text_md5", F.md5(F.encode("text", "utf-8"))).drop("text")


_GATED = [
    (-1, "第一条", "第一条 应当履行。"), (-2, "第二条", "第一条 应当履行。"), (-3, "第一条", "短"), (-4, "第一条", "第一条 字 字 字 字 字 字 字 字 字 字 字。"), (-5, "第一条", "第一条 应当按照 x＝y 计算"), (-6, "第一条", "第一条 没有句号"),
    (-7, "- 12 -", "- 12 - 页码在前的条文。"), (-8, "第一条", "第一条 中华人民共和国最高人民法院公报。"), (-9, "第一条", ""),
]


@query("p4_article_gate", r"""WITH s AS (SELECT doc_id, substr(coalesce(text, ''), 1, 2) AS num, coalesce(text, '') AS t FROM documents UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in _GATED) + r""")),
r AS (SELECT doc_id, t, CASE WHEN length(t) < 6 THEN 'short' WHEN NOT starts_with(t, num) THEN 'number' WHEN length(t) >= 20 AND (length(t) - length(replace(t, ' ', ''))) / length(t)::DOUBLE > 0.065 THEN 'blanks'
  WHEN instr('。；：！？”』）', right(t, 1)) = 0 THEN 'end' WHEN contains(t, '中华人民共和国最高人民法院公报') OR regexp_matches(t, '^\s*-\s*\d+\s*-') THEN 'furniture' END AS reason FROM s)
SELECT doc_id, reason, coalesce(reason = 'end' AND regexp_matches(t, '[＝=×÷%％＋+]'), false) AS soft FROM r""")
def _(spark, sf):
    d = S.read(spark, sf, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 2).alias("num"), F.coalesce("text", F.lit("")).alias("text"))
    return etl.gated(d.unionByName(spark.createDataFrame(_GATED, "doc_id long, num string, text string"))).select("doc_id", "reason", "soft")


# --- functions


@query(
    "f5_numerals",
    """WITH n AS (SELECT range AS n FROM range(10000)), d AS (SELECT n, n // 1000 AS a, n // 100 % 10 AS b, n // 10 % 10 AS c, n % 10 AS e FROM n), w AS (SELECT *, '一二三四五六七八九' AS cn FROM d)
SELECT n, n AS back, CASE WHEN n = 0 THEN '零' ELSE CASE WHEN a > 0 THEN cn[a] || '千' ELSE '' END || CASE WHEN b > 0 THEN cn[b] || '百' ELSE '' END
  || CASE WHEN c > 0 THEN CASE WHEN n >= 100 AND b = 0 THEN '零' ELSE '' END || CASE WHEN c = 1 AND n < 100 THEN '十' ELSE cn[c] || '十' END ELSE '' END
  || CASE WHEN e > 0 THEN CASE WHEN n >= 10 AND c = 0 THEN '零' ELSE '' END || cn[e] ELSE '' END END AS numeral FROM w""",
)
def _(spark, sf):
    return spark.range(10000).select(F.col("id").alias("n"), T.chinese_numeral(F.col("id")).alias("numeral"), T.cn_to_int(T.chinese_numeral(F.col("id"))).alias("back"))


@query("f1_gram_counts", f"WITH {S.SQL_CORPUS}, {S.SQL_GRAMS} SELECT row_idx, count(*) AS grams, count(DISTINCT gram) AS distinct_grams FROM dg GROUP BY row_idx")
def _(spark, sf):
    rows = S.corpus(spark, sf)
    if grams.numbered(rows):
        return grams.gram_sizes(rows)
    g = rows.select("row_idx", F.explode(T.char_ngrams(F.col("text"))).alias("gram"))
    return g.groupBy("row_idx", "gram").agg(F.count("*").alias("n")).groupBy("row_idx").agg(F.sum("n").alias("grams"), F.count("*").alias("distinct_grams"))


@query("f7_expand_query", f"WITH {S.SQL_QUERIES}, {S.SQL_EXPANDED} SELECT qid, len(string_split(xq.query, ' ')) - len(string_split(q.query, ' ')) AS added, xq.query IS NOT NULL AS expanded FROM q LEFT JOIN xq USING (qid)")
def _(spark, sf):
    e = S.questions(spark, sf).withColumn("e", expand_query(F.col("query"), S.SYNONYMS))
    grown = F.col("e") != F.col("query")
    return e.select("qid", F.when(grown, F.size(F.split("e", " ")) - F.size(F.split("query", " "))).alias("added"), grown.alias("expanded"))


_TITLES = [(-1, "2020-01-01_中华人民共和国民法典（2020修正）.docx"), (-2, "《中华人民共和国 刑法》"), (-3, " 关于、某法的解释（一）.md"), (-4, "某中华人民共和国法"), (-5, "")]


@query("f12_normalize_title", f"WITH t AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(f"({a}, '{b}')" for a, b in _TITLES)})), k AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '^{S.WS}|{S.WS}$', '', 'g'), '^\\d{{4}}-\\d{{2}}-\\d{{2}}[_ ]?', ''), '(?s)\\.[^.]*$', '') AS stem FROM t) SELECT page_id, regexp_replace(regexp_replace(coalesce(url, ''), '{S.WS}', '', 'g'), '^中华人民共和国', '') AS title, translate(replace(regexp_replace(stem, '[{S.WS[1:-2]}《》\"''“”、]', '', 'g'), '中华人民共和国', ''), '（）', '()') AS mirror, regexp_replace(regexp_replace(regexp_replace(stem, '[（(][^（()）]*[)）]', '', 'g'), '[{S.WS[1:-2]}《》\"''“”]', '', 'g'), '^中华人民共和国', '') AS norm FROM k")
def _(spark, sf):
    t = S.read(spark, sf, "pages").select("page_id", "url").unionByName(spark.createDataFrame(_TITLES, "page_id long, url string"))
    return t.select("page_id", T.normalize_title(F.col("url")).alias("title"), T.mirror_key(F.col("url")).alias("mirror"), T.norm_title(F.col("url")).alias("norm"))


@query("a24_token_idf", "WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[a-z0-9]+')) AS token FROM documents) SELECT token, round(ln((SELECT count(*) FROM documents)::DOUBLE / count(*)), 6) AS idf FROM t GROUP BY token")
def _(spark, sf):
    lists = S.read(spark, sf, "documents").select(T.char_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return variants.token_idf(lists).select("token", F.round("idf", 6).alias("idf"))


# --- semantic ranks and reranking


@query("r3_semantic_ranks", f"WITH {S.SQL_VECTORS} SELECT * FROM sr WHERE sem <= 50")
def _(spark, sf):
    return semantic.semantic_ranks(S.vectors(spark, sf), S.query_vectors(spark, sf), 50)


_POOL = f"{S.SQL_VECTORS}, sp AS (SELECT * FROM (SELECT qid, row_idx, sem, round(1.0::DOUBLE / (60 + sem), 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY sem, row_idx) AS rank FROM sr) WHERE rank <= 50)"


@query("r4_semantic_pool", f"WITH {_POOL} SELECT qid, rank, row_idx, score FROM sp")
def _(spark, sf):
    return semantic.semantic_pool(S.vectors(spark, sf), S.query_vectors(spark, sf))


def _base(spark, sf):
    """A ranking to rerank: for each query the rows of the next 30 numbers."""
    q = S.query_vectors(spark, sf).select("qid").distinct()
    d = q.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("row_idx", F.col("qid") + F.col("rank") * 7)
    return d.join(S.vectors(spark, sf).select("row_idx"), "row_idx", "left_semi")


_BASE = "ba AS (SELECT qid, r AS rank, qid + r * 7 AS row_idx FROM (SELECT DISTINCT qid FROM qv) CROSS JOIN range(1, 31) t(r) WHERE qid + r * 7 IN (SELECT row_idx FROM v))"


@query(
    "r5_semantic_rerank",
    f"""WITH {S.SQL_VECTORS}, {_BASE}, w AS (SELECT qid, max(sem) + 1 AS worst FROM sr GROUP BY qid),
x AS (SELECT qid, ba.rank AS r0, row_idx, coalesce(sem, worst) AS semantic_rank, round(1.0::DOUBLE / (60 + ba.rank) + 2.0::DOUBLE / (60 + coalesce(sem, worst)), 9) AS rerank_score FROM ba LEFT JOIN sr USING (qid, row_idx) JOIN w USING (qid)),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, r0) AS fused FROM x),
z AS (SELECT *, CASE WHEN fused <= 10 THEN row_number() OVER (PARTITION BY qid, fused <= 10 ORDER BY (row_idx * 37) % 101 DESC, fused) END AS cr FROM y),
b AS (SELECT *, round(1.0::DOUBLE / (60 + fused) + 3.0::DOUBLE / (60 + cr), 9) AS blend FROM z)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY blend DESC NULLS LAST, fused) AS rank, row_idx, rerank_score, semantic_rank FROM b""",
)
def _(spark, sf):
    base = _base(spark, sf)
    cross = base.select("qid", "row_idx", ((F.col("row_idx") * 37) % 101).cast("double").alias("cross"))
    return semantic.semantic_rerank(base, semantic.ranks_among(S.vectors(spark, sf), S.query_vectors(spark, sf), base), cross)


@query(
    "r14_cosine_fusion",
    f"""WITH {S.SQL_VECTORS}, {_BASE}, x AS (SELECT qid, ba.rank AS r0, row_idx, max(sim) AS cos FROM ba JOIN si USING (qid, row_idx) GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, row_idx) AS s FROM x), z AS (SELECT *, round(1.0::DOUBLE / (60 + r0) + 0.05::DOUBLE * cos + 1.0::DOUBLE / (60 + s), 9) AS score FROM y)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r0) AS rank, row_idx, score FROM z""",
)
def _(spark, sf):
    base = _base(spark, sf)
    return semantic.cosine_fusion(base, semantic.pair_similarities(S.vectors(spark, sf), S.query_vectors(spark, sf), base), 0.05, 1.0)


@query(
    "r7_promote",
    f"""WITH {S.SQL_VECTORS}, {_BASE}, n AS (SELECT qid, count(*) AS n FROM ba GROUP BY qid), a AS (SELECT qid, unnest([3, 1, 99, 3, 0, 7]) AS k, generate_subscripts([3, 1, 99, 3, 0, 7], 1) AS o FROM n WHERE qid % 60 = 0),
p AS (SELECT qid, k, row_number() OVER (PARTITION BY qid ORDER BY min(o)) AS pick FROM a JOIN n USING (qid) WHERE k BETWEEN 1 AND n GROUP BY qid, k),
d AS (SELECT qid, row_idx, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r0 FROM ba)
SELECT d.qid, row_number() OVER (PARTITION BY d.qid ORDER BY pick NULLS LAST, r0) AS rank, row_idx FROM d LEFT JOIN p ON p.qid = d.qid AND p.k = d.r0""",
)
def _(spark, sf):
    base = retrieval.ranked(_base(spark, sf).withColumnRenamed("rank", "_r"), [F.col("_r")], None)
    # a sound answer, one that a place without a comma voids, and one without a list
    said = F.when(F.col("qid") % 60 == 0, "I choose [3, 1, 99, 3, , 0, 7] here").when(F.col("qid") % 60 == 20, "[2 3, 5]").otherwise("none of these")
    answers = base.select("qid").distinct().withColumn("answer", said)
    return semantic.promote(base, semantic.pick_numbers(answers))


_JUDGE = f"""{S.SQL_VECTORS}, {_BASE}, s AS (SELECT qid, row_idx, round((row_idx * 13 % 17) / 17.0::DOUBLE, 6) AS p FROM ba WHERE row_idx % 3 <> 0 AND qid % 60 <> 0),
j AS (SELECT ba.*, coalesce(p, 0)::DOUBLE AS p, ba.qid IN (SELECT qid FROM s) AS judged FROM ba LEFT JOIN s USING (qid, row_idx)),
k AS (SELECT *, CASE WHEN judged THEN row_number() OVER (PARTITION BY qid ORDER BY p DESC, rank) END AS jr FROM j)"""


def _judged(spark, sf):
    base = _base(spark, sf)
    return base, base.filter("row_idx % 3 <> 0 and qid % 60 <> 0").select("qid", "row_idx", F.round((F.col("row_idx") * 13 % 17) / 17.0, 6).alias("judge_score"))


@query("r8_judge_rerank", f"WITH {_JUDGE} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY jr NULLS LAST, rank) AS rank, row_idx, p AS judge_score, coalesce(jr, 0) AS judge_rank, (jr IS NOT NULL)::BIGINT AS judge_pick FROM k")
def _(spark, sf):
    return semantic.judge_rerank(*_judged(spark, sf)).fillna(0, ["judge_rank"])


@query("r8_judge_pick", f"WITH {_JUDGE} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN jr <= 5 THEN jr END NULLS LAST, rank) AS rank, row_idx, p AS judge_score, coalesce(jr, 0) AS judge_rank, coalesce(jr <= 5, false)::BIGINT AS judge_pick FROM k")
def _(spark, sf):
    return semantic.judge_rerank(*_judged(spark, sf), pick=5).fillna(0, ["judge_rank"])


@query(
    "r8_judge_modes",
    """WITH h AS (SELECT doc_id // 10 AS qid, doc_id % 10 + 1 AS rank, doc_id AS row_idx FROM documents),
p AS (SELECT *, CASE WHEN (row_idx * 7) % 5 < 4 THEN ((row_idx * 7) % 5) / 4.0::DOUBLE ELSE 0 END AS v FROM h)
SELECT 'choice' AS mode, qid, row_idx, v AS judge_score FROM p WHERE qid % 3 <> 0 UNION ALL SELECT 'score', qid, row_idx, v FROM p WHERE qid % 3 <> 0""",
)
def _(spark, sf):
    hits = S.corpus(spark, sf).select(F.floor(F.col("row_idx") / 10).alias("qid"), (F.col("row_idx") % 10 + 1).alias("rank"), "row_idx")
    value = (F.col("row_idx") * 7) % 5
    told = hits.filter(value < 4)  # the others get no value; every third answer is void
    number = (value / 4.0).cast("string")
    choice = F.concat(F.lit('"'), F.col("rank").cast("string"), F.lit('": '), number)
    score = F.concat(F.lit('"c'), F.col("rank").cast("string"), F.lit('": {"score": '), number, F.lit("}"))
    out = None
    for mode, part, begin, end in (("choice", choice, '{"answers": {"rank": {"probabilities": {', "}}}}"), ("score", score, '{"answers": {', "}}")):
        said = told.groupBy("qid").agg(F.concat(F.lit(begin), F.array_join(F.array_sort(F.collect_list(part)), ", "), F.lit(end)).alias("a"))
        answers = said.select("qid", F.when(F.col("qid") % 3 == 0, '{"answers": null}').otherwise(F.col("a")).alias("answer"))
        one = semantic.judge_scores(answers, hits, mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


_SEM = f"{S.SQL_VECTORS}, {_BASE}"


@query("r13_gated_fusion", f"""WITH {_SEM}, x AS (SELECT ba.qid, ba.rank AS r0, row_idx, round(1.0::DOUBLE / (60 + ba.rank) + CASE WHEN qid % 40 = 0 THEN 2.0::DOUBLE / (60 + sem) ELSE 0 END, 9) AS score FROM ba JOIN sr USING (qid, row_idx))
SELECT qid, rank, row_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r0) AS rank FROM x) WHERE rank <= 5""")
def _(spark, sf):
    base = _base(spark, sf)
    gate = base.select("qid").distinct().withColumn("open", F.col("qid") % 40 == 0)
    return variants.gated_fusion(base, semantic.ranks_among(S.vectors(spark, sf), S.query_vectors(spark, sf), base), gate)


@query("r15_pool_union", f"""WITH {_SEM}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sem, row_idx) AS place FROM sr),
u AS (SELECT v.pool, o.qid, o.row_idx, ba.rank AS r0, o.place, round(coalesce(1.0::DOUBLE / (60 + ba.rank), 0) + 2.0::DOUBLE / (60 + o.sem), 9) AS score
  FROM o LEFT JOIN ba USING (qid, row_idx) CROSS JOIN (VALUES (0::BIGINT), (20), (50), (100)) v(pool) WHERE ba.rank IS NOT NULL OR o.place <= v.pool)
SELECT pool, qid, row_number() OVER (PARTITION BY pool, qid ORDER BY score DESC, r0 NULLS LAST, place) AS rank, row_idx, score FROM u""")
def _(spark, sf):
    base = _base(spark, sf)
    ranks = semantic.ranks_and_pool(S.vectors(spark, sf), S.query_vectors(spark, sf), base, max(variants.POOL_SIZES))
    return variants.pool_unions(base, ranks)


@query("r16_combine_rules", f"""WITH {_SEM}, x AS (SELECT qid, ba.rank AS r0, row_idx, round(1.0::DOUBLE / (60 + ba.rank) + 2.0::DOUBLE / (60 + sem), 9) AS s FROM ba JOIN sr USING (qid, row_idx)),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, r0) AS fused FROM x),
z AS (SELECT *, CASE WHEN fused <= 10 THEN row_number() OVER (PARTITION BY qid, fused <= 10 ORDER BY (row_idx * 37) % 101 DESC, fused) END AS cr FROM y)
SELECT 'fusion' AS rule, qid, fused AS rank, row_idx FROM y
UNION ALL SELECT 'cross', qid, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN fused <= 10 THEN (row_idx * 37) % 101 END DESC NULLS LAST, fused), row_idx FROM y
UNION ALL SELECT 'blend ' || w, qid, row_number() OVER (PARTITION BY w, qid ORDER BY CASE WHEN cr IS NOT NULL THEN round(1.0::DOUBLE / (60 + fused) + w::DOUBLE / (60 + cr), 9) END DESC NULLS LAST, fused), row_idx FROM z CROSS JOIN (VALUES (1), (2), (3)) v(w)""")
def _(spark, sf):
    base = _base(spark, sf)
    cross = base.select("qid", "row_idx", ((F.col("row_idx") * 37) % 101).cast("double").alias("cross"))
    return variants.combined(base, semantic.ranks_among(S.vectors(spark, sf), S.query_vectors(spark, sf), base), cross)


# --- gold sets


@query("g1_candidate_phrases", None)
def _(spark, sf):
    rows = S.corpus(spark, sf)
    return gold.candidate_phrases(rows, gold.gram_frequencies(rows), rows.count(), 3)


@query("g4_make_gold", None)
def _(spark, sf):
    return gold.make_gold(S.corpus(spark, sf), 50)


@query("g5_anchored_gold", """WITH s AS (SELECT item_id AS qid, [substr(text, 1, 60), substr(text, 1, 25)] AS anchors, CASE WHEN item_id % 2 = 0 THEN 'en' END AS prefer FROM benchmark),
t AS (SELECT qid, prefer, unnest(anchors) AS anchor, generate_subscripts(anchors, 1) AS pos FROM s),
h AS (SELECT qid, doc_id, anchor, pos, min(pos) OVER (PARTITION BY qid) AS first, coalesce(lang = prefer, false) AS pref, (instr(text, anchor) - 1) / length(text)::DOUBLE AS ratio FROM documents JOIN t ON instr(text, anchor) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pref DESC, ratio, doc_id) AS r FROM h WHERE pos = first)
SELECT qid, array_to_string(list(doc_id ORDER BY r), ',') AS gold_ids, min(anchor) AS evidence FROM r WHERE r <= 3 GROUP BY qid""")
def _(spark, sf):
    b = S.read(spark, sf, "benchmark")
    specs = b.select(F.col("item_id").alias("qid"), F.array(F.substring("text", 1, 60), F.substring("text", 1, 25)).alias("anchors"), F.when(F.col("item_id") % 2 == 0, "en").alias("prefer_num"))
    return gold.anchored_gold(S.corpus(spark, sf), specs).select("qid", F.array_join(F.transform("gold_ids", lambda x: x.cast("string")), ",").alias("gold_ids"), "evidence")


@query("g6_check_gold", """WITH g AS (SELECT item_id AS qid, item_id * 40 AS id, 'src' || (item_id % 25) AS law, CASE WHEN item_id % 3 = 0 THEN 'xx' ELSE 'en' END AS num, substr(text, 1, 30) AS ev FROM benchmark),
d AS (SELECT doc_id AS id, source AS law, lang AS num, text FROM documents),
o AS (SELECT DISTINCT qid, d.law || ' ' || d.num AS pair FROM g JOIN d USING (id))
SELECT qid, 'missing-id' AS kind, id::VARCHAR AS detail FROM g WHERE id NOT IN (SELECT id FROM d)
UNION ALL SELECT qid, 'missing-law', law FROM g WHERE law NOT IN (SELECT law FROM d)
UNION ALL SELECT qid, 'missing-num', law || ' ' || num FROM g WHERE law IN (SELECT law FROM d) AND (law, num) NOT IN (SELECT (law, num) FROM d)
UNION ALL SELECT qid, 'pair-mismatch', pair FROM o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.qid = o.qid AND g.law || ' ' || g.num = o.pair)
UNION ALL SELECT g.qid, 'warn-evidence', '' FROM g JOIN d USING (id) WHERE NOT contains(regexp_replace(d.text, '""" + S.WS + "', '', 'g'), regexp_replace(g.ev, '" + S.WS + "', '', 'g'))")
def _(spark, sf):
    b = S.read(spark, sf, "benchmark")
    law, num = F.concat(F.lit("src"), F.col("item_id") % 25), F.when(F.col("item_id") % 3 == 0, "xx").otherwise("en")
    g = b.select(F.col("item_id").alias("qid"), F.array(F.col("item_id") * 40).alias("gold_ids"), F.array(F.concat_ws(" ", law, num)).alias("gold_laws"), F.substring("text", 1, 30).alias("evidence"))
    return gold.check_gold(g, S.corpus(spark, sf))


@query("c8_migrate_gold", """WITH f AS (SELECT source AS law, lang AS num, min(doc_id) AS id FROM documents GROUP BY ALL)
SELECT item_id AS qid, id, coalesce(contains(regexp_replace(d.text, '""" + S.WS + "', '', 'g'), regexp_replace(substr(benchmark.text, 1, 30), '" + S.WS + """', '', 'g')), false) AS verified
FROM benchmark LEFT JOIN f ON f.law = 'src' || (item_id % 25) AND f.num = 'en' LEFT JOIN documents d ON d.doc_id = f.id""")
def _(spark, sf):
    b = S.read(spark, sf, "benchmark")
    g = b.select(F.col("item_id").alias("qid"), F.array(F.concat(F.lit("src"), F.col("item_id") % 25, F.lit(" en"))).alias("gold_laws"), F.substring("text", 1, 30).alias("evidence"))
    return gold.migrate(g, S.corpus(spark, sf)).select("qid", F.get("gold_ids", F.lit(0)).alias("id"), "verified")


@query("j10_map_external", """WITH a AS (SELECT item_id AS qid, 'src' || (item_id % 25) AS law, CASE WHEN item_id % 5 = 0 THEN 'xx' ELSE 'en' END AS num, 'src' || (item_id % 30) || ' fr' AS alt FROM benchmark),
m AS (SELECT qid, list(doc_id ORDER BY doc_id) AS ids FROM a JOIN documents d ON d.source = a.law AND d.lang = a.num GROUP BY qid),
x AS (SELECT qid, list(doc_id ORDER BY doc_id) AS ids FROM a JOIN documents d ON d.source || ' ' || d.lang = a.alt GROUP BY qid)
SELECT a.qid, m.ids IS NOT NULL AS matched, CASE WHEN m.ids IS NOT NULL THEN array_to_string(m.ids || coalesce(x.ids, []), ',') END AS gold_ids, CASE WHEN m.ids IS NOT NULL AND x.ids IS NULL THEN alt ELSE '' END AS unmapped
FROM a LEFT JOIN m USING (qid) LEFT JOIN x USING (qid)""")
def _(spark, sf):
    b = S.read(spark, sf, "benchmark")
    items = b.select(F.col("item_id").alias("qid"), F.concat(F.lit("《src"), F.col("item_id") % 25, F.lit("》")).alias("expect_law"), F.when(F.col("item_id") % 5 == 0, "xx").otherwise("en").alias("expect_num"),
                     F.array(F.concat(F.lit("src"), F.col("item_id") % 30, F.lit(" fr"))).alias("expect_alts"))
    out = gold.map_external(items, S.corpus(spark, sf))
    return out.select("qid", "matched", F.array_join(F.transform("gold_ids", lambda x: x.cast("string")), ",").alias("gold_ids"), F.array_join("unmapped_alts", ",").alias("unmapped"))


# --- corpus building

_LINES = "p AS (SELECT doc_id AS doc, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL))"
#: In Spark and SQL: every third line of a document opens an article; numbers fall back at times.
_LABELS = ["第一条", "第三条", "第二条", "第四条之一", "第一章", "一、"]


def _labelled(spark, sf):
    """Whole lines of the documents, every second one marked as an article, heading or section."""
    d = S.read(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    mark = F.get(F.array(*map(F.lit, _LABELS)), ((F.col("doc") + F.col("pos")) / 2).cast("int") % 6)
    return d.select("doc", "pos", F.when((F.col("doc") + F.col("pos")) % 2 == 0, F.concat(mark, F.lit(" "), F.col("line"))).otherwise(F.col("line")).alias("line"))


_LABELLED = f"""{_LINES}, m AS (SELECT doc, pos - 1 AS pos, CASE WHEN (doc + pos - 1) % 2 = 0 THEN ({_LABELS})[((doc + pos - 1) // 2) % 6 + 1] || ' ' || line ELSE line END AS line FROM p),
lb AS (SELECT *, CASE WHEN starts_with(line, '第一条') THEN 1 WHEN starts_with(line, '第三条') THEN 3 WHEN starts_with(line, '第二条') THEN 2 WHEN starts_with(line, '第四条') THEN 4 END AS n, contains(line, '条之') AS suffix FROM m),
op AS (SELECT *, coalesce(CASE WHEN suffix THEN n >= before ELSE n > before END, false) AS opens FROM (SELECT *, coalesce(max(n) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lb)),
sp AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ord FROM op WHERE opens OR n IS NOT NULL OR NOT (starts_with(line, '第一章') OR starts_with(line, '一、'))),
ar AS (SELECT doc, ord::BIGINT AS ord, max(CASE WHEN opens THEN CASE WHEN suffix THEN '第四条之一' ELSE substr(line, 1, 3) END END) AS num, string_agg(line, '' ORDER BY pos) AS text FROM sp WHERE ord > 0 GROUP BY doc, ord)"""


@query("c1_split_articles", f"WITH {_LABELLED} SELECT doc, ord, num, md5(text) AS text_md5 FROM ar")
def _(spark, sf):
    return etl.split_articles(_labelled(spark, sf)).select("doc", "ord", "num", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


@query("a19_quality", f"""WITH {_LABELLED}, ga AS (SELECT *, length(text) - length(replace(text, ' ', '')) AS blanks FROM ar),
k AS (SELECT *, CASE WHEN length(text) < 6 THEN 'short' WHEN length(text) >= 20 AND blanks / length(text)::DOUBLE > 0.065 THEN 'blanks' WHEN instr('。；：！？”』）', right(text, 1)) = 0 THEN 'end' WHEN contains(text, '中华人民共和国最高人民法院公报') THEN 'furniture' END AS reason FROM ga),
y AS (SELECT *, reason IS NULL OR (reason = 'end' AND regexp_matches(text, '[＝=×÷%％＋+]')) AS keep FROM k)
SELECT t.doc, count(y.ord) AS arts, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped, count(*) FILTER (keep AND reason = 'end') AS soft,
  round(coalesce(sum(length(y.text)) FILTER (keep), 0) / greatest(max(t.chars), 1)::DOUBLE, 6) AS cov, count(*) FILTER (keep AND contains(y.text, '(cid:')) AS cid
FROM (SELECT doc, sum(length(line)) AS chars FROM m GROUP BY doc) t LEFT JOIN y ON y.doc = t.doc GROUP BY t.doc""")
def _(spark, sf):
    lines = _labelled(spark, sf)
    found = etl.quality(etl.split_articles(lines), lines.groupBy("doc").agg(F.sum(F.length("line")).alias("chars")))
    return found.select("doc", "arts", "kept", "dropped", "soft", "cov", "cid")


@query("c2_best_effort", f"""WITH {_LABELLED}, mn AS (SELECT doc, pos, suffix, mode, CASE WHEN n IS NOT NULL THEN n WHEN mode = 'list' AND starts_with(line, '一、') THEN 1 WHEN mode = 'item' THEN try_cast(regexp_extract(line, '^([0-9]+)\\s*[\\.．]', 1) AS INT) END AS n, n IS NOT NULL AS article FROM lb CROSS JOIN (VALUES ('list'), ('item')) v(mode)),
mo AS (SELECT *, coalesce(CASE WHEN article AND suffix THEN n >= before ELSE n > before END, false) AS opens FROM (SELECT *, coalesce(max(n) OVER (PARTITION BY mode, doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM mn)),
mu AS (SELECT doc, mode, count(*) FILTER (opens) AS units FROM mo GROUP BY doc, mode), be AS (SELECT doc, mode, units FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY units DESC, mode DESC) AS r FROM mu WHERE units >= 2) WHERE r = 1)
SELECT mode, sum(units)::BIGINT AS units, count(*) AS docs FROM be GROUP BY mode UNION ALL SELECT 'whole', count(*), count(*) FROM (SELECT DISTINCT doc FROM m WHERE doc NOT IN (SELECT doc FROM be)) HAVING count(*) > 0""")
def _(spark, sf):
    return etl.best_effort_articles(_labelled(spark, sf)).groupBy("mode").agg(F.count("*").alias("units"), F.countDistinct("doc").alias("docs"))


def _sql_garbage(line):
    """The furniture rules in SQL."""
    ws = S.WS[1:-2]
    known = " OR ".join(f"regexp_matches({line}, '{pattern}')" for pattern in etl.FURNITURE)
    return (
        f"(regexp_matches({line}, '{etl.CODES_ONLY}') OR (NOT contains({line}, '(cid:') AND "
        f"(regexp_matches({line}, '^[\\x{{e000}}-\\x{{f8ff}}\\x{{ff10}}-\\x{{ff19}}{ws}\\-—–·.]+$') OR (length({line}) <= {etl.FURNITURE_MAX} AND ({known})))))"
    )


@query("c4_deinterleave", f"""WITH {_LABELLED}, gl AS (SELECT *, {_sql_garbage("line")} AS garbage FROM lb),
gc AS (SELECT *, (garbage AND coalesce(lag(garbage) OVER (PARTITION BY doc ORDER BY pos), false))::INT AS cut FROM gl),
gb AS (SELECT * FROM (SELECT *, sum(cut) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM gc) WHERE NOT garbage),
pl AS (SELECT *, row_number() OVER (PARTITION BY doc, block ORDER BY pos) - 1 AS place FROM gb), si AS (SELECT *, place % 2 AS side FROM pl),
ea AS (SELECT *, max(n) OVER (PARTITION BY doc ORDER BY block RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM si),
bo AS (SELECT *, coalesce((n < greatest(earlier, max(n) OVER (PARTITION BY doc, block ORDER BY side, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))::INT, 0) AS lf,
  coalesce((n < greatest(earlier, max(n) OVER (PARTITION BY doc, block ORDER BY -side, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))::INT, 0) AS rf FROM ea),
od AS (SELECT *, CASE WHEN sum(rf) OVER (PARTITION BY doc, block) < sum(lf) OVER (PARTITION BY doc, block) THEN -side ELSE side END AS o FROM bo)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY block, o, place) - 1 AS pos, md5(line) AS line_md5 FROM od""")
def _(spark, sf):
    return etl.deinterleave(_labelled(spark, sf)).select("doc", "pos", F.md5(F.encode("line", "utf-8")).alias("line_md5"))


@query("s14_html_paragraphs", r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', chr(10), 'g') AS t FROM pages),
u AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&amp;', '&'), '&ldquo;', '“'), '&rdquo;', '”'), '&mdash;', '—') AS t FROM t),
l AS (SELECT page_id, i, line FROM (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^""" + S.WS + "|" + S.WS + r"""$', '', 'g')), lambda x: x <> '') AS ls FROM u))),
g AS (SELECT *, CASE WHEN length(line) <= 2 THEN coalesce(max(CASE WHEN length(line) > 2 THEN i END) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 + 1 ELSE i * 2 END AS k FROM l),
m AS (SELECT page_id, k, string_agg(line, '' ORDER BY i) AS line FROM g GROUP BY page_id, k)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, regexp_replace(replace(regexp_replace(line, '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), chr(160), ' '), '^""" + S.WS + "|" + S.WS + "$', '', 'g') AS line FROM m")
def _(spark, sf):
    return etl.html_paragraphs(S.read(spark, sf, "pages"))


_FURNITURE_LINES = ["(cid:12)(cid:3) (cid:4)", "(cid:12) 条文", "１２　３", "最高人民法院公报", "在公报上刊登的，应当注明。", "年第 3 期", "２０２５·６", "2025", "- 12 -", "-", "第 7 期", "第七条 正文", "\ue001\ue002 —"]


@query("p8_garbage_lines", ORACLE_SQL["s14_html_paragraphs"].replace("SELECT page_id, row_number() OVER", ", li AS (SELECT page_id, row_number() OVER") + f") SELECT line, {_sql_garbage('line')} AS garbage, count(*) AS n FROM (SELECT line FROM li UNION ALL SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in _FURNITURE_LINES)})) GROUP BY ALL")
def _(spark, sf):
    lines = etl.html_paragraphs(S.read(spark, sf, "pages")).select("line").union(spark.createDataFrame([(x,) for x in _FURNITURE_LINES], "line string"))
    return lines.groupBy("line", etl.is_garbage(F.col("line")).alias("garbage")).agg(F.count("*").alias("n"))


@query("u1_merge_violations", """WITH b AS (SELECT doc_id AS id, source AS law, lang AS num, text FROM documents WHERE doc_id % 3 <> 0), f AS (SELECT doc_id - doc_id % 2 AS id, source AS law, lang AS num, text FROM documents WHERE doc_id % 3 = 0)
SELECT * FROM (SELECT 'id-exists' AS kind, count(*) AS n FROM f WHERE id IN (SELECT id FROM b) UNION ALL SELECT 'id-repeated', count(*) FROM (SELECT id FROM f GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'pair-repeated', count(*) FROM (SELECT law, num FROM f GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'empty-text', count(*) FROM f WHERE regexp_replace(coalesce(text, ''), '""" + S.WS + """', '', 'g') = ''
UNION ALL SELECT 'damaged-text', count(*) FROM f WHERE contains(text, '(cid:')) WHERE n > 0""")
def _(spark, sf):
    rows = S.corpus(spark, sf)
    return etl.merge_violations(rows.filter("id % 3 <> 0"), rows.filter("id % 3 = 0").withColumn("id", F.col("id") - F.col("id") % 2))


@query("u5_rebuild", """WITH r AS (SELECT source AS law, doc_id AS ord, lang AS num, text, doc_id % 2 AS priority FROM documents WHERE source IN ('src1', 'src2')),
k AS (SELECT r.* FROM r JOIN (SELECT law, min(priority) AS priority FROM r GROUP BY law) USING (law, priority)), n AS (SELECT *, row_number() OVER (ORDER BY law, ord) AS n FROM k)
SELECT doc_id AS row_idx, doc_id AS id, source AS law, lang AS num FROM documents WHERE source NOT IN ('src1', 'src2', 'src9')
UNION ALL SELECT (SELECT max(doc_id) FROM documents) + n, 995000 + n, law, num FROM n""")
def _(spark, sf):
    rows = S.corpus(spark, sf)
    new = rows.filter("law in ('src1', 'src2')").select("law", F.col("row_idx").alias("ord"), "num", "text", (F.col("row_idx") % 2).alias("priority"))
    return etl.rebuild(rows, new, drop_laws=["src9"]).drop("text")


@query("j1_raw_articles", "SELECT o_orderkey AS row_idx, o_orderkey AS id, c_name AS law, o_orderstatus AS num, coalesce(o_orderpriority, '') AS text FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    a = S.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("article_num"), F.col("o_orderpriority").alias("content"))
    d = S.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return etl.raw_articles(a, d)
