"""Set-at-a-time retrieval: BM25 over character bigrams, substring ranking, fusion, recall with trace.

Corpora have columns row_idx (order of rows, ties), id, law, num, text; queries
qid and query. Results are ranked by rounded score so that the order of float
additions never decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.expansion import Synonyms, expand_query
from .grams import bm25_matrix, containing, few, named

# BM25 saturation and length weight, fusion constant, ranking depth, depth under a reranker, weight of the expanded query.
K1, B, RRF_K, DEPTH, RERANK_DEPTH, EXPAND_WEIGHT = 1.5, 0.6, 60, 30, 100, 1.5


def ranked(hits: DataFrame, order: list[Column], k: int | None, by: str = "qid") -> DataFrame:
    """``hits`` with 1-based ``rank`` by query, the first ``k`` or all."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if k is None else out.filter(F.col("rank") <= k)


@dataclass(frozen=True)
class Index:
    """postings (gram, row_idx, tf), lengths (row_idx, dl), corpus rows; n and the mean length are one row."""

    corpus: DataFrame

    @property
    def lengths(self) -> DataFrame:
        return self.corpus.select("row_idx", T.gram_count(F.col("text")).alias("dl"))

    @property
    def totals(self) -> DataFrame:
        return self.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))

    def postings(self, grams: DataFrame | None = None) -> DataFrame:
        """Term frequencies; of ``grams`` only if given, which are filtered before they are counted."""
        rows = self.corpus.select("row_idx", F.explode(T.char_ngrams(F.col("text"))).alias("gram"))
        rows = rows if grams is None else rows.join(grams.select("gram").distinct(), "gram", "left_semi")
        return rows.groupBy("gram", "row_idx").agg(F.count("*").alias("tf"))


def bm25_terms(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, row_idx, gram, times (in the query), tf, df, dl, n, avg_dl: all that any BM25 parameters need."""
    index = Index(corpus)
    wanted = queries.select("qid", F.explode(T.query_grams(F.col("query"))).alias("gram")).groupBy("qid", "gram").agg(F.count("*").alias("times"))
    postings = index.postings(wanted)
    df = postings.groupBy("gram").agg(F.count("*").alias("df"))
    hits = postings.join(wanted, "gram").join(df, "gram").join(index.lengths, "row_idx")
    return hits.crossJoin(F.broadcast(index.totals))  # one row


def bm25_weight(k1: float | Column = K1, b: float | Column = B) -> Column:
    """Contribution of a term row; the denominator of the idf is df itself."""
    k1, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (k1, b))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / F.col("df") + 1.0)
    tf = F.col("tf").cast("double")
    norm = tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl"))
    return F.col("times") * idf * tf * (k1 + 1) / norm


def _scored(corpus: DataFrame, queries: DataFrame, k: int | None, settings: list[tuple[float, float]]) -> DataFrame:
    """qid, setting, row_idx, score under each (k1, b); with ``k`` only rows that can be among a ranking's first k."""
    grams = queries.select("qid", F.explode(T.query_grams(F.col("query"))).alias("gram")).groupBy("qid", "gram").agg(F.count("*").alias("times"))
    pairs = few(grams)
    if pairs is not None:
        asked = [Row(qid=x) for x in dict.fromkeys(r.qid for r in pairs)]
        return named(bm25_matrix(corpus, asked, pairs, k, settings), asked, queries)
    grid = F.posexplode(F.array(*(F.struct(F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")) for k1, b in settings))).alias("setting", "_s")
    weighed = bm25_terms(corpus, queries).select("*", grid).withColumn("_w", bm25_weight(F.col("_s.k1"), F.col("_s.b")))
    return weighed.groupBy("qid", "setting", "row_idx").agg(F.round(F.sum("_w"), 6).alias("score"))


def bm25(corpus: DataFrame, queries: DataFrame, k: int | None = 10, *, k1: float = K1, b: float = B) -> DataFrame:
    """qid, rank, row_idx, score: the k best rows of each query."""
    scored = _scored(corpus, queries, k, [(k1, b)]).select("qid", "row_idx", "score")
    return ranked(scored, [F.desc("score"), F.col("row_idx")], k)


def like(corpus: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """qid, rank, row_idx, score, position: rows whose raw text holds the collapsed query, the earliest first; an empty query hits every row."""
    own = queries.select("qid", T.collapse(F.col("query")).alias("needle"))
    hits = containing(corpus, own, k).select("qid", "row_idx", F.lit(1.0).alias("score"), "position")
    return ranked(hits, [F.col("position"), F.col("row_idx")], k)


def channels(corpus: DataFrame, queries: DataFrame, synonyms: Synonyms, depth: int = DEPTH, expand_weight: float = EXPAND_WEIGHT, b: float = B) -> DataFrame:
    """qid, channel, weight, rank, row_idx of the bm25, expand and like rankings; expand only where expansion adds something."""
    grown = queries.select("qid", expand_query(F.col("query"), synonyms).alias("_e"), "query").filter(F.col("_e") != F.col("query"))
    named = lambda d, name, text: d.select(F.struct("qid", F.lit(name).alias("channel")).alias("qid"), F.col(text).alias("query"))
    # both sets of queries in one pass over the corpus
    lexical = bm25(corpus, named(queries, "bm25", "query").unionByName(named(grown, "expand", "_e")), depth, b=b)
    weight = F.when(F.col("qid.channel") == "expand", F.lit(float(expand_weight))).otherwise(1.0)
    lexical = lexical.select("qid.qid", "qid.channel", weight.alias("weight"), "rank", "row_idx")
    exact = like(corpus, queries, depth)
    return lexical.unionByName(exact.select("qid", F.lit("like").alias("channel"), F.lit(1.0).alias("weight"), "rank", "row_idx"))


def rrf(lists: DataFrame, k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of (qid, channel, weight, rank, row_idx): qid, rank, row_idx, score, channels."""
    fused = lists.groupBy("qid", "row_idx").agg(
        F.round(F.sum(F.col("weight") / (constant + F.col("rank"))), 9).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels")
    )
    return ranked(fused, [F.desc("score"), F.col("row_idx")], k)


def told_apart(lists: DataFrame) -> DataFrame:
    """qid, row_idx, _name, rank: the bm25 and like rankings among the channels ``lists``, and hybrid, their fusion, all from one pass over them."""
    score = F.round(F.sum(F.col("weight") / (RRF_K + F.col("rank"))), 9).alias("score")
    of = lambda name: F.min(F.when(F.col("channel") == name, F.col("rank"))).alias(name)
    fused = ranked(lists.groupBy("qid", "row_idx").agg(score, of("bm25"), of("like")), [F.desc("score"), F.col("row_idx")], None)
    each = (F.struct(F.lit(name).alias("_name"), F.col(column).alias("rank")) for name, column in (("bm25", "bm25"), ("like", "like"), ("hybrid", "rank")))
    return fused.select("qid", "row_idx", F.explode(F.array(*each)).alias("_e")).select("qid", "row_idx", "_e.*").filter("rank is not null")


@dataclass(frozen=True)
class Hybrid:
    """Recall over a corpus; ``pool`` (qid, rank, row_idx) is appended behind rankings whose query no row holds verbatim."""

    corpus: DataFrame
    synonyms: Synonyms = field(default_factory=dict)
    pool: DataFrame | None = None
    depth: int = DEPTH

    def recall_with_trace(self, queries: DataFrame, reranker=None) -> DataFrame:
        """qid, rank, row_idx, score, channels.

        ``reranker`` maps ranked rows to ranked rows of the same ids; like the pool
        it is passed over for queries that some row holds verbatim.
        """
        depth = max(self.depth, RERANK_DEPTH) if reranker else self.depth
        lists = channels(self.corpus, queries, self.synonyms, depth)
        fused = rrf(lists)
        if self.pool is not None:
            # one table with windows by query, since each further use of the lists would search all texts again
            none, by = F.lit(None).cast("int"), Window.partitionBy("qid")
            tail = self.pool.select("qid", none.alias("rank"), "row_idx", F.lit(0.0).alias("score"), F.array(F.lit("semantic")).alias("channels"), F.col("rank").alias("_at"))
            both = fused.select("qid", "rank", "row_idx", "score", "channels", none.alias("_at")).unionByName(tail)
            both = both.withColumn("_known", F.max("rank").over(Window.partitionBy("qid", "row_idx")))
            both = both.withColumn("_end", F.coalesce(F.max("rank").over(by), F.lit(0))).withColumn("_exact", F.max(F.array_contains("channels", "like")).over(by))
            both = both.filter("rank is not null or (_known is null and not _exact)")
            behind = F.row_number().over(Window.partitionBy("qid", F.col("rank").isNull()).orderBy("_at", "row_idx"))
            fused = both.withColumn("rank", F.coalesce("rank", (F.col("_end") + behind).cast("int"))).select("qid", "rank", "row_idx", "score", "channels")
        exact = lists.filter("channel = 'like'").select("qid").distinct()
        if reranker:
            fused = fused.join(exact, "qid", "left_semi").unionByName(reranker(fused.join(exact, "qid", "left_anti")))
        return fused.select("qid", "rank", "row_idx", "score", "channels")

    def search(self, queries: DataFrame, k: int = 5, reranker=None) -> DataFrame:
        """The first k with their citations."""
        deep = Hybrid(self.corpus, self.synonyms, self.pool, max(self.depth, k))
        hits = deep.recall_with_trace(queries, reranker).filter(F.col("rank") <= k)
        return cite(hits, self.corpus, "hybrid")


def cite(hits: DataFrame, corpus: DataFrame, retriever: str) -> DataFrame:
    """qid, rank, id, law, num, text, score, retriever, channels if any."""
    rows = hits.join(corpus.select("row_idx", "id", "law", "num", "text"), "row_idx")
    more = ["channels"] if "channels" in hits.columns else []
    return rows.select("qid", "rank", "id", "law", "num", "text", F.round("score", 6).alias("score"), F.lit(retriever).alias("retriever"), *more)


def guarded(queries: DataFrame, most: int = 200) -> DataFrame:
    """Queries collapsed and cut to ``most`` characters: qid, query, truncated, empty."""
    q = T.collapse(F.coalesce("query", F.lit("")))
    return queries.select("qid", F.substring(q, 1, most).alias("query"), (F.length(q) > most).alias("truncated"), (q == "").alias("empty"))


def parameter_scan(corpus: DataFrame, queries: DataFrame, bs: list[float], k: int = 10) -> DataFrame:
    """b, qid, rank, row_idx, score: BM25 under each length weight from one pass over the terms."""
    value = F.get(F.array(*(F.lit(float(b)) for b in bs)), F.col("setting"))
    scored = _scored(corpus, queries, k, [(K1, b) for b in bs]).select(value.alias("b"), "qid", "row_idx", "score")
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("b", "qid").orderBy(F.desc("score"), "row_idx")))
    return out.filter(F.col("rank") <= k)
