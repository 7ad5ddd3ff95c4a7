"""The driver's tables as corpora, queries and vectors, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.grams import containing

#: Key and values of the synonym table that the registered queries use.
SYNONYMS = {"thin": ["stand", "erth"], "ción": ["mente"], "ung": ["heit"], "ment": ["tion"]}
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_idx"), F.col("doc_id").alias("id"), F.col("source").alias("law"), F.col("lang").alias("num"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 characters of each benchmark passage."""
    d = read(spark, sf_dir, "benchmark")
    return d.select(F.col("item_id").alias("qid"), T.collapse(F.substring("text", 1, 20)).alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "embeddings")
    return d.select(F.col("vec_id").alias("row_idx"), F.lit("m").alias("model"), F.col("embedding").alias("vec"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors divisible by 20 as queries, the next vector as a second variant."""
    d = read(spark, sf_dir, "embeddings")
    first = d.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.lit("m").alias("model"), F.lit("q").alias("variant"), F.col("embedding").alias("vec"))
    second = d.filter("vec_id % 20 = 1").select((F.col("vec_id") - 1).alias("qid"), F.lit("m").alias("model"), F.lit("e").alias("variant"), F.col("embedding").alias("vec"))
    return first.unionByName(second)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, gold_ids: the documents whose squeezed text holds the squeezed passage; passages in none are left out."""
    d = corpus(spark, sf_dir).select("row_idx", T.squeeze(F.col("text")).alias("text"))
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), T.squeeze(F.col("text")).alias("needle"))
    return containing(d, b).groupBy("qid").agg(F.array_sort(F.collect_list("row_idx")).alias("gold_ids"))


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that both engines have the same types."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


SQL_CORPUS = f"c AS (SELECT doc_id AS row_idx, text, regexp_replace(coalesce(text, ''), '{WS}', '', 'g') AS sq FROM documents)"
SQL_QUERIES = f"q AS (SELECT item_id AS qid, trim(regexp_replace(substr(text, 1, 20), '{WS}', ' ', 'g')) AS query FROM benchmark)"
_GRAMS = "CASE WHEN len({0}) < 2 THEN {0} ELSE list_transform(range(1, len({0})), lambda i: {0}[i] || {0}[i + 1]) END"
SQL_GRAMS = f"""dg AS (SELECT row_idx, unnest({_GRAMS.format("ch")}) AS gram FROM (SELECT row_idx, regexp_extract_all(sq, '(?s).') AS ch FROM c)),
dl AS (SELECT row_idx, CASE WHEN length(sq) < 2 THEN length(sq) ELSE length(sq) - 1 END AS dl FROM c),
tt AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM dl)"""


def sql_bm25(name: str, query: str, b: str = "0.6", k: int = 10, extra: str = "") -> str:
    """CTEs that end in ``name`` (qid, row_idx, score, rank) for the queries of the CTE ``query``; ``extra`` are more columns of it that part rankings."""
    part = f", {extra}" if extra else ""
    return f"""{name}_w AS (SELECT qid{part}, regexp_extract_all(w, '(?s).') AS ch FROM (SELECT qid{part}, unnest(string_split(query, ' ')) AS w FROM {query}) WHERE w <> ''),
{name}_g AS (SELECT qid{part}, gram, count(*) AS times FROM (SELECT qid{part}, unnest({_GRAMS.format("ch")}) AS gram FROM {name}_w) GROUP BY ALL),
{name}_p AS (SELECT gram, row_idx, count(*) AS tf FROM dg WHERE gram IN (SELECT gram FROM {name}_g) GROUP BY ALL),
{name}_d AS (SELECT gram, count(*) AS df FROM {name}_p GROUP BY gram),
{name}_s AS (SELECT qid{part}, row_idx, round(sum(times * ln((n - df + 0.5) / df + 1.0) * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * dl / avg_dl))), 6) AS score
  FROM {name}_p JOIN {name}_g USING (gram) JOIN {name}_d USING (gram) JOIN dl USING (row_idx) CROSS JOIN tt GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid{part} ORDER BY score DESC, row_idx) AS rank FROM {name}_s) WHERE rank <= {k})"""


def sql_like(name: str, k: int = 10) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT qid, row_idx, instr(text, query) AS position, row_number() OVER (PARTITION BY qid ORDER BY instr(text, query), row_idx) AS rank
  FROM c JOIN q ON instr(text, query) > 0) WHERE rank <= {k})"""


SQL_EXPANDED = """x AS (SELECT qid, query, regexp_extract_all(query, 'ción|ment|thin|ung') AS keys FROM q),
xq AS (SELECT qid, query || ' ' || array_to_string(list_distinct(flatten(list_transform(keys, lambda k: CASE k WHEN 'thin' THEN ['stand', 'erth'] WHEN 'ción' THEN ['mente'] WHEN 'ung' THEN ['heit'] ELSE ['tion'] END))), ' ') AS query
  FROM x WHERE len(keys) > 0)"""


def sql_channels(k: int = 30) -> str:
    return f"""{SQL_CORPUS}, {SQL_QUERIES}, {SQL_GRAMS}, {SQL_EXPANDED},
{sql_bm25("b", "q", k=k)}, {sql_bm25("e", "xq", k=k)}, {sql_like("l", k)},
ch AS (SELECT qid, 'bm25' AS channel, 1.0 AS weight, rank, row_idx FROM b UNION ALL SELECT qid, 'expand', 1.5, rank, row_idx FROM e UNION ALL SELECT qid, 'like', 1.0, rank, row_idx FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_idx) AS rank
  FROM (SELECT qid, row_idx, round(sum(weight::DOUBLE / (60 + rank)), 9) AS score, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels FROM ch GROUP BY qid, row_idx))"""


SQL_GOLD = f"""g AS (SELECT item_id AS qid, row_idx FROM c JOIN benchmark ON instr(sq, regexp_replace(benchmark.text, '{WS}', '', 'g')) > 0)"""
SQL_VECTORS = """v AS (SELECT vec_id AS row_idx, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
qv AS (SELECT row_idx - row_idx % 20 AS qid, row_idx % 20 AS variant, x AS y FROM v WHERE row_idx % 20 < 2),
si AS (SELECT qid, variant, row_idx, round(list_dot_product(x, y), 6) AS sim FROM v CROSS JOIN qv),
sr AS (SELECT qid, row_idx, min(r) AS sem FROM (SELECT qid, row_idx, row_number() OVER (PARTITION BY qid, variant ORDER BY sim DESC, row_idx) AS r FROM si) GROUP BY ALL)"""
