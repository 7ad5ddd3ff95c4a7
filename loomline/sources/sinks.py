"""Writers: corpora and gold as JSON lines or Parquet, small reports as Markdown."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.etl import import_status


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_corpus(rows: DataFrame, path: str) -> dict[str, int]:
    """Articles (id, law, num, text) that pass the import classes as JSON lines, white space compact; how many rows of each class there were."""
    classed = rows.withColumn("_class", import_status(F.col("text")))
    taken = classed.filter("_class = 'imported'").select("id", "law", "num", T.collapse(F.col("text")).alias("text"))
    write_json_lines(taken, path)
    counts = {r["_class"]: r["n"] for r in classed.groupBy("_class").agg(F.count("*").alias("n")).collect()}  # four classes
    return {"total": sum(counts.values()), **{k: counts.get(k, 0) for k in ("imported", "cid", "short", "empty")}}


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (row_idx, model, vec) as Parquet, their numbers as half-precision bytes (little-endian), two to a component."""

    def run(parts):
        for pdf in parts:
            yield pdf[["row_idx", "model"]].assign(dim=[len(v) for v in pdf["vec"]], half=[np.asarray(v, "<f2").tobytes() for v in pdf["vec"]])

    vectors.select("row_idx", "model", "vec").mapInPandas(run, "row_idx long, model string, dim int, half binary").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vectors that ``write_vectors`` wrote: row_idx, model, vec."""

    def run(parts):
        for pdf in parts:
            yield pdf[["row_idx", "model"]].assign(vec=[np.frombuffer(h, "<f2").astype(float) for h in pdf["half"]])

    return spark.read.parquet(path).mapInPandas(run, "row_idx long, model string, vec array<double>")


def metrics_report(found: DataFrame, rows: int, about: str) -> str:
    """Recall and MRR of retrievers (retriever, k, n, recall_at_k, mrr) as a Markdown table with a line on what was measured."""
    shown = found.orderBy("retriever", "k").select("retriever", "k", F.format_string("%.1f%%", F.col("recall_at_k") * 100).alias("recall"), F.format_string("%.3f", "mrr").alias("mrr"))
    asked = found.agg(F.max("n")).first()[0] or 0
    return f"{markdown_table(shown)}\n\n{asked} questions, {rows} rows; {about}\n"


def worksheet(gold: DataFrame, most: int = 2000) -> str:
    """A Markdown table for reviewing gold (qid, query, law, num, gold_laws, evidence, source_site, source_url, status), at most ``most`` questions long."""
    first = F.concat_ws(" ", "law", "num")
    rest = F.array_join(F.filter("gold_laws", lambda x: x != first), "; ")
    named = F.when(rest != "", F.concat_ws("; ", first, rest)).otherwise(first)
    cut = lambda c, n: F.when(F.length(F.trim(c)) > n, F.concat(F.substring(F.trim(c), 1, n), F.lit("…"))).otherwise(F.trim(c))
    site = F.format_string("[%s](%s)", F.coalesce("source_site", F.lit("-")), F.coalesce("source_url", F.lit("")))
    state = F.when(F.coalesce("status", F.lit("")).isin("", "pending"), "☐").otherwise(F.col("status"))
    done = gold.groupBy(state.alias("s")).agg(F.count("*").alias("n")).orderBy("s").collect()  # a row a status
    shown = gold.orderBy("qid").select("qid", cut(F.col("query"), 30).alias("question"), named.alias("articles"), cut(F.col("evidence"), 40).alias("evidence"), site.alias("source"), state.alias("review"))
    return ", ".join(f"{r.s} {r.n}" for r in done) + "\n\n" + markdown_table(shown, most)


def audit_report(flags: DataFrame, laws: DataFrame, uncovered: DataFrame) -> str:
    """Flag counts, the laws with most flags and the titles without rows, as Markdown."""
    parts = [("Flags", flags), ("Laws", laws), ("Not covered", uncovered)]
    return "\n\n".join(f"## {name}\n\n{markdown_table(table)}" for name, table in parts) + "\n"


def cell(value: object, most: int = 120) -> str:
    """A Markdown table cell: one line, bars escaped, cut to ``most`` characters."""
    s = "" if value is None else str(value)
    s = s.replace("\n", " ").replace("|", "\\|")
    return s if len(s) <= most else s[: most - 1] + "…"


def markdown_table(df: DataFrame, most_rows: int = 120) -> str:
    """A report table of a small result; rows beyond ``most_rows`` are only mentioned."""
    rows = df.limit(most_rows + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most_rows]]
    return "\n".join([*lines, "(more rows in the data)"] if len(rows) > most_rows else lines)
