"""A training-data pipeline over ``documents``: language, toxicity, near-duplicates, mixing, packing.

A stage reads every row that its predecessor kept and decides on those rows alone;
its rows are written as Parquet and read again by the next stage. A row is a document
of its own: rows without an id, and rows after the first of an id, get a number while
a stage runs, so that none is taken for another, and leave it with their own id.

In every stage nulls in other columns are kept as they are, columns beside those of
``documents`` are not read, whole texts count, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import language, minhash, mixing, packing, toxicity
from loomline.llm._graph import IdFilter
from loomline.llm._store import crc_mod, staged, table
from loomline.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a text's n-grams that its language must explain.
LEAST_LANGUAGE = 0.5


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a unique doc_id, and _id, their own one.

    Where ids are missing or repeat, the documents are staged, and rows without an id
    and all but one of an id get numbers above all ids.
    """
    docs = docs.select(*COLUMNS, F.col("doc_id").alias("_id"))
    per = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if per.filter("n > 1 or doc_id is null").isEmpty():
        return docs
    most = docs.agg(F.max("doc_id")).first()[0] or 0
    docs = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    first = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min("_row").alias("_row")).select("_row", F.lit(True).alias("_first"))
    number = F.when(F.col("_first"), F.col("doc_id")).otherwise(F.lit(most + 1) + F.col("_row"))
    return docs.join(first, "_row", "left").withColumn("doc_id", number).drop("_row", "_first")


def _plain(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the rows' own ids."""
    return docs.withColumn("doc_id", F.col("_id")).select(COLUMNS)


def _flagged(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents without those of ``ids`` (doc_id): a filter finds the candidates, so that few texts are shuffled."""
    marked = IdFilter(ids, "doc_id").mark(docs, "doc_id", "_maybe")
    sure = marked.filter(~F.col("_maybe")).drop("_maybe")
    return sure.unionByName(marked.filter("_maybe").drop("_maybe").join(ids, "doc_id", "left_anti"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and those that no learned language explains.

    Learns from the rows with text, lang and id of three quarters of the ids. Ties of
    languages do not matter here; repeated rows are judged alike.
    """
    docs = _keyed(docs)
    found = language.predict(docs, language.fit(docs.filter(crc_mod("_id", 4) != 2)))
    bad = staged(found.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE)).select("doc_id"), "pipeline-und")
    return _plain(_flagged(docs, bad))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic, learning from two thirds of the labels.

    Null and empty texts have the lowest score and stay, repeated rows are judged
    alike, and without labels of these documents all stay.
    """
    docs = _keyed(docs)
    model = toxicity.fit(_plain(docs), table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1))
    bad = staged(toxicity.score(docs, model).filter("predicted = 1").select("doc_id"), "pipeline-toxic")
    return _plain(_flagged(docs, bad))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of smallest id, one without an id only where no other has one.

    Texts without words (null and empty ones too) are near nothing and stay.
    """
    docs = _keyed(docs)
    bad = staged(minhash.near_duplicates(docs).filter("not kept").select("doc_id"), "pipeline-copies")
    return _plain(_flagged(docs, bad))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the mix, a row for each run of blocks that a round of it takes from a document.

    A document taken whole is a row with its text as it is; n_chars is that of the
    row's text. Texts without words (null and empty ones too) are never taken, null
    sources are a source, and repeated rows are taken each.
    """
    docs = _keyed(docs)
    rows = mixing.mix(docs).texts(docs)
    return _plain(rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; null and empty texts are one closing id, repeated rows are packed each."""
    return packing.with_crc(packing.pack(docs, tokenizer_path()))


#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of ``documents``.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: No stage but the third can be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
