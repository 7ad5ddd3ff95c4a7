"""Readers: JSON lines, SQLite, word-processor and Markdown files, directories as indexes, catalogues."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

ARTICLE_SCHEMA = "row_idx long, id string, law string, num string, text string, meta map<string,string>"
REVIEWED = ["qid", "query", "law", "num", "gold_laws", "evidence", "source_site", "source_url"]
GOLD_SCHEMA = "qid string, query string, question string, gold_id long, law string, num string, gold_ids array<long>, gold_laws array<string>, source_site string, source_url string, evidence string"
SPEC_SCHEMA = "question string, url string, anchors array<string>, source_site string, verified boolean, prefer_num string, unverified_reason string"


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of JSON lines; row_idx is the place of a row in the file, whether or not the file has one.

    Places are counted by the file's offsets: parts in their order, then lines in a part.
    """
    lines = spark.read.text(path).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    rows = lines.filter(F.trim("value") != "").withColumn("_s", F.from_json("value", ARTICLE_SCHEMA, {"mode": "FAILFAST"}))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))  # a row a part
    ahead = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("_part", ahead.alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    placed = rows.withColumn("_inside", inside).join(F.broadcast(begins), "_part")
    return placed.select((F.col("_ahead") + F.col("_inside")).cast("long").alias("row_idx"), "_s.id", "_s.law", "_s.num", "_s.text", "_s.meta")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` if it has rows and every listed column of each is filled; raises otherwise."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | (F.col(c).cast("string") == "")
    total, wrong = df.agg(F.count("*"), F.count_if(bad)).first()
    if not total or wrong:
        raise ValueError(f"{wrong} of {total} rows lack one of {', '.join(columns)}")
    return df


def reviewed_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold for a review; it has rows, and the columns ``REVIEWED`` of each are filled."""
    d = required(json_lines(spark, path, GOLD_SCHEMA), [c for c in REVIEWED if c != "gold_laws"])
    if n := d.filter(F.coalesce(F.size("gold_laws"), F.lit(0)) <= 0).count():
        raise ValueError(f"{n} rows lack gold_laws")
    return d


def gold_specs(spark: SparkSession, path: str) -> DataFrame:
    """Gold specifications: question and url filled, anchors too unless ``verified`` is false."""
    d = required(json_lines(spark, path, SPEC_SCHEMA), ["question", "url"])
    open_ = F.coalesce(F.col("verified"), F.lit(True)) & (F.coalesce(F.size("anchors"), F.lit(0)) <= 0)
    if n := d.filter(open_).count():
        raise ValueError(f"{n} verified specifications have no anchors")
    return d


def review_status(spark: SparkSession, path: str) -> DataFrame:
    """qid, status, reviewer, date, note of a JSON object by question; keys that begin with ``_`` are dropped, a missing file is empty."""
    entry = "struct<status:string,reviewer:string,date:string,note:string>"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "qid string, status string, reviewer string, date string, note string")
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("qid", "s"))
    return d.filter(~F.startswith("qid", F.lit("_"))).select("qid", "s.*")


def sqlite(spark: SparkSession, path: str, table: str, columns: Sequence[str], schema: str, key: str = "rowid", ranges: int = 8) -> DataFrame:
    """A SQLite table, read in ``ranges`` of its integer key by as many tasks. The file must be visible to the executors."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        lo, hi = db.execute(f"SELECT min({key}), max({key}) FROM {table}").fetchone()
    if lo is None:
        return spark.createDataFrame([], schema)
    step = max(1, -(-(hi - lo + 1) // ranges))
    bounds = spark.createDataFrame([(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)], "a long, b long")

    def run(parts):
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for pdf in parts:
                for a, b in zip(pdf["a"], pdf["b"], strict=True):
                    yield pd.read_sql_query(f"SELECT {', '.join(columns)} FROM {table} WHERE {key} BETWEEN {int(a)} AND {int(b)} ORDER BY {key}", db)

    return bounds.repartition(ranges, "a").mapInPandas(run, schema)


def _docx_text(contents: pd.Series) -> pd.Series:
    """The paragraphs of word-processor files, one to a line."""
    from xml.etree import ElementTree

    def one(content: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(content)) as archive, archive.open("word/document.xml") as part:
            lines, runs = [], []
            for _, node in ElementTree.iterparse(part):
                kind = node.tag.rpartition("}")[2]
                if kind == "t":
                    runs.append(node.text or "")
                elif kind == "p":
                    lines.append("".join(runs))
                    runs = []
        return "\n".join(lines)

    return contents.map(one)


def _prose(line: Column) -> Column:
    """A Markdown line as prose: no emphasis; null for headings, comments and quotations."""
    bare = T.collapse(line)
    return F.when(~bare.rlike("^(#|<!--|-->|>)"), T.collapse(F.translate(bare, "*", "")))


def paragraphs(spark: SparkSession, path: str, normalized: bool = False) -> DataFrame:
    """doc (the file's path), pos, line of the word-processor and Markdown files under ``path``, told apart by their first
    bytes; blank lines are left out. ``normalized``: lines also go through ``normalize_line``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc"), "content")
    zipped = F.substring("content", 1, 2) == F.lit(b"PK")
    word = files.filter(zipped).select("doc", F.split(F.pandas_udf(_docx_text, "string")("content"), "\n").alias("lines"))
    word = word.withColumn("lines", F.transform("lines", T.collapse))
    plain = files.filter(~zipped).select("doc", F.transform(F.split(F.col("content").cast("string"), r"\r\n|[\r\n]"), _prose).alias("lines"))
    found = word.unionByName(plain).select("doc", F.filter("lines", lambda x: x.isNotNull() & (x != "")).alias("lines"))
    lines = found.select("doc", F.posexplode("lines").alias("pos", "line"))
    return lines.withColumn("line", T.normalize_line(F.col("line"))) if normalized else lines


def directory_index(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """key, path, date: of the files of one title the newest, by a date in brackets at the end of the name."""
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path")
    stem = F.regexp_replace(F.element_at(F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/"), -1), r"\.[^.]*$", "")
    dated = r"[(（](\d{4}-\d{2}-\d{2})[)）]$"
    d = files.select("path", F.regexp_extract(stem, dated, 1).alias("date"), T.mirror_key(F.concat(F.regexp_replace(stem, dated, ""), F.lit(".x"))).alias("key"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("date"), "path"))).filter("r = 1").drop("r")


def category_index(spark: SparkSession, path: str, categories: Sequence[str]) -> DataFrame:
    """``directory_index`` of the files below the folders ``categories`` of ``path`` only, with the category; a title in several is taken from the newest file."""
    found = directory_index(spark, [f"{path}/{c}" for c in categories])
    return found.withColumn("category", F.element_at(F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/"), -2))


def database_lines(rows: DataFrame, key: str, content: str) -> DataFrame:
    """doc, pos, line: the trimmed lines of a text column that are not empty."""
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: F.trim(T.squeezed_ends(x))), lambda x: x != "")
    return rows.select(F.col(key).alias("doc"), F.posexplode(lines).alias("pos", "line"))


def npz_vectors(spark: SparkSession, path: str, model: str, ids: str = "ids", vectors: str = "vecs") -> DataFrame:
    """row_idx, model, vec of NumPy archives with an array of ids and a matrix of vectors."""

    def run(parts):
        import numpy as np

        for pdf in parts:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    numbers, matrix = archive[ids], archive[vectors]
                for lo in range(0, len(numbers), 4096):
                    part = matrix[lo : lo + 4096].astype(float)
                    yield pd.DataFrame({"row_idx": numbers[lo : lo + 4096].astype("int64"), "model": model, "vec": list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("content")
    return files.mapInPandas(run, "row_idx long, model string, vec array<double>")


def misaligned(vectors: DataFrame, corpus: DataFrame) -> DataFrame:
    """row_idx, fault: vectors without a row, rows without a vector, and rows with several of one model."""
    v, c = vectors.select("row_idx"), corpus.select("row_idx")
    strange = v.join(c, "row_idx", "left_anti").select("row_idx", F.lit("no row").alias("fault"))
    bare = c.join(v, "row_idx", "left_anti").select("row_idx", F.lit("no vector").alias("fault"))
    many = vectors.groupBy("row_idx", "model").count().filter("count > 1").select("row_idx", F.lit("several vectors").alias("fault"))
    return strange.unionByName(bare).unionByName(many).distinct()


def labelled_path(argument: str) -> tuple[str, str]:
    """(label, path) of ``LABEL=PATH``, or of a path that is its own label."""
    label, mark, path = argument.partition("=")
    return (label.strip(), path.strip()) if mark else (argument.rstrip("/").rpartition("/")[2], argument)


def merged_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """Vector shards as one table; a row number that occurs twice is an error of the shards."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    if out.groupBy("row_idx", "model").count().filter("count > 1").limit(1).count():
        raise ValueError("shards overlap")
    return out
