"""Corpus audit and coverage: row flags, duplicates, sources, catalogue matching, directories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Lengths of tiny and very long rows, upper median of a narrow column, page furniture, name of a whole document.
TINY, VERY_LONG, NARROW = 10, 2000, 20
FURNITURE, PAGE_MARK, WHOLE = "全国人民代表大会常务委员会公报", "—[０-９]{1,4}—", "全文"
# Sources and the first id of each.
GAZETTE, DOCX, ZHUMA, FLK = "gazette", "docx", "zhuma", "flk"


def source_of(source: Column, row_id: Column) -> Column:
    """By words of the row's own source, else by the range of its number."""
    s = F.coalesce(source, F.lit(""))
    return (
        F.when(F.contains(s, F.lit("zhumavip")), ZHUMA).when(F.contains(s, F.lit("flk")), FLK)
        .when(row_id >= 980000, FLK).when(row_id >= 970000, ZHUMA).when(row_id >= 900000, DOCX).otherwise(GAZETTE)
    )


#: The flags of a row, in the order in which they are listed.
FLAGS = ["empty-or-tiny", "very-long", "whole-document", "num-mapped", "dup-law-num", "polluted-interleave", "narrow-no-furniture"]


#: Characters whose fragments are found at a time; which code points are white space, the last of the table standing for all above.
PORTION = 1 << 20
_SPACE = np.zeros(max(map(ord, T.SPACE_CHARS)) + 2, bool)
_SPACE[[ord(c) for c in T.SPACE_CHARS]] = True


def _shapes(texts: pd.Series) -> pd.DataFrame:
    """solid, narrow of UTF-8 texts, from one look at each character."""
    said = [x.decode("utf-8", "replace") for x in texts]
    solid, narrow = np.zeros(len(said), np.int64), np.zeros(len(said), bool)
    lo, size = 0, 0
    for hi, t in enumerate(said, 1):
        size += len(t)
        if size < PORTION and hi < len(said):
            continue
        part = said[lo:hi]
        flat = np.frombuffer("\n".join([*part, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)  # each text ends in a line's end
        change = np.diff((~_SPACE[np.minimum(flat, len(_SPACE) - 1)]).view(np.int8), prepend=np.int8(0))
        begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        of = np.searchsorted(np.cumsum([len(x) + 1 for x in part]), begin, "right")
        every, short = np.bincount(of, minlength=len(part)), np.bincount(of[end - begin < NARROW], minlength=len(part))
        solid[lo:hi] = np.bincount(of, end - begin, len(part))
        narrow[lo:hi] = (every > 0) & (short >= every // 2 + 1)
        lo, size = hi, 0
    return pd.DataFrame({"solid": solid, "narrow": narrow})


def text_shape(text: Column) -> Column:
    """solid: characters that are no white space; narrow: whether the upper median length of blank-separated fragments is
    small, that is more than half of them are short, or half of an odd rest."""
    return F.pandas_udf(_shapes, "solid long, narrow boolean")(F.coalesce(text, F.lit("")).cast("binary"))


def row_flags(rows: DataFrame) -> DataFrame:
    """rows (id, law, num, text, source, unit, num_origin) with ``flags`` and ``origin``."""
    text = F.coalesce("text", F.lit(""))
    furniture = F.contains(text, F.lit(FURNITURE)) | text.rlike(PAGE_MARK)
    d = rows.withColumn("origin", source_of(F.col("source"), F.col("id"))).withColumn("_shape", text_shape(F.col("text")))
    # what texts tell is told before the join, so that they are moved for those only who want them
    d = d.withColumn("_narrow", (F.col("origin") == GAZETTE) & F.col("_shape.narrow"))
    d = d.withColumns({"_tiny": F.col("_shape.solid") < TINY, "_long": F.length(text) > VERY_LONG, "_furniture": F.col("_narrow") & furniture}).drop("_shape")
    # pairs are counted and joined, so that no frequent pair gathers its rows in one task
    twice = duplicate_pairs(rows).select(F.struct("law", "num").alias("_pair"))
    d = d.join(twice, F.struct("law", "num").eqNullSafe(F.col("_pair")), "left")
    tests = [
        F.col("_tiny"),
        F.col("_long"),
        (F.col("num") == WHOLE) | (F.col("unit") == "whole-document"),
        F.col("num_origin").isNotNull() & ~F.col("num_origin").eqNullSafe(F.col("num")),
        F.col("_pair").isNotNull(),
        F.col("_furniture"),
        F.col("_narrow") & ~F.col("_furniture"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in zip(FLAGS, tests, strict=True))))
    return d.withColumn("flags", found).drop("_pair", "_tiny", "_long", "_narrow", "_furniture")


def audit(flagged: DataFrame, *by: str) -> DataFrame:
    """The columns ``by``, rows, flagged (sum of flags, not of rows), then a count of each flag, its name with underscores."""
    each = (F.count_if(F.array_contains("flags", n)).alias(n.replace("-", "_")) for n in FLAGS)
    return flagged.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.size("flags")).alias("flagged"), *each)


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def problem_laws(flagged: DataFrame, most: int = 20) -> DataFrame:
    return audit(flagged, "law").filter("flagged > 0").orderBy(F.desc("flagged"), "law").limit(most).select("law", "rows", "flagged")


def duplicate_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("law", "num").agg(F.count("*").alias("n")).filter("n > 1")


def corpus_stats(flagged: DataFrame) -> DataFrame:
    """origin, rows, laws."""
    return flagged.groupBy("origin").agg(F.count("*").alias("rows"), F.countDistinct("law").alias("laws"))


def multi_source(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(T.normalize_title(F.col("law")).alias("title")).agg(F.countDistinct("origin").alias("origins")).filter("origins > 1")


def coverage(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """title, covered of a catalogue (ord, title), titles taken once; matched by normal titles."""
    once = catalog.groupBy("title").agg(F.min("ord").alias("ord")).withColumn("key", T.normalize_title(F.col("title")))
    have = rows.select(T.normalize_title(F.col("law")).alias("key")).distinct().withColumn("covered", F.lit(True))
    return once.join(have, "key", "left").select("title", F.coalesce("covered", F.lit(False)).alias("covered"))


def uncovered(found: DataFrame) -> DataFrame:
    """title of what no row covers, by title."""
    return found.filter("not covered").select("title").orderBy("title")


def title_duplicates(catalog: DataFrame) -> DataFrame:
    """key, titles: different titles of a catalogue that are one when normalised."""
    keys = catalog.select(T.normalize_title(F.col("title")).alias("key"), "title").distinct().groupBy("key")
    return keys.agg(F.array_sort(F.collect_set("title")).alias("titles")).filter(F.size("titles") > 1)


def title_matches(key: Column, title: Column) -> Column:
    """Whether a title is the key or ends with it; an empty key matches nothing."""
    return (F.length(key) > 0) & ((title == key) | F.endswith(title, key))


def source_status(laws: DataFrame, sources: DataFrame, key=T.norm_title) -> DataFrame:
    """law, source: the source (title) with the law's normalised title, the smallest of several, null where there is none."""
    named = sources.select(key(F.col("title")).alias("_key"), "title").groupBy("_key").agg(F.min("title").alias("source"))
    return laws.select("law").distinct().withColumn("_key", key(F.col("law"))).join(named, "_key", "left").select("law", "source")


def coverage_rate(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"), F.count_if("covered").alias("covered"), F.round(F.avg(F.col("covered").cast("int")), 6).alias("rate"))


def catalog_tree(documents: DataFrame, levels: int = 6) -> DataFrame:
    """subject, title, id, has_body of JSON catalogues (value) nested ``levels`` deep at most: every node below a subject, with whether it has a body.

    Each level is one explode of the level before; deeper nodes are left out.
    """
    node = "struct<title:string,id:long,children:string>"
    level = documents.select(F.explode(F.from_json("value", f"array<{node}>")).alias("n")).select(F.trim("n.title").alias("subject"), "n.children")
    out = None
    for _ in range(levels):
        below = level.select("subject", F.explode(F.from_json("children", f"array<{node}>")).alias("n"))
        part = below.select("subject", F.trim("n.title").alias("title"), "n.id", (F.coalesce(F.json_array_length("n.children"), F.lit(0)) > 0).alias("has_body"))
        out = part if out is None else out.unionByName(part)
        level = below.select("subject", "n.children")
    return out


def catalog_titles(tree: DataFrame) -> DataFrame:
    """subject, title, has_body of a catalogue tree (title, children of title, id, children)."""
    return tree.select(F.col("title").alias("subject"), F.explode("children").alias("c")).select("subject", F.col("c.title").alias("title"), F.col("c.id").isNotNull().alias("has_body"))


def law_directory(rows: DataFrame) -> DataFrame:
    """law, n, place by falling count, then name."""
    d = rows.groupBy("law").agg(F.count("*").alias("n"))
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "law")))


def articles_of_law(rows: DataFrame, law: str, limit: int = 500) -> DataFrame:
    """The first rows of a law in row order; ``limit`` is kept between 1 and 500."""
    return rows.filter(F.col("law") == law).orderBy("row_idx").limit(min(max(limit, 1), 500)).select("row_idx", "id", "law", "num", "text")


def page_blocks(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """law, ratio: laws of which at least half the rows hold several article labels."""
    marks = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("第[一二三四五六七八九十百千零〇]+条"), F.lit(0)))
    return rows.groupBy("law").agg(F.round(F.avg(F.when(marks > 1, 1.0).otherwise(0.0)), 6).alias("ratio")).filter(F.col("ratio") >= least)


def meta(rows: DataFrame) -> DataFrame:
    """rows, laws, chars of a corpus."""
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("law").alias("laws"), F.sum(F.length("text")).alias("chars"))
