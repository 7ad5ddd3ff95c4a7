"""Fragment producers: from paragraphs of a source to gated corpus rows, whole-document units, patched gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .etl import SENTENCE_ENDS, deinterleave, document_gate, gated, is_garbage, numbered, quality, split_articles

# Characters of a whole-document unit, words of its title, words of a notice that is none, damaged characters, lines searched, longest line of a title.
WHOLE_MIN, WHOLE_MAX, TITLE_LINES, TITLE_LINE_MAX = 150, 3000, 40, 40
TITLE_WORDS, NOTICE_WORDS = "批复|规定|解释|决定|办法|纪要", "已于|现予公布|起施行|通过）"
DAMAGED = "[\ue000-\uf8ff\U00010000-\U0010ffff]"
WHOLE = "全文"


def whole_documents(paragraphs: DataFrame) -> DataFrame:
    """doc, num, text: short documents without article labels as one unit, from the title on; others are left out.

    The title is the first line with one of its words that is no notice and no
    sentence; lines before it that are short and no sentences belong to it. Lines with
    damaged characters do not count.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    sound = paragraphs.filter(~F.col("line").rlike(DAMAGED) & (F.col("line") != ""))
    # documents are measured before their lines are gathered
    sizes = sound.groupBy("doc").agg(F.sum(F.length("line")).alias("_n")).filter(F.col("_n").between(WHOLE_MIN, WHOLE_MAX))
    d = sound.join(sizes, "doc").groupBy("doc").agg(lines.alias("l"))
    ends = lambda x: F.instr(F.lit(SENTENCE_ENDS.replace("：", "")), F.right(x, F.lit(1))) > 0
    title = lambda x: x.rlike(TITLE_WORDS) & ~x.rlike(NOTICE_WORDS) & ~F.endswith(x, F.lit("。"))
    places = F.sequence(F.lit(0), F.least(F.size("l"), F.lit(TITLE_LINES)) - 1)
    d = d.withColumn("_title", F.array_min(F.filter(places, lambda i: title(F.get("l", i))))).filter("_title is not null")
    apart = F.filter(F.sequence(F.lit(0), F.col("_title")), lambda i: (i < F.col("_title")) & ((F.length(F.get("l", i)) > TITLE_LINE_MAX) | ends(F.get("l", i))))
    begin = F.coalesce(F.array_max(apart) + 1, F.lit(0))
    d = d.withColumn("text", F.array_join(F.slice("l", begin + 1, F.size("l")), ""))
    return d.filter((F.length("text") >= WHOLE_MIN) & ends(F.col("text"))).select("doc", F.lit(WHOLE).alias("num"), "text")


def restored_whole_documents(paragraphs: DataFrame) -> DataFrame:
    """``whole_documents`` of pages whose columns are first restored and whose furniture is dropped."""
    return whole_documents(deinterleave(paragraphs).filter(~is_garbage(F.col("line"))))


def fragment(paragraphs: DataFrame, titles: DataFrame, id_base: int, *, numbering: str = "article", mirror: bool = False, restore: bool = False) -> DataFrame:
    """id, law, num, text of the articles of documents that pass their gates; titles: doc, law. Ids are consecutive from ``id_base`` + 1."""
    lines = deinterleave(paragraphs) if restore else paragraphs
    articles = split_articles(lines, numbering)
    found = quality(articles, lines.groupBy("doc").agg(F.sum(F.length("line")).alias("chars")))
    passed = found.filter(document_gate(mirror)).select("doc")
    kept = gated(articles.join(passed, "doc", "left_semi")).filter("keep").select("doc", "ord", "num", "text")
    rows = numbered(kept, "doc", "ord", "_n").join(titles, "doc")
    return rows.select((F.lit(id_base) + F.col("_n")).cast("long").alias("id"), "law", "num", "text")


def report(paragraphs: DataFrame, *, numbering: str = "article", mirror: bool = False) -> DataFrame:
    """The rows of ``quality`` with ``passes``: why documents of a source were taken or not."""
    found = quality(split_articles(paragraphs, numbering), paragraphs.groupBy("doc").agg(F.sum(F.length("line")).alias("chars")))
    return found.withColumn("passes", document_gate(mirror))


def stale(sources: DataFrame) -> DataFrame:
    """doc, stale of (doc, source_year, base_date): whether a source is older than the year of the base, where both are known."""
    year = F.substring(F.coalesce("base_date", F.lit("")), 1, 4).try_cast("int")
    return sources.select("doc", F.coalesce(F.col("source_year") < year, F.lit(False)).alias("stale"))


def source_year(paragraphs: Column, name: Column) -> Column:
    """The largest year in a file's name and the first four paragraphs; null if none."""
    texts = F.concat(F.array(F.coalesce(name, F.lit(""))), F.slice(paragraphs, 1, 4))
    years = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit("(?:19|20)[0-9]{2}"), F.lit(0))))
    return F.array_max(years).cast("int")


def version_line(paragraphs: Column) -> Column:
    """The first 200 characters of the first of 40 paragraphs that tells of an amendment or a publication; empty if none."""
    told = F.filter(F.slice(paragraphs, 1, 40), lambda p: p.rlike("修订|公布"))
    return F.coalesce(F.substring(F.get(told, F.lit(0)), 1, 200), F.lit(""))


def patched(gold: DataFrame, patches: DataFrame, corpus: DataFrame) -> DataFrame:
    """gold (qid, gold_ids, gold_laws, evidence) with the rows of ``patches`` (same columns) in place of its own.

    Raises if a patch is for no question, or if no row of its ids holds its evidence
    verbatim, white space apart.
    """
    unknown = patches.join(gold.select("qid"), "qid", "left_anti").select("qid")
    texts = patches.select("qid", "evidence", F.explode("gold_ids").alias("id")).join(corpus.select("id", "text"), "id")
    held = texts.filter(F.contains(T.squeeze(F.col("text")), T.squeeze(F.col("evidence")))).select("qid").distinct()
    bad = [r.qid for r in unknown.union(patches.select("qid").join(held, "qid", "left_anti")).distinct().collect()]  # patches are few
    if bad:
        raise ValueError(f"patches that do not hold: {', '.join(map(str, sorted(bad)))}")
    new = patches.select("qid", *(F.col(c).alias(f"_{c}") for c in ("gold_ids", "gold_laws", "evidence")), F.lit(True).alias("_new"))
    value = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return gold.join(new, "qid", "left").select("qid", *(value(c) for c in ("gold_ids", "gold_laws", "evidence")))
