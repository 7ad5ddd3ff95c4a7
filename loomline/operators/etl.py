"""Corpus building: import classes, article splitting, gates, page restoring, merging, rebuilding.

Paragraph tables have columns doc, pos (order inside the document) and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Shortest article taken over, its marker of damaged fonts.
MIN_LENGTH, CID = 30, "(cid:"
# Fixed values of the article gate: least length, length from which blanks are weighed, most blanks per character, sentence ends, gazette name.
GATE_MIN, DENSITY_FROM, DENSITY_MAX, SENTENCE_ENDS, GAZETTE = 6, 20, 0.065, "。；：！？”』）", "中华人民共和国最高人民法院公报"
FORMULA = "[＝=×÷%％＋+]"
# Fixed values of the document gates: coverage, dropped share and count, coverage of a mirror.
COVERAGE, DROP_SHARE, DROP_COUNT, MIRROR_COVERAGE = 0.90, 0.05, 2, 0.35
# Labels and headings of articles.
ARTICLE = "^第([零一二三四五六七八九十百千]+)条(之[一二三四五六七八九十]+)?"
HEADING = "^第[零一二三四五六七八九十百千]+[编章节]"
SECTION = "^([一二三四五六七八九十]+)、"
ITEM = r"^([0-9]+)\s*[\.．]"
# Lines of page furniture: font codes only; private-use characters, full-width digits, white space and dashes only; short lines of known forms.
CODES_ONLY = r"^(?:\(cid:\d+\)\s*)+$"
PRIVATE_ONLY = f"^[\ue000-\uf8ff\uff10-\uff19{T.SPACE_CLASS}\\-—–·.]+$"
FURNITURE_MAX = 40
FURNITURE = [
    "^[^，。；：！？]*公报[^，。；：！？]*$",
    r"^年第\s*[0-9０-９]*\s*期$",
    r"^年第$|^期$|^第\s*[0-9０-９]+\s*期$",
    "^[0-9０-９]{4}[·.．][0-9０-９]{1,2}$",
    "^[0-9０-９]{4}$",
    r"^-\s*[0-9０-９]{1,4}\s*-?$|^[0-9０-９]{1,4}\s*-$|^-$",
]


def import_status(content: Column) -> Column:
    """empty, cid, short or imported, in this order."""
    stripped = F.regexp_replace(F.coalesce(content, F.lit("")), f"^[{T.SPACE_CLASS}]+|[{T.SPACE_CLASS}]+$", "")
    return F.when(stripped == "", "empty").when(F.contains(stripped, F.lit(CID)), "cid").when(F.length(stripped) < MIN_LENGTH, "short").otherwise("imported")


def is_clean(content: Column) -> Column:
    return import_status(content) == "imported"


def raw_articles(articles: DataFrame, documents: DataFrame) -> DataFrame:
    """Articles (id, doc_id, article_num, content) with their document's title: row_idx in the order of ids, id, law, num, text."""
    rows = articles.join(documents.select(F.col("id").alias("doc_id"), F.col("title").alias("law")), "doc_id")
    return rows.select(F.col("id").alias("row_idx"), "id", "law", F.col("article_num").alias("num"), F.coalesce("content", F.lit("")).alias("text"))


def article_reason(num: Column, text: Column) -> Column:
    """Why the gate rejects an article, in the order of its rules; null if it passes."""
    density = F.regexp_count(text, F.lit(" ")) / F.length(text)
    junk = F.contains(text, F.lit(GAZETTE)) | text.rlike(r"^\s*-\s*\d+\s*-")
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) < GATE_MIN, "short")
        .when(~F.startswith(text, num), "number")
        .when((F.length(text) >= DENSITY_FROM) & (density > DENSITY_MAX), "blanks")
        .when(F.instr(F.lit(SENTENCE_ENDS), F.right(text, F.lit(1))) == 0, "end")
        .when(junk, "furniture")
    )


def gated(articles: DataFrame) -> DataFrame:
    """Articles with reason, keep and soft: an end without a mark is forgiven where a formula stands."""
    why = articles.withColumn("reason", article_reason(F.col("num"), F.col("text")))
    soft = F.coalesce((F.col("reason") == "end") & F.col("text").rlike(FORMULA), F.lit(False))
    return why.withColumn("soft", soft).withColumn("keep", F.col("reason").isNull() | soft)


def split_articles(paragraphs: DataFrame, numbering: str = "article") -> DataFrame:
    """doc, ord, num, text: units opened by a label whose number grows (one with a suffix may repeat it).

    Labels that do not grow belong to the unit before; headings and section marks
    are dropped; text before the first unit is dropped. ``numbering``: ``article``,
    ``list`` (section marks open units too) or ``item`` (numbered items do). A
    number opens a unit exactly if it exceeds all labels before it, since rejected
    ones never exceed those accepted; so a running maximum replaces the fold.
    """
    line = F.col("line")
    article = line.rlike(ARTICLE)
    number = F.when(article, T.cn_to_int(F.regexp_extract(line, ARTICLE, 1)))
    label = F.when(article, F.concat(F.lit("第"), F.regexp_extract(line, ARTICLE, 1), F.lit("条"), F.regexp_extract(line, ARTICLE, 2)))
    if numbering == "list":
        other = ~article & line.rlike(SECTION)
        number = F.when(other, T.cn_to_int(F.regexp_extract(line, SECTION, 1))).otherwise(number)
        label = F.when(other, F.concat(F.lit("第"), F.regexp_extract(line, SECTION, 1), F.lit("条"))).otherwise(label)
    elif numbering == "item":
        other = ~article & line.rlike(ITEM)
        number = F.when(other, F.regexp_extract(line, ITEM, 1).cast("int")).otherwise(number)
        label = F.when(other, F.concat(F.lit("第"), F.regexp_extract(line, ITEM, 1).cast("int").cast("string"), F.lit("条"))).otherwise(label)
    w = Window.partitionBy("doc").orderBy("pos")
    suffixed = article & (F.regexp_extract(line, ARTICLE, 2) != "")
    d = paragraphs.withColumn("_n", number).withColumn("_label", label).withColumn("_suffix", suffixed).withColumn("_article", article)
    before = F.coalesce(F.max("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_opens", F.coalesce(F.when(F.col("_suffix"), F.col("_n") >= before).otherwise(F.col("_n") > before), F.lit(False)))
    dropped = ~F.col("_opens") & ~F.col("_article") & (line.rlike(HEADING) | line.rlike(SECTION))
    d = d.filter(~dropped).withColumn("ord", F.sum(F.col("_opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("ord > 0")
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return d.groupBy("doc", "ord").agg(F.max(F.when(F.col("_opens"), F.col("_label"))).alias("num"), F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("text"))


def best_effort_articles(paragraphs: DataFrame) -> DataFrame:
    """doc, ord, num, text, mode: the list or item split of more units if it has two, else the whole document as one."""
    split = None
    for order, mode in enumerate(("list", "item")):
        part = split_articles(paragraphs, mode).withColumn("mode", F.lit(mode)).withColumn("_o", F.lit(order))
        split = part if split is None else split.unionByName(part)
    sizes = split.groupBy("doc", "mode", "_o").agg(F.count("*").alias("_n")).filter("_n >= 2")
    best = sizes.groupBy("doc").agg(F.min(F.struct(-F.col("_n"), "_o", "mode"))["mode"].alias("mode"))
    chosen = split.drop("_o").join(best, ["doc", "mode"])
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    whole = paragraphs.join(best, "doc", "left_anti").groupBy("doc").agg(F.array_join(F.transform(lines, lambda p: p["line"]), "\n").alias("text"))
    whole = whole.select("doc", F.lit(1).cast("long").alias("ord"), F.lit("全文").alias("num"), "text", F.lit("whole").alias("mode"))
    return chosen.select("doc", "ord", "num", "text", "mode").unionByName(whole)


def quality(articles: DataFrame, totals: DataFrame) -> DataFrame:
    """doc, arts, kept, dropped, soft, mono, complete, cov, cid of split articles (doc, ord, num, text); totals: doc, chars."""
    g = gated(articles).withColumn("_k", T.label_sort_key(F.col("num")))
    kept = g.filter("keep")
    w = Window.partitionBy("doc").orderBy("ord")
    kept = kept.withColumn("_up", F.coalesce(F.lag("_k").over(w) < F.col("_k"), F.lag("ord").over(w).isNull())).withColumn("_sub", F.row_number().over(Window.partitionBy("doc", "_k.base").orderBy("_k.sub")) - 1)
    k = kept.groupBy("doc").agg(
        F.count("*").alias("kept"), F.count_if("soft").alias("soft"), F.bool_and("_up").alias("_up"), F.bool_and(F.col("_k").isNotNull()).alias("_parsed"),
        F.max("_k.base").alias("_top"), F.min("_k.base").alias("_low"), F.countDistinct("_k.base").alias("_bases"), F.bool_and(F.coalesce(F.col("_k.sub") == F.col("_sub"), F.lit(False))).alias("_runs"),
        F.sum(F.length("text")).alias("_chars"), F.count_if(F.contains("text", F.lit(CID))).alias("cid"))
    a = g.groupBy("doc").agg(F.count("*").alias("arts"), F.count_if(~F.col("keep")).alias("dropped"))
    d = totals.join(a, "doc", "left").join(k, "doc", "left")
    mono = F.coalesce(F.col("_parsed") & F.col("_up"), F.lit(False))
    complete = mono & F.coalesce((F.col("_low") == 1) & (F.col("_top") == F.col("_bases")) & F.col("_runs"), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    cov = F.round(F.coalesce("_chars", F.lit(0)) / F.greatest("chars", F.lit(1)), 6)
    return d.select("doc", zero("arts"), zero("kept"), zero("dropped"), zero("soft"), mono.alias("mono"), complete.alias("complete"), cov.alias("cov"), zero("cid"))


def document_gate(mirror: bool = False, least: float | None = None) -> Column:
    """Whether a row of ``quality`` passes; a mirror must also be complete."""
    most = F.greatest(F.lit(DROP_COUNT), F.floor(F.col("arts") * DROP_SHARE))
    good = (F.col("kept") >= 2) & F.col("mono") & (F.col("dropped") <= most)
    return good & (F.col("complete") & (F.col("cov") >= (least or MIRROR_COVERAGE)) if mirror else F.col("cov") >= (least or COVERAGE))


def select_source(candidates: DataFrame) -> DataFrame:
    """doc, source: of candidates (doc, source, priority, passes) the passing one of smallest priority."""
    return candidates.filter("passes").groupBy("doc").agg(F.min(F.struct("priority", "source"))["source"].alias("source"))


def is_garbage(line: Column) -> Column:
    """Page furniture: font codes only, private-use or full-width digits only, or a short line of a known form."""
    short = F.length(line) <= FURNITURE_MAX
    known = F.lit(False)
    for pattern in FURNITURE:
        known = known | line.rlike(pattern)
    return line.rlike(CODES_ONLY) | (~F.contains(line, F.lit(CID)) & (line.rlike(PRIVATE_ONLY) | (short & known)))


def content_blocks(paragraphs: DataFrame) -> DataFrame:
    """doc, block, pos, line without furniture; two furniture lines in a row end a block."""
    w = Window.partitionBy("doc").orderBy("pos")
    d = paragraphs.withColumn("_g", is_garbage(F.col("line"))).withColumn("_cut", (F.col("_g") & F.coalesce(F.lag("_g").over(w), F.lit(False))).cast("int"))
    d = d.withColumn("_c", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("_g"))
    return d.withColumn("block", F.dense_rank().over(Window.partitionBy("doc").orderBy("_c"))).select("doc", "block", "pos", "line")


LABEL = "^第[一二三四五六七八九十百千零〇]+条"


def deinterleave(paragraphs: DataFrame) -> DataFrame:
    """doc, pos, line: the two columns of each block, read line by line in turn, one after the other again.

    Both orders of a block are tried: a label that is smaller than one read before it
    speaks against an order, and the left column comes first unless the other order
    has fewer such labels. What was read before is the running maximum, whatever the
    order of earlier blocks, so both orders are windows and no block waits for another.
    A window holds the lines of one document; documents are publications, not tables.
    """
    n = F.when(F.col("line").rlike(LABEL), T.numeral_of_label(F.col("line")))
    place = F.row_number().over(Window.partitionBy("doc", "block").orderBy("pos")) - 1
    d = content_blocks(paragraphs).withColumn("_n", n).withColumn("_place", place).withColumn("_right", F.col("_place") % 2)
    earlier = Window.partitionBy("doc").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_earlier", F.max("_n").over(earlier))
    for name, first in (("_left_first", F.col("_right")), ("_right_first", -F.col("_right"))):
        read = Window.partitionBy("doc", "block").orderBy(first, "_place").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn(name, (F.col("_n") < F.greatest("_earlier", F.max("_n").over(read))).cast("int"))
    block = Window.partitionBy("doc", "block")
    total = lambda c: F.coalesce(F.sum(c).over(block), F.lit(0))
    side = F.when(total("_right_first") < total("_left_first"), -F.col("_right")).otherwise(F.col("_right"))
    order = Window.partitionBy("doc").orderBy("block", "_side", "_place")
    return d.withColumn("_side", side).select("doc", (F.row_number().over(order) - 1).cast("long").alias("pos"), "line")


def html_paragraphs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, pos, line: scripts and styles dropped, tags as line ends, five entities decoded, lines of up to two
    characters run together until a longer one."""
    # one after the other, so that what a script holds cannot open a style; its long s is a letter that s stands for without case
    t = F.coalesce(html, F.lit(""))
    for tag in ("[sſ]cript", "[sſ]tyle"):
        t = F.regexp_replace(t, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    t = F.regexp_replace(t, "(?s)<[^>]+>", "\n")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&mdash;", "—")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(t, "\n"), T.squeezed_ends), lambda x: x != "")
    # a line begins a paragraph unless it and the one before are both short
    size = lambda i: F.length(F.get("_lines", i))
    begins = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | (size(i) > 2) | (size(F.greatest(i - 1, F.lit(0))) > 2))
    d = pages.select(key, lines.alias("_lines")).withColumn("_begins", F.when(F.size("_lines") > 0, begins))
    # outer: from an inner one Spark infers a test of the array's size, pushes it to the scan and forms all lines of a page again for each of them there
    d = d.select(key, "_lines", "_begins", F.posexplode_outer("_begins").alias("pos", "_from"))
    upto = F.coalesce(F.get("_begins", F.col("pos") + 1), F.size("_lines"))
    whole = F.array_join(F.slice("_lines", F.col("_from") + 1, upto - F.col("_from")), "")
    return d.filter("pos is not null").select(key, "pos", T.normalize_line(whole).alias("line"))


def merge_violations(base: DataFrame, fragment: DataFrame) -> DataFrame:
    """kind, n of what forbids appending ``fragment`` to ``base`` (id, law, num, text); no rows: it may be appended."""
    text = F.coalesce("text", F.lit(""))
    checks = [
        ("id-exists", fragment.join(base.select("id"), "id", "left_semi")),
        ("id-repeated", fragment.groupBy("id").count().filter("count > 1")),
        ("pair-repeated", fragment.groupBy("law", "num").count().filter("count > 1")),
        ("empty-text", fragment.filter(T.squeeze(text) == "")),
        ("damaged-text", fragment.filter(F.contains(text, F.lit(CID)))),
    ]
    out = None
    for kind, rows in checks:
        part = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out.filter("n > 0")


def merge(base: DataFrame, fragment: DataFrame) -> DataFrame:
    """``fragment`` appended to ``base``; raises if anything forbids it."""
    if found := merge_violations(base, fragment).collect():  # five rows at most
        raise ValueError(", ".join(f"{r['kind']}: {r['n']}" for r in found))
    return base.unionByName(fragment)


def numbered(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``rows`` with consecutive numbers from 1 by group and order: counted by group first, so that no task sorts all rows."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))  # a row per group, the only thing that meets in one task
    ahead = F.sum("_size").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select(group, F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_inside", inside).join(begins, group).withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_ahead", "_inside")


def rebuild(base: DataFrame, replacements: DataFrame, id_base: int = 995000, drop_laws: list[str] | None = None, rules: DataFrame | None = None) -> DataFrame:
    """row_idx, id, law, num, text: rows of replaced or dropped laws leave, replacements follow with ids from ``id_base`` + 1.

    Of several replacements of a law the one of smallest priority is taken. ``rules``
    (law, rule) say more: ``drop`` drops a law, ``drop-pageblock`` only its rows that
    hold several labels, ``keep`` keeps it and passes over its replacements.
    """
    spark = base.sparkSession
    ruled = spark.createDataFrame([], "law string, rule string") if rules is None else rules.select("law", "rule")
    ruled = ruled.unionByName(spark.createDataFrame([(x, "drop") for x in drop_laws or []], "law string, rule string"))
    laws = lambda rule: ruled.filter(F.col("rule") == rule).select("law").distinct()
    replacements = replacements.join(laws("keep"), "law", "left_anti")
    gone = replacements.select("law").union(laws("drop")).distinct()
    blocks = laws("drop-pageblock").withColumn("_blocks", F.lit(True))
    kept = base.join(gone, "law", "left_anti").join(blocks, "law", "left").filter(F.col("_blocks").isNull() | (F.coalesce(label_count(F.col("text")), F.lit(0)) <= 1))
    best = replacements.groupBy("law").agg(F.min("priority").alias("priority"))
    new = numbered(replacements.join(best, ["law", "priority"]), "law", "ord", "_n")
    last = base.agg(F.coalesce(F.max("row_idx"), F.lit(0)).alias("_last"))
    new = new.crossJoin(F.broadcast(last))  # one row
    new = new.select((F.col("_last") + F.col("_n")).alias("row_idx"), (F.lit(id_base) + F.col("_n")).cast("long").alias("id"), "law", "num", "text")
    return kept.select("row_idx", "id", "law", "num", "text").unionByName(new)


def label_count(text: Column) -> Column:
    """Article labels in a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(LABEL[1:]))


def row_id_map(rows: DataFrame) -> DataFrame:
    """old_id, new_ids of rows (id, origin_row_ids)."""
    return rows.select("id", F.explode("origin_row_ids").alias("old_id")).groupBy("old_id").agg(F.array_sort(F.collect_set("id")).alias("new_ids"))


def agreement(left: DataFrame, right: DataFrame, norm=lambda c: T.squeeze(T.nfkc(c))) -> DataFrame:
    """doc, rate, same, common: equal texts on shared numbers of (doc, ord, num, text); the last of a repeated number counts."""
    last = lambda d, n: d.groupBy("doc", "num").agg(F.max(F.struct("ord", "text"))["text"].alias(n))
    both = last(left, "x").join(last(right, "y"), ["doc", "num"])
    d = both.groupBy("doc").agg(F.count_if(norm(F.col("x")) == norm(F.col("y"))).alias("same"), F.count("*").alias("common"))
    return d.select("doc", F.round(F.col("same") / F.col("common"), 6).alias("rate"), "same", "common")


def version_gate(pairs: DataFrame) -> DataFrame:
    """doc, verdict of (doc, source_date, base_date, source_chars, base_chars), dates in ISO form: older is rejected, a
    scale outside 0.7 to 1.4 is rejected, an equal date is taken, a newer one taken as bumped."""
    scale = F.col("source_chars") / F.greatest("base_chars", F.lit(1))
    verdict = F.when(F.col("source_date") < F.col("base_date"), "older").when((scale < 0.7) | (scale > 1.4), "scale").when(F.col("source_date") == F.col("base_date"), "same").otherwise("bumped")
    return pairs.select("doc", verdict.alias("verdict"))
