"""A synthetic corpus of marked demonstration articles, generated by row number, and its check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# The mark of every article and the words that its sentence is made of.
MARK = "本条为程序生成的合成演示条文，非真实法律文本。"
LAWS = ["合成示例法", "演示管理条例", "样例实施办法", "虚拟规程", "测试细则"]
SCENES = ["演示活动期间", "样例试点区域内", "虚拟项目实施中", "测试批次运转时", "示例年度内"]
SUBJECTS = ["演示机关", "样例机构", "虚拟单位", "测试主体", "示例组织", "模型当事人"]
DUTIES = ["按期申报演示事项", "保存样例台账", "报送虚拟数据", "公示测试结果", "登记示例信息"]
TOPICS = ["蓝箱管理", "绿码申报", "数据留痕", "凭证核验", "台账公示", "区域协作", "时段管控", "名录更新"]


def synthetic_corpus(spark: SparkSession, articles: int = 100, seed: int = 20260928) -> DataFrame:
    """row_idx, id, law, num, text, synthetic: words drawn by hashes of seed and row number; laws take turns, and each text has a code of its own."""
    n = F.col("id")

    def drawn(words: list[str], what: str) -> Column:
        return F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(n, F.lit(seed), F.lit(what)), F.lit(len(words))).cast("int"))

    fine = (F.pmod(F.xxhash64(n, F.lit(seed), F.lit("fine")), F.lit(90)) + 5) * 100
    sentence = F.concat(
        F.lit(MARK), drawn(SCENES, "scene"), F.lit("，"), drawn(SUBJECTS, "subject"), F.lit("应当"), drawn(DUTIES, "duty"), F.lit("，并确保"), drawn(TOPICS, "topic"),
        F.lit("全过程可回溯。违反规定的，并处"), fine.cast("string"), F.lit("元以上罚款。本条事项代号SY"), F.lpad((n + 1).cast("string"), 4, "0"), F.lit("。"),
    )
    law = F.get(F.array(*map(F.lit, LAWS)), (n % len(LAWS)).cast("int"))
    num = F.concat(F.lit("第"), T.chinese_numeral(F.floor(n / len(LAWS)) + 1), F.lit("条"))
    return spark.range(articles).select(n.alias("row_idx"), (n + 1).alias("id"), law.alias("law"), num.alias("num"), sentence.alias("text"), F.lit(True).alias("synthetic"))


def faults(corpus: DataFrame, gold: DataFrame) -> DataFrame:
    """fault, n of a demonstration corpus and its gold (qid, query, gold_id); no rows: both are sound."""
    named = corpus.select("id", T.squeeze(F.col("text")).alias("_text"))
    found = gold.join(named, F.col("gold_id") == F.col("id"), "left")
    tests = [
        ("repeated id", corpus.groupBy("id").count().filter("count > 1")),
        ("not marked", corpus.filter(~F.col("synthetic") | ~F.contains("text", F.lit(MARK)))),
        ("empty field", corpus.filter((F.coalesce("law", F.lit("")) == "") | (F.coalesce("num", F.lit("")) == "") | (T.squeeze(F.coalesce("text", F.lit(""))) == ""))),
        ("gold without article", found.filter("id is null")),
        ("query not in its article", found.filter(F.col("id").isNotNull() & ~F.contains("_text", T.squeeze(F.col("query"))))),
    ]
    out = None
    for name, rows in tests:
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n")
        out = part if out is None else out.unionByName(part)
    return out.filter("n > 0")
