import io
import json
import re
import sqlite3
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import audit, etl, gold
from loomline.sources import files, sinks


def lines(spark, *texts, doc=1):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc long, pos int, line string")


def test_import_classes(spark):
    rows = [("", "empty"), (None, "empty"), (" 　", "empty"), ("a(cid:12)", "cid"), ("x" * 29, "short"), ("x" * 30, "imported")]
    got = spark.createDataFrame(rows, "t string, want string").select(etl.import_status(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_splitting(spark):
    d = lines(spark, "目录", "第一章 总则", "第一条 甲", "续行", "第二条 乙", "一、小节", "第一条所称", "第三条 丙", "第三条之一 丁", "第二十条 戊")
    got = [(r.num, r.text) for r in etl.split_articles(d).orderBy("ord").collect()]
    assert got == [("第一条", "第一条 甲续行"), ("第二条", "第二条 乙第一条所称"), ("第三条", "第三条 丙"), ("第三条之一", "第三条之一 丁"), ("第二十条", "第二十条 戊")]


def test_fallbacks(spark):
    d = lines(spark, "一、甲", "二、乙", "尾").union(lines(spark, "1. 甲", "2．乙", "3. 丙", "一、丁", "二、戊", doc=2)).union(lines(spark, "无", "号", doc=3))
    got = {(r.doc, r.mode): [] for r in etl.best_effort_articles(d).collect()}
    for r in etl.best_effort_articles(d).orderBy("ord").collect():
        got[r.doc, r.mode].append(r.text)
    assert got == {(1, "list"): ["一、甲", "二、乙尾"], (2, "item"): ["1. 甲", "2．乙", "3. 丙"], (3, "whole"): ["无\n号"]}


def test_article_gate(spark):
    rows = [("第一条", "短", "short", False), ("第一条", "第二条 不是这一条。", "number", False), ("第一条", "第一条 a b c d e f g h i j k l。", "blanks", False),
            ("第一条", "第一条 没有句号", "end", False), ("第一条", "第一条 甲＝乙＋丙", "end", True), ("第一条", "第一条 正常的一条。", None, False)]
    got = etl.gated(spark.createDataFrame(rows, "num string, text string, want string, want_soft boolean")).collect()
    assert all((r.reason, r.soft, r.keep) == (r.want, r.want_soft, r.want is None or r.want_soft) for r in got)


def test_quality_and_gates(spark):
    good = lines(spark, "第一条 甲方应当履行。", "第二条 乙方应当履行。", "第二条之一 丙方应当履行。", "第三条 丁方应当履行。")
    gap = lines(spark, "第一条 甲方应当履行。", "第三条 乙方应当履行。", doc=2)
    d = good.union(gap)
    totals = d.groupBy("doc").agg(F.sum(F.length("line")).alias("chars"))
    q = etl.quality(etl.split_articles(d), totals).withColumn("ok", etl.document_gate()).withColumn("mirror", etl.document_gate(mirror=True))
    got = {r.doc: r for r in q.collect()}
    assert (got[1].kept, got[1].mono, got[1].complete, got[1].cov, got[1].ok, got[1].mirror) == (4, True, True, 1.0, True, True)
    assert (got[2].mono, got[2].complete, got[2].ok, got[2].mirror) == (True, False, True, False)


def test_pages_are_restored(spark):
    d = lines(spark, "第一条 甲", "第三条 丙", "第二条 乙", "第四条 丁", "公报", "2020", "第五条 戊", "第七条 庚", "第六条 己")
    got = [r.line[:3] for r in etl.deinterleave(d).orderBy("pos").collect()]
    assert got == ["第一条", "第二条", "第三条", "第四条", "第五条", "第六条", "第七条"]
    swapped = lines(spark, "第三条 丙", "第一条 甲", "第四条 丁", "第二条 乙")
    assert [r.line[:3] for r in etl.deinterleave(swapped).orderBy("pos").collect()] == ["第一条", "第二条", "第三条", "第四条"]


def test_html(spark):
    html = "<html><script>x<p>y</script><p>第</p><p>一</p><p>长段落&nbsp;文字</p><b>尾</b></html>"
    got = etl.html_paragraphs(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("pos").collect()
    assert [r.line for r in got] == ["第一", "长段落 文字", "尾"]


def test_html_lines_are_formed_once(spark, tmp_path):
    pages = ["<p>a\u2003</p>" * 3 + "<p>\u3000long line\r</p>", "", None, "<script></script>" + "<b>x</b>" * 5, "<script>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages")
    found = etl.html_paragraphs(spark.read.parquet(f"{tmp_path}/pages"))
    assert [(r.page_id, r.pos, r.line) for r in found.orderBy("page_id", "pos").collect()] == [(0, 0, "aaa"), (0, 1, "long line"), (3, 0, "xxxxx")]
    # a test of the array, formed again for each of its lines, was pushed to the scan
    assert found._jdf.queryExecution().optimizedPlan().toString().count("&nbsp;") == 1


def test_html_scripts_go_before_styles(spark):
    pages = ["<style>a<script>b</style>c</script>d", "<SCRIPT>a<style>b</Script>c</style>d", "<ſcript>a</script>b<ſtyle>c</STYLE>d"]
    got = etl.html_paragraphs(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.line) for r in got] == [(0, "a d"), (1, "cd"), (2, "b d")]


def test_merging_and_rebuilding(spark):
    schema = "row_idx long, id long, law string, num string, text string"
    base = spark.createDataFrame([(1, 1, "甲", "第一条", "x"), (2, 2, "乙", "第一条", "y")], schema)
    bad = spark.createDataFrame([(3, 2, "丙", "第一条", " "), (4, 5, "丙", "第一条", "(cid:1)"), (5, 5, "丁", "第一条", "z")], schema)
    assert dict(etl.merge_violations(base, bad).collect()) == {"id-exists": 1, "id-repeated": 1, "pair-repeated": 1, "empty-text": 1, "damaged-text": 1}
    with pytest.raises(ValueError):
        etl.merge(base, bad)
    assert etl.merge(base, bad.filter("law = '丁'")).count() == 3
    new = spark.createDataFrame([("乙", 1, "第一条", "new", 2), ("乙", 1, "第一条", "newer", 1), ("乙", 2, "第二条", "more", 1)], "law string, ord long, num string, text string, priority int")
    got = etl.rebuild(base, new).orderBy("row_idx").collect()
    assert [(r.id, r.law, r.text) for r in got] == [(1, "甲", "x"), (995001, "乙", "newer"), (995002, "乙", "more")]
    ids = spark.createDataFrame([(7, [1, 2]), (8, [2])], "id long, origin_row_ids array<long>")
    assert dict(etl.row_id_map(ids).collect()) == {1: [7], 2: [7, 8]}


def test_agreement_and_versions(spark):
    schema = "doc long, ord long, num string, text string"
    a = spark.createDataFrame([(1, 1, "一", "Ａ b"), (1, 2, "二", "x"), (1, 3, "二", "y")], schema)
    b = spark.createDataFrame([(1, 1, "一", "Ab"), (1, 2, "二", "x")], schema)
    assert tuple(etl.agreement(a, b).first()) == (1, 0.5, 1, 2)
    rows = [(1, "2019", "2020", 10, 10), (2, "2021", "2020", 10, 20), (3, "2020", "2020", 10, 10), (4, "2021", "2020", 10, 10)]
    d = spark.createDataFrame(rows, "doc long, source_date string, base_date string, source_chars long, base_chars long")
    assert dict(etl.version_gate(d).collect()) == {1: "older", 2: "scale", 3: "same", 4: "bumped"}


def test_flags_and_coverage(spark):
    narrow = "公 报 " + audit.FURNITURE + " 字 字 字"
    rows = [(1, "甲", "第一条", "x" * 9, None, None, None), (2, "甲", "第一条", "y" * 2001, None, None, None), (3, "乙", audit.WHOLE, "z" * 50, "flk", None, "第"), (4, "丙", "第一条", narrow, None, None, None), (970001, "丁", "第一条", "短 栏 文 字 共 不 少 于 十 个 字", None, None, None)]
    d = audit.row_flags(spark.createDataFrame(rows, "id long, law string, num string, text string, source string, unit string, num_origin string"))
    got = {r.id: (r.origin, r.flags) for r in d.collect()}
    assert got[1] == ("gazette", ["empty-or-tiny", "dup-law-num", "narrow-no-furniture"]) and got[2] == ("gazette", ["very-long", "dup-law-num"])
    assert got[3] == ("flk", ["whole-document", "num-mapped"]) and got[4] == ("gazette", ["polluted-interleave"]) and got[970001] == ("zhuma", [])
    catalog = spark.createDataFrame([(1, "中华人民共和国甲"), (2, "戊"), (3, "戊")], "ord int, title string")
    assert tuple(audit.coverage_rate(audit.coverage(catalog, d)).first()) == (2, 1, 0.5)


def test_texts_are_not_moved_for_their_flags(spark):
    schema = "id long, law string, num string, text string, source string, unit string, num_origin string"
    flagged = audit.audit(audit.row_flags(spark.createDataFrame([(1, "甲", "第一条", "x", None, None, None)], schema)), "law")
    above, mark, _ = flagged._jdf.queryExecution().optimizedPlan().toString().partition("Join LeftOuter")
    assert mark and "text#" not in above


def test_shapes_of_texts(monkeypatch):
    monkeypatch.setattr(audit, "PORTION", 40)
    texts = ["", " \u3000", "a" * 19, "a" * 20, " ".join(["a" * 19, "b" * 20]), "\u00a0".join(["a" * 19, "b" * 19, "c" * 20]), "😀" * 19 + "\x1c😀\u200b", "a\u1680" * 30, "b"]
    got = audit._shapes(pd.Series([t.encode() for t in texts]))
    sizes = [sorted(map(len, re.split(f"[{T.SPACE_CHARS}]+", t.strip(T.SPACE_CHARS)))) if t.strip(T.SPACE_CHARS) else [] for t in texts]
    assert got.solid.tolist() == [sum(x) for x in sizes]
    assert got.narrow.tolist() == [bool(x) and x[len(x) // 2] < audit.NARROW for x in sizes]


def test_gold(spark):
    rows = [(i, i, "法", f"第{i}条", t) for i, t in enumerate(["甲乙丙丁戊己庚", "甲乙丙丁戊己辛", "子丑寅卯辰巳午", "短"])]
    corpus = spark.createDataFrame(rows, "row_idx long, id long, law string, num string, text string")
    made = gold.make_gold(corpus, 10).collect()
    assert {r.gold_id for r in made} == {0, 1, 2} and len({r.qid for r in made}) == 3
    assert all(sum(r.query in t for *_, t in rows) == 1 for r in made)
    assert [r.gold_id for r in gold.make_gold(corpus, 2).orderBy("qid").collect()] == [r.gold_id for r in sorted(made, key=lambda r: r.qid)[:2]]
    specs = spark.createDataFrame([(1, ["没有", "丙丁"], "第1条"), (2, ["无"], None)], "qid long, anchors array<string>, prefer_num string")
    assert [(r.qid, r.gold_ids, r.evidence) for r in gold.anchored_gold(corpus, specs).collect()] == [(1, [1, 0], "丙丁")]
    bad = spark.createDataFrame([("a", [9], ["无 第一条"], None), ("b", [0], ["法 第9条"], "无此文"), ("c", [0], ["法 第0条"], "甲 乙")], "qid string, gold_ids array<long>, gold_laws array<string>, evidence string")
    assert {(r.qid, r.kind) for r in gold.check_gold(bad, corpus).collect()} == {("a", "missing-id"), ("a", "missing-law"), ("b", "missing-num"), ("b", "pair-mismatch"), ("b", "warn-evidence")}
    assert {r.qid: (r.gold_ids, r.verified) for r in gold.migrate(bad, corpus).collect()} == {"a": ([], False), "b": ([], False), "c": ([0], True)}
    items = spark.createDataFrame([(1, "《法》", "第０条", ["法 第2条", "无 第一条", "单"]), (2, "无", "第一条", [])], "qid long, expect_law string, expect_num string, expect_alts array<string>")
    got = {r.qid: (r.matched, r.gold_ids, r.unmapped_alts) for r in gold.map_external(items, corpus).collect()}
    assert got == {1: (True, [0, 2], ["无 第一条", "单"]), 2: (False, None, [])}


def test_readers(spark, tmp_path):
    xml = '<w:document xmlns:w="urn:w"><w:p><w:r><w:t>第一条</w:t><w:t xml:space="preserve"> 甲</w:t></w:r></w:p><w:p a="1"><w:t> </w:t></w:p></w:document>'
    with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", xml)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "甲(2020-01-01).docx").write_bytes(buffer.getvalue())
    (folder / "甲(2021-01-01).md").write_text("# 题\n**第一条**　乙\n> 注\n", encoding="utf-8")
    got = {r.line for r in files.paragraphs(spark, str(folder)).collect()}
    assert got == {"第一条 甲", "第一条 乙"}
    assert [(r.key, r.date) for r in files.directory_index(spark, str(folder)).collect()] == [("甲", "2021-01-01")]
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, x TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"x{i}") for i in range(1, 50)])
    assert files.sqlite(spark, str(tmp_path / "a.db"), "t", ["id", "x"], "id long, x string", "id").count() == 49
    (tmp_path / "s.jsonl").write_text('{"question": "q", "url": "u", "anchors": ["a"]}\n\n{"question": "r", "url": "u", "verified": false}\n')
    assert files.gold_specs(spark, str(tmp_path / "s.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"question": "q", "url": "u"}\n')
    with pytest.raises(ValueError):
        files.gold_specs(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "r.json").write_text(json.dumps({"_note": {"status": "x"}, "q1": {"status": "ok", "reviewer": "r"}}))
    assert [(r.qid, r.status) for r in files.review_status(spark, str(tmp_path / "r.json")).collect()] == [("q1", "ok")]
    assert files.review_status(spark, str(tmp_path / "none.json")).count() == 0
    report = sinks.markdown_table(spark.createDataFrame([(1, "a|b\nc")], "n long, t string"))
    assert report.splitlines()[-1] == "| 1 | a\\|b c |"


def test_stream_of_queries(spark, tmp_path):
    from loomline.operators.retrieval import Hybrid
    from loomline.streaming.search import search_stream

    corpus = spark.createDataFrame([(1, 1, "法", "一", "合同书面形式"), (2, 2, "法", "二", "工资支付")], "row_idx long, id long, law string, num string, text string")
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "a.json").write_text('{"qid": 1, "query": "书面"}\n{"qid": 2, "query": "工资"}\n')
    got = []
    stream = search_stream(spark.readStream.schema("qid long, query string").json(str(tmp_path / "q")), Hybrid(corpus), lambda df, i: got.extend((r.qid, r.id) for r in df.collect()), str(tmp_path / "c"))
    stream.processAllAvailable()
    stream.stop()
    assert sorted(got) == [(1, 1), (2, 2)]
