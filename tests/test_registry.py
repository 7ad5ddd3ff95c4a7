"""Registered queries on small tables of their own."""

import hashlib

from loomline.operators import etl
from loomline.plans import registry


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder, texts):
    written(spark, folder, "documents", [(i, t, "en", f"src{i}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")


def test_gold_reads_whole_texts(spark, tmp_path):
    head = "甲乙丙丁戊己庚辛壬癸" * 20
    texts = [head + "子丑寅卯辰巳", head + "午未申酉戌亥", "天地玄黄宇宙", head + "天地玄黄宇宙"]
    documents(spark, tmp_path, texts)
    got = {r.gold_id: r.query for r in registry.QUERIES["g4_make_gold"](spark, str(tmp_path)).collect()}
    assert 2 not in got and {0, 1, 3} == set(got)  # the third text's only phrase is in the fourth, after 200 characters
    assert all(sum(q in t for t in texts) == 1 for q in got.values())


def test_lines_of_articles_are_whole(spark, tmp_path):
    texts = ["a line that is longer than eight characters\nsecond line of the same text, whole\nthird", "一" * 40]
    documents(spark, tmp_path, texts)
    lines = registry._labelled(spark, str(tmp_path)).collect()
    assert all(r.line.endswith(texts[r.doc].split("\n")[r.pos]) for r in lines)
    got = {(r.doc, r.pos): r.line_md5 for r in registry.QUERIES["c4_deinterleave"](spark, str(tmp_path)).collect()}
    want = etl.deinterleave(spark.createDataFrame([(r.doc, r.pos, r.line) for r in lines], "doc long, pos int, line string")).collect()
    assert got == {(r.doc, r.pos): hashlib.md5(r.line.encode()).hexdigest() for r in want}


def test_every_question_with_a_vector_has_the_pool(spark, tmp_path):
    documents(spark, tmp_path, ["text"] * 3)
    written(spark, tmp_path, "benchmark", [(i, f"question {i}") for i in range(1100)], "item_id long, text string")
    written(spark, tmp_path, "embeddings", [(i, [float(i), 1.0], 1) for i in range(1000)], "vec_id long, embedding array<float>, label int")
    pool = registry._pool(spark, str(tmp_path))
    assert pool.count() == 1000 * 50 and pool.select("qid").distinct().count() == 1000
