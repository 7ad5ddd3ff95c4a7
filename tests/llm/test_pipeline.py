"""Every stage of the pipeline against brute force, with rows of all kinds."""

import re
from collections import Counter

import numpy as np
import pytest

from loomline.llm import language, mixing, toxicity

from .test_duplicates import brute

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, component_id long, score string, size int, idx long, held_out boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 1, "x", 1, 7, None) for i, t, lang, s in rows], SCHEMA)


def kept(df):
    return Counter(map(tuple, df.collect()))


def plain(rows):
    return Counter((i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(21)
    words = {"en": ["the", "thing", "wash", "ouch", "other"], "es": ["el", "niño", "qué", "llano", "ojo"]}
    out = []
    for i in range(80):
        lang = ["en", "es"][i % 2]
        text = list(rng.choice(words[lang], 60))
        text = [f"{w}{rng.integers(30)}" if rng.random() < 0.5 else w for w in text]
        out.append((i, " ".join(text), lang, ["a", "b", None, "d"][i % 4]))
    base = out[4][1].split()
    out += [(100 + k, " ".join([*base[: 55 - k], f"own{k}"]), "en", "a") for k in range(6)]
    back = [" ".join(reversed(out[k][1].split())) for k in (6, 10, 14)]
    out += [(None, back[0], "en", "a"), (None, back[1], None, None), (None, back[2], "en", "z")]
    out += [(7, "a second text under one number that is not like it", "en", "b"), (7, "  and\na third,  with odd\twhite space " * 30 + "\n", "en", "b"), (8, out[8][1], "en", "a")]
    out += [(200, None, "en", "a"), (201, "", None, "a"), (202, " \n", "en", "q"), (203, "12 34 ... !", "en", "a"), (204, "the " * 40_000, "en", "d"), (205, "the thing", "en", None)]
    return out


def test_language_stage(spark, rows, tmp_path):
    df = frame(spark, rows)
    filters = language.fit(df.filter(pipeline.crc_mod("doc_id", 4) != 2))
    numbered = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "doc_id long, text string")
    judged = {rows[r.doc_id][1]: r for r in language.predict(numbered, filters).collect()}
    good = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1]) and judged[r[1]].lang_pred != "und" and judged[r[1]].score >= 0.5]
    assert len(good) < len(rows) and sum(r[0] is None for r in good) > 0
    assert kept(pipeline.identify_language(spark, df, str(tmp_path))) == plain(good)
    assert pipeline.identify_language(spark, df.limit(0), str(tmp_path)).collect() == []


def test_toxicity_stage(spark, rows, tmp_path):
    bad = [(300 + i, r[1].replace("the", "nasty,") + " vile", "en", "a") for i, r in enumerate(rows[:80:4])]
    everything = [*rows, *bad, (None, bad[0][1], None, None)]
    spark.createDataFrame([(i, int(i >= 300)) for i in [*range(80), *range(300, 320)]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = frame(spark, everything)
    got = pipeline.drop_toxic(spark, df, str(tmp_path))
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").filter(pipeline.crc_mod("doc_id", 3) != 1)
    model = toxicity.fit(df, labels)
    numbered = df.select("text").distinct().withColumn("doc_id", pipeline.F.xxhash64("text"))
    toxic = {r.text for r in toxicity.score(numbered, model).filter("predicted = 1").join(numbered, "doc_id").collect()}
    assert {b[1] for b in bad} == toxic
    assert kept(got) == plain(r for r in everything if r[1] not in toxic)
    assert pipeline.drop_toxic(spark, df.limit(0), str(tmp_path)).collect() == []


def test_near_duplicate_stage(spark, rows, tmp_path):
    numbered = [(k if r[0] is not None else 1000 + k, r[1]) for k, r in enumerate(rows)]
    group = {n: c for n, _, c in brute(numbered)}
    got = kept(pipeline.drop_near_duplicates(spark, frame(spark, rows), str(tmp_path)))
    members = {}
    for (n, _), r in zip(numbered, rows, strict=True):
        members.setdefault(group[n], []).append(r)
    assert sum(got.values()) == len(members) and not got - plain(rows)
    for same in members.values():  # one of each group, with the smallest id
        some = [r for r in same if plain([r]) & got]
        low = min((r[0] for r in same if r[0] is not None), default=None)
        assert any(r[0] == low for r in some)
    assert pipeline.drop_near_duplicates(spark, frame(spark, []), str(tmp_path)).collect() == []


def test_mixing_stage(spark, rows, tmp_path):
    df = frame(spark, rows)
    got = pipeline.mix_sources(spark, df, str(tmp_path)).collect()
    target = {r.source: r.target for r in mixing.mix(df).taken().collect()}
    words, own = Counter(), Counter()
    for r in got:
        assert r.n_chars == len(r.text)
        assert any(i == r.doc_id and s == r.source and lang == r.lang and r.text in (t or "") for i, t, lang, s in rows)
        words[r.source] += len(WORD.findall(r.text))
        own[r.doc_id, r.source] += len(WORD.findall(r.text))
    for s, t in target.items():
        assert abs(words[s] - t) <= 128
    for key, n in own.items():
        assert n <= 2 * sum(len(WORD.findall(t or "")) for i, t, _, s in rows if (i, s) == key)
    assert any(r.text == t for r in got for i, t, _, _ in rows if i == r.doc_id)
    assert pipeline.mix_sources(spark, df.limit(0), str(tmp_path)).collect() == []


def test_texts_of_a_mix_are_its_blocks(spark, rows):
    docs = [(k, t, s) for k, (_, t, _, s) in enumerate(rows)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix = mixing.mix(df, block=16)
    start = {r.doc_id: (r.idx, r.start, r.size) for r in mix.docs.collect()}
    times = Counter((r.idx, r.block) for r in mix.slots.collect())
    seen = Counter()
    for r in mix.texts(df).collect():
        text = WORD.findall(docs[r.doc_id][1])[r.first : r.first + r.words]
        assert WORD.findall(r.text) == text and r.text in docs[r.doc_id][1]
        seen.update((r.doc_id, i) for i in range(r.first, r.first + r.words))
    assert seen == Counter({(d, i): times[x, (a + i) // 16] for d, (x, a, n) in start.items() for i in range(n) if times[x, (a + i) // 16]})


def test_plan_of_a_mix_is_written_in_parts(spark, rows):
    """The driver plans the mix in parts, not as one plan of all its windows and shuffles."""
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, _, s) in enumerate(rows)], "doc_id long, text string, source string")
    mix = mixing.mix(docs, block=16)
    for df in (mix.docs, mix.slots, mix.texts(docs), mix.taken()):
        assert "Window" not in df._jdf.queryExecution().sparkPlan().toString()


def test_packing_stage(spark, rows, tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    got = pipeline.pack_tokens(spark, frame(spark, rows), str(tmp_path)).collect()
    sizes = Counter((i, len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _, _ in rows)
    packed = Counter()
    for r in got:
        packed[r.doc_id, r.doc_tokens] += r.length
    assert packed == Counter({key: key[1] * n for key, n in sizes.items()})


def test_run_is_the_stages_in_order(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = pipeline.table(spark, sf_dir, "documents").limit(60)
    for name, stage in pipeline.STAGES[:-1]:
        new = stage(spark, docs, sf_dir)
        assert new.columns == pipeline.COLUMNS, name
        docs = pipeline.staged(new, "test")
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
