"""Every stage of the pipeline against plain Python, with null ids and repeated rows."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P

from .llm.test_duplicates import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t)) for k, (i, t) in enumerate(rows)], SCHEMA).coalesce(1)


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    """Every tenth row without an id; some words go with the label."""
    rng = np.random.default_rng(21)
    out = []
    for i in range(400):
        words = list(rng.choice([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)], 40))
        if i % 5 == 0:
            words[3], words[9] = "nasty,", "vile."
        out.append((None if i % 10 in (3, 5) else i, " ".join(words)))
    return out


def test_language_drops_rows_without_letters(spark, rows):
    odd = [(None, "12 34 !"), (None, "56 78 !"), (900, "9 9"), (None, "")]
    assert kept(P.identify_language(spark, documents(spark, rows + odd), "")) == Counter(rows)


def test_toxicity_drops_toxic_rows_without_ids(spark, rows, tmp_path):
    spark.createDataFrame([(i, int("nasty" in t)) for i, t in rows if i is not None], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = kept(P.drop_toxic(spark, documents(spark, rows), str(tmp_path)))
    assert got == Counter(r for r in rows if "nasty" not in r[1])


def test_near_duplicates_keep_different_rows_without_ids(spark, rows):
    copies = [(None, rows[3][1]), (None, rows[7][1]), (7, rows[7][1]), (950, rows[8][1]), (None, "one of a kind, without an id")]
    every = rows + copies
    numbered = [(i if i is not None else 10_000 + k, t) for k, (i, t) in enumerate(every)]
    first = {}
    for (d, _, low), (i, t) in zip(brute(numbered), every, strict=True):
        if d == low:
            first[d] = (i, t)
    assert kept(P.drop_near_duplicates(spark, documents(spark, every), "")) == Counter(first.values())


def test_mixing_takes_rows_without_ids(spark, rows):
    docs = documents(spark, rows)
    got, want = P.mix_sources(spark, docs, ""), P.mix_sources(spark, P._keyed(docs).select(P.COLUMNS), "")
    assert Counter(r.text for r in got.collect()) == Counter(r.text for r in want.collect())
    assert set(kept(got)) <= set(rows)
    assert sum(i is None for i, _ in kept(got)) > 20


def test_packing_holds_rows_without_ids(spark, rows):
    numbered = [(i if i is not None else 10_000 + k, t) for k, (i, t) in enumerate(rows)]
    got, want = P.pack_tokens(spark, documents(spark, rows), ""), P.pack_tokens(spark, documents(spark, numbered), "")
    assert got.count() == want.count()
    assert got.filter("doc_id is null").count() == want.filter("doc_id >= 10000").count() > 0
