import re

import numpy as np
import pytest

from loomline.llm._tokens import WordTokens, segments
from loomline.llm._words import Words

TEXTS = ["", None, "a b", " \n ", "  A\tb c\n\n d E f ", "x" * 50, "one two three four five six", "É é\x1cq 日本", "one two three four five six"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles_of(text, n=5):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []


def test_words_and_shingles_equal_regular_expressions():
    w = Words(TEXTS)
    assert w.count.tolist() == [len(words_of(t)) for t in TEXTS]
    h, doc = w.shingles(5)
    expected = [(i, s) for i, t in enumerate(TEXTS) for s in shingles_of(t)]
    assert doc.tolist() == [i for i, _ in expected]
    seen = {}
    for (_, s), x in zip(expected, h.tolist(), strict=True):
        assert seen.setdefault(s, x) == x
    assert len(set(seen.values())) == len(seen)


def test_no_texts():
    assert len(Words([]).hashes()) == 0
    assert len(Words([None, ""]).shingles(5)[0]) == 0


def test_word_tokens_equal_the_tokenizer():
    tokenizers = pytest.importorskip("public_tokenizers")
    t = WordTokens(tokenizers.path("word_bpe_49k.json"), words=1 << 17)
    texts = [*TEXTS, "It's DON'T we'll, É. é.. ’., x2. ×. ñ, ¡hola! İ ΣΑΣ é. <|endoftext|> ﬁ ½ 2½.", ". , .. a.b. ...", "日本語。 abc def　", "🙂, ok🙂."]
    for _ in range(2):  # the second time from the memo
        ids, sizes = t.texts(texts)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == t.whole.encode(text or "", add_special_tokens=False).ids


def test_segments_keep_words():
    text = "aa bb " * 100 + "z" * 70 + " end"
    assert " ".join(segments(text, 50)).split() == text.split()
