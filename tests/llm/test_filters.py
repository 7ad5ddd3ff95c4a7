import numpy as np
import pytest

from loomline.llm import language, lm_score, toxicity, url_rules
from loomline.llm.toxicity import BlockMaxIndex

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [
    None, "", "no scheme", "http://a.net", "http://a.net/", "http://A.Example.NET/en/x", "http://example.net/enx", "https://xnet/", "ftp://u:p@b.example.com:80/de/?q#f",
    "https://example.com/de/", "http://x.org?a/fr/", "http://x.org/fr/" + "y" * 5000, "http://x.org/fr", "a://b://c.net/en/", "http://é.net/ü", "http://x.example.com/de/\n", "http://a.net/",
    "http://a.com/x.net\x1f/y", "http://a.net\x1f/y", "http://a.com/.net\x1f/", "http://a\x1f/.org\x1f/fr/", "http://*.org/fr/*", "http://a.com/.org\xff/fr/", "http://a.net\x00/en/",
]
_RNG = np.random.default_rng(7)
URLS += ["".join(_RNG.choice(["http", "://", "a.", "net", "example.", "com", "org", "/", "en/", "de/", "fr/", "?", "#", "\x1f", ".", "*", "N", "é"], _RNG.integers(3, 14))) for _ in range(600)]


def plain_rule(host, path):
    best = None
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return best


def test_urls_equal_plain_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    for r in url_rules.judge(df, RULES).collect():
        url = URLS[r.page_id] or ""
        _, mark, rest = url.partition("://")
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))] if mark else ""
        path = rest[len(host) :].split("?")[0].split("#")[0] if mark else ""
        found = plain_rule("".join(c.lower() if "A" <= c <= "Z" else c for c in host), path)
        assert (r.host, r.path) == ("".join(c.lower() if "A" <= c <= "Z" else c for c in host), path)
        assert (r.verdict, r.rule) == (found or ("allow", None)), url
    assert url_rules.judge(df.limit(0), RULES).collect() == []
    assert {r.verdict for r in url_rules.judge(df, []).collect()} == {"allow"}
    stars = spark.createDataFrame([(1, "http://a.org/x*y"), (2, "http://a.org/xzy"), (3, "http://a.b/q.org/xzy")], "page_id long, url string")
    rules = [("block", "org", "/x*y")]
    assert [r.verdict for r in url_rules.judge(stars, rules).orderBy("page_id").collect()] == ["block", "allow", "allow"]
    assert [r.verdict for r in url_rules.judge(stars, rules, wildcards=True).orderBy("page_id").collect()] == ["block", "block", "allow"]


def test_automaton_equals_wildcards():
    import fnmatch

    rng = np.random.default_rng(0)
    globs = ["".join(rng.choice(list("ab*"), rng.integers(1, 9))) for _ in range(60)]
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 10))) for _ in range(200)]
    a = url_rules.GlobAutomaton([g.encode() for g in globs])
    assert a.words > 1
    state = a.run([t.encode() for t in texts])
    for k, g in enumerate(globs):
        got = a.matches(state, k)
        # a pattern without an open end must end with the text, which the final state shows
        assert [bool(x) for x in got] == [fnmatch.fnmatchcase(t, g) for t in texts], g


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    for weights in (lambda n: rng.random(n), lambda n: np.ones(n)):  # of equal weights many products tie
        vectors = []
        for _ in range(700):
            t = np.sort(rng.choice(60, rng.integers(1, 6), replace=False))
            w = weights(len(t))
            vectors.append((t, w / np.linalg.norm(w)))
        dense = np.zeros((700, 60))
        for i, (t, w) in enumerate(vectors):
            dense[i, t] = w
        index = BlockMaxIndex(vectors, 60)
        for i in range(0, 700, 7):
            number, s = index.search(*vectors[i], 10, skip=i)
            truth = np.round(dense @ dense[i], 12)
            truth[i] = 0
            best = [j for j in sorted(range(700), key=lambda j: (-truth[j], j))[:10] if truth[j] > 0]
            assert number.tolist() == best and np.allclose(s, truth[best])
    assert len(BlockMaxIndex([], 5).search(np.array([1]), np.ones(1), 3)[0]) == 0


def _labelled(spark, n=400):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice([f"w{k}" for k in range(200)], 40))
        if i % 5 == 0:
            words[3], words[9] = "nasty,", str(rng.choice(["Awful", "vile."]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 5 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_scores_whole_texts(spark):
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels.filter("doc_id < 300"))
    extra = spark.createDataFrame([(900, None, "x"), (901, "", "x"), (902, "w1 " * 300_000 + "nasty vile", "x"), (902, "w1", "x")], docs.schema)
    got = [(r.doc_id, r.predicted, r.score, len(r.evidence)) for r in toxicity.score(docs.filter("doc_id >= 300").union(extra), model).collect()]
    for i, p, s, n in got:
        assert 0 <= s <= 1
        if i < 900:
            assert p == (i % 5 == 0) and n == 10
    assert sorted((i, p) for i, p, _, _ in got if i >= 900) == [(900, 0), (901, 0), (902, 0), (902, 1)]
    none = toxicity.fit(docs.limit(0), labels)
    assert none is None and {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_uses_terms_of_small_lift(spark):
    rng = np.random.default_rng(11)
    docs = [(i, " ".join([*rng.choice([f"w{k}" for k in range(200)], 20), *["harsh"] * int(rng.random() < (0.6 if i % 5 == 0 else 0.06))]), "x") for i in range(500)]
    df = spark.createDataFrame([*docs, (900, "quite harsh", "x")], "doc_id long, text string, score string")
    model = toxicity.fit(df, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int"))
    assert toxicity.score(df.filter("doc_id = 900"), model).first().evidence


def test_toxicity_equals_plain_votes(spark):
    """Weights, neighbours, votes and calibration against dictionaries of whole words."""
    import math

    docs, labels = _labelled(spark, 150)
    model = toxicity.fit(docs, labels.filter("doc_id < 100"), neighbours=5)
    rows = {r.doc_id: r.text for r in docs.collect()}

    def terms(text):
        words = [w.rstrip(".,;:!?\"')") or w for w in text.lower().split()]
        return [*words, *(f"{n}{w[:n]}" for w in words for n in (4, 5) if len(w) > n)]

    bags = {i: {t: terms(x).count(t) for t in set(terms(x))} for i, x in rows.items()}
    known = {t for i in range(100) for t in bags[i]}
    positive = {i for i in range(100) if i % 5 == 0}

    def factor(t):
        df = sum(t in b for b in bags.values())
        n, pos = sum(t in bags[i] for i in range(100)), sum(t in bags[i] for i in positive)
        ratio = 0
        for seen, share, everyone in ((pos, n, 20), (n - pos, n, 80), (20 - pos, 100 - n, 20), (80 - n + pos, 100 - n, 80)):
            ratio += 2 * seen * math.log(seen / (share * everyone / 100)) if seen else 0
        return (math.log(151 / (1 + df)) + 1) * (0.02 + math.sqrt(max(0, ratio) / 100))

    factors = {t: factor(t) for t in known}
    vector = {i: {t: (1 + math.log(n)) * factors[t] for t, n in b.items() if t in known} for i, b in bags.items()}
    cosine = lambda a, b: sum(w * b[t] for t, w in a.items() if t in b) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    def vote(i):
        near = sorted(((cosine(vector[i], vector[j]), j) for j in range(100) if j != i), reverse=True)[:5]
        w = [c / max(1 - c, 0.05) for c, _ in near]
        return (sum(x for x, (_, j) in zip(w, near, strict=True) if j in positive) + 0.05 * 0.2) / (sum(w) + 0.05), [j for _, j in near]

    raw = {i: vote(i) for i in range(150)}
    pools = [[raw[i][0], float(i in positive), 1] for i in sorted(range(100), key=lambda i: raw[i][0])]
    while any(a[1] / a[2] >= b[1] / b[2] or abs(a[0] - b[0]) < 1e-12 for a, b in zip(pools, pools[1:], strict=False)):
        k = next(k for k, (a, b) in enumerate(zip(pools, pools[1:], strict=False)) if a[1] / a[2] >= b[1] / b[2] or abs(a[0] - b[0]) < 1e-12)
        pools[k : k + 2] = [[pools[k][0], pools[k][1] + pools[k + 1][1], pools[k][2] + pools[k + 1][2]]]
    for r in toxicity.score(docs.filter("doc_id >= 100"), model).collect():
        expected, near = raw[r.doc_id]
        assert r.evidence == near
        pool = max((k for k, p in enumerate(pools) if p[0] <= expected + 1e-9), default=0)
        value = max((y + 0.5) / (n + 1) for _, y, n in pools[: pool + 1])
        assert abs(r.score - value) < 1e-9 and r.predicted == (value >= 0.7)


def test_language(spark):
    rng = np.random.default_rng(3)
    kinds = {"aa": ["the", "thing", "wash", "ouch"], "bb": ["el", "niño", "qué", "ll"], "cc": ["der", "über", "schön", "ei"]}
    rows = [(i, " ".join(rng.choice(kinds[k], 20)), k, 1) for i, k in enumerate(list(kinds) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    filters = language.fit(df.filter("doc_id < 60"))
    odd = spark.createDataFrame([(900, None, None, 1), (901, "12 34 !", None, 1), (902, "Über " * 200_000, None, 1), (903, "日本語", None, 1), (904, "", "aa", 1)], df.schema)
    got = {r.doc_id: r for r in language.predict(df.filter("doc_id >= 60").union(odd), filters).collect()}
    assert all(got[i].lang_pred == k and 0 < got[i].score <= 1 for i, _, k, _ in rows if i >= 60)
    assert [got[i].lang_pred for i in (900, 901, 902, 904)] == ["und", "und", "cc", "und"]
    assert got[903].lang_pred in kinds and got[903].score == 0
    assert language.predict(df.limit(0), filters).collect() == []
    empty = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.predict(df, empty).collect()} == {"und"}


def test_language_equals_plain_sets(spark):
    """Predictions and scores against sets of n-grams, a tie going to the first language."""
    import re
    from collections import Counter

    rng = np.random.default_rng(5)
    words = {k: ["".join(rng.choice(list(letters), rng.integers(1, 8))) for _ in range(30)] for k, letters in (("bb", "abcdeé"), ("aa", "abcxyz"), ("cc", "xyzüöd"))}
    rows = [(i, " ".join(rng.choice(words[k], 12)) + ", 7!", k) for i, k in enumerate(list(words) * 20)]
    mixed = [(100 + i, " ".join([*rng.choice(words["aa"], 6), *rng.choice(words["bb"], 5)]), None) for i in range(20)] + [(200, "7 ab", None), (201, "ßßß ßß", None)]

    def grams(text):
        found = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            found.update(f" {w} "[i : i + n] for n in (3, 4) for i in range(len(w) + 3 - n))
        return found

    known = {k: set().union(*(grams(t) for i, t, x in rows if x == k and i < 50)) for k in words}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.fit(df.filter("doc_id < 50"))
    assert filters.languages == ["aa", "bb", "cc"]
    for r in language.predict(spark.createDataFrame([*rows, *mixed], df.schema), filters).collect():
        own = grams({i: t for i, t, _ in [*rows, *mixed]}[r.doc_id])
        hits = {k: sum(n for g, n in own.items() if g in known[k]) for k in words}
        best = max(sorted(hits), key=hits.get)
        assert r.lang_pred == best and abs(r.score - hits[best] / own.total()) < 1e-4, (r, hits)


def test_filter_rates_are_those_of_strangers():
    rng = np.random.default_rng(4)
    f = language.build({"a": rng.integers(0, 2**64, 5000, dtype=np.uint64), "b": rng.integers(0, 2**64, 20_000, dtype=np.uint64)}, 1 << 16)
    h = rng.integers(0, 2**64, 100_000, dtype=np.uint64)
    mask = np.full((len(h), 1), ~np.uint64(0))
    for k in range(language.HASHES):
        slot = h if k == 0 else (h >> np.uint64(15 * k)) * np.uint64(2 * k + 1)
        mask &= f.table[(slot & np.uint64((1 << 16) - 1)).astype(np.int64)]
    for j in range(2):
        assert abs(((mask[:, 0] >> np.uint64(j)) & np.uint64(1)).mean() - f.rate[j]) < 0.01


def test_lm_prefers_its_target(spark):
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(rng.choice(["good", "fine", "calm"] if i % 2 else ["bad", "junk", "spam"], 30)), "x") for i in range(60)]
    df = spark.createDataFrame([*docs, (900, None, "x"), (901, " ", "x"), (902, "good " * 300_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lm_score.score(df, labels).collect()}
    assert max(got[i].score for i in range(1, 60, 2)) < min(got[i].score for i in range(0, 60, 2))
    assert (got[900].n_tokens, got[900].score, got[901].score) == (0, None, None)
    assert got[902].n_tokens == 300_000
    assert lm_score.score(df.limit(0), labels).collect() == []
    assert {r.score for r in lm_score.score(df, labels.limit(0)).collect()} == {0.0, None}


@pytest.mark.parametrize("batch", [1 << 20, 300])
def test_lm_equals_plain_counts(spark, monkeypatch, batch):
    """All words and bigrams count, a document's own are left out, and background counts are scaled to the target's size."""
    import math
    from collections import Counter

    monkeypatch.setattr(lm_score, "TOKENS", batch)
    monkeypatch.setattr(lm_score, "FEATURES", batch)
    rng = np.random.default_rng(12)
    docs = [(i, " ".join(f"r{i}x{k} is v{rng.integers(50)}" for k in range(40)), "x") for i in range(60)]
    df = spark.createDataFrame([*docs, (None, docs[3][1], "x"), (7, docs[7][1], "x"), (70, "is", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (2, 0)], "doc_id long, quality int")
    other = spark.createDataFrame([(900, "r1x1 is unheard of r2x5 r3x7", "x"), (901, None, "x")], df.schema)
    rows = [(r.doc_id, r.text.split(), r.doc_id is not None and r.doc_id < 40 and r.doc_id % 2 == 1) for r in df.collect()]
    words = len({w for _, t, _ in rows for w in t})

    def loss(text, train, size):
        uni, bi = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(t, t[1:], strict=False))
        first = Counter(w for t in train for w in t[:-1])
        scale = size / max(1, sum(uni.values()))
        total = 0.0
        for k, w in enumerate(text):
            p = (uni[w] * scale + 0.1) / (sum(uni.values()) * scale + 0.1 * (words + 1))
            if k:
                p = (bi[text[k - 1], w] * scale + 4 * p) / (first[text[k - 1]] * scale + 4)
            total -= math.log2(p)
        return total / len(text)

    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lm_score.score(df, labels).collect()), key=str)
    true = []
    for k, (i, t, _) in enumerate(rows):
        rest = [x for j, x in enumerate(rows) if j != k]
        good = [x for _, x, mark in rest if mark]
        size = sum(map(len, good))
        a, b = loss(t, good, size), loss(t, [x for _, x, _ in rest], size)
        true.append((i, len(t), a, b, a - b))
    for g, e in zip(got, sorted(true, key=str), strict=True):
        assert g[:2] == e[:2] and np.allclose(g[2:], e[2:], atol=1e-6), (g, e)
    found = {r.doc_id: r for r in lm_score.score(df, labels, others=other).collect()}
    good = [t for _, t, mark in rows if mark]
    size = sum(map(len, good))
    text = "r1x1 is unheard of r2x5 r3x7".split()
    assert set(found) == {900, 901} and found[901].score is None
    assert abs(found[900].target_loss - loss(text, good, size)) < 1e-6
    assert abs(found[900].background_loss - loss(text, [t for _, t, _ in rows], size)) < 1e-6


def test_lm_packing_round_trip():
    rng = np.random.default_rng(0)
    for kind in (np.uint8, np.uint32, np.int64, np.uint64):
        for n in (0, 1, 1000):
            x = rng.integers(0, np.iinfo(kind).max, n, dtype=kind)
            assert (lm_score.unpacked(lm_score.packed(x), kind) == x).all()
            x.sort()
            assert (lm_score.unpacked(lm_score.packed(x, True), kind, True) == x).all()
