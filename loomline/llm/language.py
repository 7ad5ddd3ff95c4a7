"""Language identification by language-bitmask n-gram filters.

For every language the ``grams`` most widespread letter n-grams (3 and 4 letters,
word ends marked) of a bounded sample of its texts go into a Bloom filter. The
filters are bit-sliced: slot i holds bit i of all languages' filters as one
bitmask, so that the AND of an n-gram's slots is the mask of all languages that
contain it. A text's n-grams are looked up together; per-language counts of mask
bits, corrected for each filter's rate of false positives, decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import slices, small_batches, staged
from ._words import mix

#: Expected texts of a language that are learned from, n-grams of each filter, slots and hashes of the filters.
SAMPLE_PER_LANGUAGE, GRAMS, SLOTS, HASHES = 2_000, 16_384, 1 << 18, 4
STEP = 1 << 17
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every n-gram of lower-cased letters, words bounded by blanks."""
    raw = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") if t else b"" for t in texts]
    code = np.frombuffer(b"".join(raw), np.uint32)
    doc = np.repeat(np.arange(len(raw)), [len(r) // 4 for r in raw])
    letter = _letters()[code]
    # one blank for each run of other characters
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:] & ~keep[:-1]
    code, letter, doc = np.where(letter, code, 32)[keep].astype(np.uint64), letter[keep], doc[keep]
    twin = np.zeros(len(code), bool)
    twin[1:] = ~letter[1:] & ~letter[:-1] & (doc[1:] == doc[:-1])
    code, letter, doc = code[~twin], letter[~twin], doc[~twin]
    found = []
    for n in (3, 4):
        if len(code) < n:
            continue
        m = len(code) - n + 1
        inner = letter[1 : 1 + m].copy()  # a blank only at either end
        for i in range(2, n - 1):
            inner &= letter[i : i + m]
        inner &= doc[:m] == doc[n - 1 :]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h << np.uint64(16)) ^ (h >> np.uint64(43)) ^ code[at + i]
        found.append((mix(h), doc[at]))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found])


def parts_of(texts: list) -> list[tuple[int, int]]:
    return list(slices([len(t) if t else 0 for t in texts], STEP))


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # SLOTS x mask words
    rate: np.ndarray  # of false positives, by language

    def counts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each text, corrected hits of each text and language)."""
        n_lang = len(self.languages)
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), n_lang))
        slots = np.uint64(len(self.table) - 1)
        for lo, hi in parts_of(texts):
            h, doc = gram_hashes(texts[lo:hi])
            if not len(h):
                continue
            mask = self.table[(h & slots).astype(np.int64)]
            for k in range(1, HASHES):
                mask = mask & self.table[((h >> np.uint64(15 * k)) * np.uint64(2 * k + 1) & slots).astype(np.int64)]
            total[lo:hi] = np.bincount(doc, minlength=hi - lo)
            for j in range(n_lang):
                bit = (mask[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
                hits[lo:hi, j] = np.bincount(doc, weights=bit, minlength=hi - lo)
        expected = total[:, None] * self.rate
        return total, np.maximum(hits - expected, 0) / np.maximum(1 - self.rate, 1e-9)


def build(grams: dict[str, np.ndarray], slots: int = SLOTS) -> Filters:
    languages = sorted(grams)
    table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    rate = np.zeros(len(languages))
    for j, lang in enumerate(languages):
        h, used = grams[lang], np.zeros(slots, bool)
        used[(h & np.uint64(slots - 1)).astype(np.int64)] = True
        for k in range(1, HASHES):
            used[((h >> np.uint64(15 * k)) * np.uint64(2 * k + 1) & np.uint64(slots - 1)).astype(np.int64)] = True
        table[used, j // 64] |= np.uint64(1 << (j % 64))
        rate[j] = (used.sum() / slots) ** HASHES
    return Filters(languages, table, rate)


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
    grams: int = GRAMS,
) -> Filters:
    """Filters from the texts of ``docs`` with a language; ``per_language`` of each, drawn by a hash of the id, are expected to be read."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    counts = own.groupBy("lang").agg(F.count("*").alias("n"))
    rates = staged(counts.select("lang", (F.lit(float(per_language)) / F.col("n")).alias("rate")), "lang-rates")
    drawn = own.join(rates, "lang").filter((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)) < F.col("rate"))

    def count(parts):
        for pdf in parts:
            for lang, texts in pdf.groupby("lang")["text"]:
                texts = texts.tolist()
                for lo, hi in parts_of(texts):
                    h, doc = gram_hashes(texts[lo:hi])
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    first = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.empty(0, bool)
                    gram, n = np.unique(h[first], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n})

    seen = drawn.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    seen = staged(seen, "lang-grams")
    out = {}
    for (lang,) in rates.select("lang").orderBy("lang").collect():  # as many rows as there are languages
        top = seen.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(grams).toPandas()
        out[lang] = top["gram"].to_numpy(np.int64).view(np.uint64)
    return build({k: v for k, v in out.items() if len(v)})


def predict(docs: DataFrame, filters: Filters, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages (how many filters hold at least half the n-grams of the best).

    The language of most corrected hits wins, ties going to the first by code; the
    score is its share of the text's n-grams. ``und`` with score 0 for null texts
    and those without a letter. Long texts are read whole, one after another.
    Repeated rows are judged alike; an empty table gives no rows; with nothing
    learned every text is ``und``. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(filters)

    def run(parts):
        f = shared.value
        for pdf in parts:
            texts = pdf["text"].tolist()
            total, hits = f.counts(texts)
            if not f.languages:
                hits = np.zeros((len(texts), 1))
            best = hits.argmax(1)
            top = hits[np.arange(len(texts)), best]
            lettered = np.array([bool(t) and (n > 0 or any(map(str.isalpha, t))) for t, n in zip(texts, total, strict=True)], bool) & bool(f.languages)
            name = [f.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            near = (hits >= np.maximum(top, 1e-9)[:, None] / 2).sum(1)
            yield pd.DataFrame({"doc_id": pdf["id"], "lang_pred": name, "score": np.where(lettered, np.minimum(top / np.maximum(total, 1), 1), 0.0), "languages": np.where(lettered, near, 0).astype(np.int32)})

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInPandas(run, "doc_id long, lang_pred string, score double, languages int")
