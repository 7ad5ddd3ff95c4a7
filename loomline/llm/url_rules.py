"""URL filters by a bit-parallel wildcard automaton.

Every rule is a glob over the canonical bytes ``.host|path`` of a URL: rule (host,
path) is ``*.host|path*``. The separator and the wildcard are the bytes FF and FE,
which UTF-8 never uses, so that no host or path can hold either. All globs are packed
into one multiword Shift-And automaton: bit i is set when the pattern positions up to
i match the bytes read so far, a star keeps its bit set, and one shift, mask and carry
per byte advances every pattern for a whole batch of URLs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP, ANY = b"\xff", b"\xfe"


class GlobAutomaton:
    """Simulates all ``globs`` (literal bytes and the byte ``star``) at once over the bytes of texts."""

    def __init__(self, globs: Sequence[bytes], star: bytes = b"*"):
        chars: list[int] = []
        self.starts, self.ends, loops = [], [], []
        self.always: list[int] = []
        for k, g in enumerate(globs):
            body = g
            while star * 2 in body:
                body = body.replace(star * 2, star)
            if body in (b"", star):
                self.always += [k] if body else []
                self.starts.append(-1)
                self.ends.append(-1)
                continue
            floating, open_end = body.startswith(star), body.endswith(star)
            body = body.strip(star)
            self.starts.append((len(chars), floating))
            for i, c in enumerate(body):
                if c == star[0]:
                    loops.append(len(chars) - 1)
                else:
                    chars.append(c)
            self.ends.append((len(chars) - 1, open_end))
            if open_end:
                loops.append(len(chars) - 1)
        self.words = max(1, -(-len(chars) // 64))
        self.table = np.zeros((256, self.words), np.uint64)
        for i, c in enumerate(chars):
            self.table[c, i // 64] |= np.uint64(1 << (i % 64))
        live = [s for s in self.starts if s != -1]
        self.first = self._mask(s for s, _ in live)
        self.floating = self._mask(s for s, f in live if f)
        self.loop = self._mask(loops)
        # a shift must not carry one pattern's end into the next one's start
        self.inner = ~self.first

    def _mask(self, bits) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def run(self, texts: Sequence[bytes]) -> np.ndarray:
        """Final state words of each text."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(texts), np.uint8)
        state = np.zeros((len(texts), self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        active = len(texts)
        sizes = size[order]
        for i in range(int(sizes[0]) if len(texts) else 0):
            while active and sizes[active - 1] <= i:
                active -= 1
            rows = order[:active]
            d = state[rows]
            moved = d << one
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> top
            moved = (moved & self.inner) | (self.first if i == 0 else self.floating)
            state[rows] = (moved & self.table[data[begin[rows] + i]]) | (d & self.loop)
        return state

    def matches(self, state: np.ndarray, k: int) -> np.ndarray:
        """Whether glob ``k`` accepts, by final state."""
        if self.ends[k] == -1:
            return np.full(len(state), k in self.always)
        bit, _ = self.ends[k]
        return (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) != 0


def host_of(url: Column) -> Column:
    """Lower-cased text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: str, path: str) -> bytes:
    """The bytes that rules are matched with."""
    return b"." + host.encode("utf-8", "surrogatepass") + SEP + path.encode("utf-8", "surrogatepass")


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    url_col: str = "url",
    default: str = "allow",
    wildcards: bool = False,
    keep: Sequence[str] = ("page_id",),
) -> DataFrame:
    """``keep`` columns, host, path, rule (the longest fitting one, else null) and verdict.

    ``rules``: (verdict, host, path); a rule fits its host and all its subdomains
    if the URL's path starts with the rule's. Of two equally long rules the first
    in the list wins. A ``*`` in a rule stands for itself, or with ``wildcards`` for any
    characters, host and path being kept apart.

    Null URLs and those without ``://``: empty host and path, no rule, ``default``.
    Long URLs are read to their end. Repeated rows are judged each; an empty table
    gives no rows; columns not named in ``keep`` are dropped, so none can clash.
    """
    names = [h + p for _, h, p in rules]
    order = sorted(range(len(rules)), key=lambda k: (-len(names[k]), k))
    own = lambda h, p: canonical(h, p).replace(b"*", ANY) if wildcards else canonical(h, p)
    automaton = GlobAutomaton([ANY + own(h, p) + ANY for _, h, p in rules], ANY)

    def hit(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in parts:
            state = automaton.run([canonical(h, p) for h, p in zip(host, path, strict=True)])
            out = np.full(len(host), -1, np.int32)
            for k in reversed(order):
                out[automaton.matches(state, k)] = k
            yield pd.Series(out)

    hits = F.pandas_udf(hit, "int")
    pages = pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = pages.withColumn("hit", hits("host", "path"))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("hit"))
    if not rules:
        return found.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return found.select(
        *keep, "host", "path",
        F.when(F.col("hit") >= 0, pick(names)).alias("rule"),
        F.when(F.col("hit") >= 0, pick([v for v, _, _ in rules])).otherwise(F.lit(default)).alias("verdict"),
    )
