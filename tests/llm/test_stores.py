import base64
import hashlib
import zlib

import numpy as np
import pytest

from loomline.llm import media, mixing, packing, warc
from loomline.llm._store import workspace

DOCS = [(1, "one two three", "b"), (2, None, "a"), (3, "", "a"), (4, "x " * 40_000, "a"), (5, "one two three", None), (5, "one two three", None), (6, "é" * 100, "B"), (7, " \n", "b")]


def docs(spark):
    return spark.createDataFrame([(*r, "clash") for r in DOCS], "doc_id long, text string, source string, size string")


def test_png_round_trip():
    for data in (b"", b"a", bytes(range(256)) * 9, "é日本".encode() * 100):
        payload = media.padded(data)
        png = media.encode(payload)
        assert media.decode(png) == payload and media.header(png[: media.HEADER_BYTES])[:2] == (64, len(payload) // 64)
    with pytest.raises(ValueError):
        media.decode(png[:-30] + b"\0" + png[-29:])


def test_media_columns(spark):
    got = media.media_columns(docs(spark)).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _, _ in DOCS)
    texts = {d: (t or "").encode() for d, t, _ in DOCS}
    for r in got:
        payload = media.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.size) == (len(media.encode(payload)), hashlib.sha256(media.encode(payload)).hexdigest(), r.media_bytes)
    assert media.media_columns(docs(spark).limit(0)).collect() == []


def test_headers_are_read_alone(spark):
    from pyspark.sql import functions as F

    uri = workspace(spark, "test-media")
    manifest = media.store(docs(spark), uri, id_col="doc_id", payload=F.encode("text", "utf-8")).cache()
    heights = {r.payload_sha256: r.height for r in media.read_headers(manifest, uri).collect()}
    assert {r.payload_sha256: r.payload_bytes // 64 for r in manifest.collect()} == heights


def test_media_payloads_are_shuffled_twice_and_joined_once(spark):
    found = media.media_columns(docs(spark))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and plan.count("MapInPandas") == 1
    assert found.columns == ["payload_sha256", "doc_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth", "shard", "at", "size"]


def test_warc_round_trip(spark):
    pages = [(3, "u", "x"), (1, None, "x"), (2, "u\n", None), (5, "v", ""), (None, "w", "x"), (9, "z", "y" * 3_000_000), (8, "é", "ü"), (1, "q", "x")]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, record_type string")
    got = sorted(warc.archive(df).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [
        (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (5, "revisit", 2), (8, "response", None), (9, "response", None), (None, "revisit", 1)
    ]
    html = {p: h for p, _, h in pages}
    assert all((r.payload_bytes, r.payload_digest) == (len((html[r.page_id] or "").encode()), sha(html[r.page_id])) for r in got)
    small = {r.page_id: r.record_type for r in warc.archive(df, min_bytes=2).collect()}
    assert set(small.values()) == {"response"}
    assert warc.archive(df.limit(0)).collect() == []


def test_seek_table_is_a_skippable_frame():
    import io

    import zstandard

    z = zstandard.ZstdCompressor()
    frames = [b"a" * 1000, b"b" * 500]
    packed = [z.compress(f) for f in frames]
    blob = b"".join(packed) + warc.seek_table([(len(p), len(f)) for p, f in zip(packed, frames, strict=True)])

    class Source(io.BytesIO):
        def size(self):
            return len(blob)

    table = warc.read_seek_table(Source(blob))
    assert [zstandard.ZstdDecompressor().decompress(blob[a : a + n], max_output_size=m) for a, n, m in table] == frames


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Caps and reshared excess, one round after another."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[n] for n in open_)
        over = {n for n in open_ if level * w[n] > most * sizes[n]}
        if not over:
            return out | {n: level * w[n] for n in open_}
        for n in over:
            out[n] = most * sizes[n]
            left -= out[n]
        open_ -= over
    return out


def test_mix(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), ["s1", "s2", "s3", None, "Z"][int(rng.integers(5)) if i % 3 else 0], "c") for i in range(900)]
    rows += [(900, None, "s1", "c"), (901, "w " * 30_000, "s2", "c"), (902, "w w", "tiny", "c"), (903, "w w", "s3", "c"), (903, "w w", "s3", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df).taken().collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    expected, taken = targets(sizes), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(128, 0.02 * t), (s, taken[s], t)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).taken().collect()), key=str)
    assert mixing.mix(df.limit(0)).taken().collect() == []


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 64 or got != list(range(n))


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(8)
    for _ in range(30):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 12, 14))])
        cost = rng.integers(0, 9, len(at))
        length = 20

        def total(path):
            inner = zip(path[:-1], path[1:], strict=True)
            return sum(length - (at[j] - at[i]) + cost[j] if j != len(at) - 1 else 0 for i, j in inner)

        best = {0: 0}
        for j in range(1, len(at)):
            last = j == len(at) - 1
            best[j] = min(best[i] + (0 if last else length - (at[j] - at[i]) + cost[j]) for i in range(j) if at[j] - at[i] <= length)
        path = packing.cuts(at, cost, length)
        assert path[0] == 0 and path[-1] == len(at) - 1 and total(path) == best[len(at) - 1]


def test_pack_is_an_exact_cover(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    many = [(100 + i, "This is a line. " * (i % 40 + 1), "s") for i in range(300)]
    rows = [*DOCS, *many, (999, "nostop " * 12_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    pieces = packing.pack(df, tokenizers.path("word_bpe_49k.json"), chunk_tokens=10_000).collect()
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for d, t, _ in rows}
    covered, sequences = {}, {}
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d, spans in covered.items():
        copies = sum(1 for r in rows if r[0] == d)
        assert sorted(i for s, n in spans for i in range(s, s + n)) == sorted(list(range(len(ids[d]))) * copies)
    padding = total = 0
    for spans in sequences.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 4096 - at)
    assert padding < 0.03 * total
    assert packing.pack(df.limit(0), tokenizers.path("word_bpe_49k.json")).collect() == []
