"""Mixing sources to target weights over fixed-length blocks, in DataFrame functions only.

The words of each source form one stream (documents in a hashed order), cut into
blocks of ``block`` words. The mix is a row of slots, ``shard_slots`` to an
output shard; each slot draws its source with replacement, so that the source
counts of a shard are multinomial. Draws beyond a source's quota of blocks pass
to sources below theirs. A source's r-th slot takes block ``p(r mod blocks)``, p
being its own pseudorandom permutation of block indices, and blocks join
documents by index.

Whatever grows with the corpus is split by hash: running sums go over chunks of
about 1,024 rows, groups of 1,024 chunks and then groups, so that a hot source
is never sorted by one task. Only the list of sources meets in one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import staged, unsent

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space after it, the first one also with that before it.
PIECE = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
CHUNK = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) -> also idx, weight and target: ``share`` of all words by weight, at most ``most`` times its words.

    Weights repeat over the sources in code point order, null last. The excess of
    capped sources is shared by weight: with sources in the order of cap / weight,
    the level is that of the first source that stays below its cap.
    """
    everything = Window.partitionBy(F.lit(0))
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    behind = everything.orderBy("_ratio", "idx").rowsBetween(Window.unboundedPreceding, -1)
    d = sizes.withColumn("idx", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    d = d.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("idx") % len(weights)).cast("double"))
    d = d.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    d = d.withColumn("_left", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(behind), F.lit(0.0)))
    d = d.withColumn("_level", F.col("_left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(behind), F.lit(0.0))))
    d = d.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "idx", "_level"))).over(whole)["_level"])
    target = F.when(F.col("_level").isNull() | (F.col("_ratio") <= F.col("_level")), F.col("_cap")).otherwise(F.col("_level") * F.col("weight"))
    return d.select("idx", "source", "source_size", "weight", target.alias("target"))


def permuted(x: Column, n: Column, key: Column, rounds: int = 12) -> Column:
    """Swap-or-not permutation of 0..n-1: in each round x and k-x change places when a hash of the larger one says so."""

    def step(acc: Column, i: Column) -> Column:
        other = F.pmod(F.xxhash64(key, i, n) - acc, n)
        return F.when(F.xxhash64(key, i, F.greatest(acc, other)) % 2 == 0, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, step)


def located(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, width: int = 4096) -> DataFrame:
    """Points joined with the span [lo, hi) that holds them, by an equi-join on cells of ``width``."""
    cells = spans.filter(F.col(hi) > F.col(lo)).withColumn(
        "_cell", F.explode(F.sequence((F.col(lo) / width).cast("long"), ((F.col(hi) - 1) / width).cast("long")))
    )
    inside = (F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))
    return points.withColumn("_cell", (F.col(at) / width).cast("long")).join(cells, "_cell").filter(inside).drop("_cell")


def running(df: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its ``key`` that lie before ``at`` (whole numbers), ``CHUNK`` of them to a group, then over groups."""
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_group", (F.col(at) / CHUNK).cast("long"))
    groups = df.groupBy(key, "_group").agg(F.sum(value).alias("_sum"))
    groups = groups.withColumn("_ahead", F.sum("_sum").over(before(key).orderBy("_group")) - F.col("_sum")).drop("_sum")
    inside = df.withColumn("_behind", F.sum(value).over(before(key, "_group").orderBy(at)) - F.col(value))
    return inside.join(groups, [key, "_group"]).withColumn(name, F.col("_ahead") + F.col("_behind")).drop("_group", "_ahead", "_behind")


@dataclass
class Mix:
    """sources: idx, source, source_size, weight, target, blocks, quota; docs: doc_id, idx, chunk, pos, size, start;
    slots: shard, slot, idx, block (which block of which source each slot of the mix holds)."""

    sources: DataFrame
    docs: DataFrame
    slots: DataFrame
    block: int

    def _held(self) -> DataFrame:
        """``docs`` with a row per block that a document has words in, block, and times, how often the mix takes it (null: never)."""
        n = self.block
        picks = self.slots.groupBy("idx", "block").agg(F.count("*").alias("times"))
        spread = F.when(F.col("size") > 0, F.sequence((F.col("start") / n).cast("long"), ((F.col("start") + F.col("size") - 1) / n).cast("long")))
        return self.docs.withColumn("block", F.explode_outer(spread)).join(unsent(picks), ["idx", "block"], "left")

    def taken(self) -> DataFrame:
        """doc_id, size, source, source_size, target, taken: a row per document."""
        n = self.block
        shared = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * n) - F.greatest(F.col("start"), F.col("block") * n)
        held = self._held().withColumn("_words", F.coalesce(shared * F.col("times"), F.lit(0)).cast("long"))
        done = held.groupBy("doc_id", "idx", "chunk", "pos", "size").agg(F.sum("_words").alias("taken"))
        return done.join(self.sources.select("idx", "source", "source_size", "target"), "idx").select(
            "doc_id", "size", "source", "source_size", "target", "taken"
        )

    def texts(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The words of the mix: the columns of ``docs``, and first (word), words, round.

        A row per run of consecutive blocks that one round of the mix takes from a
        document: a document taken whole is one row with its text as it is, and any
        other row is the run's words with the white space between and after them. Ids
        of ``docs``, those that were mixed, are unique and not null; columns of theirs
        called like the three new ones are left out.
        """
        n = self.block
        rounds = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
        blocks = self._held().filter("times > 0").select("doc_id", "size", "start", "block", rounds.alias("round"))
        whole = blocks.groupBy("doc_id", "size", "start", "round").agg(F.sort_array(F.collect_list("block")).alias("b"))  # no more than a document's blocks
        begins = F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda i: (i == 0) | (F.get("b", i) - F.get("b", F.greatest(i - 1, F.lit(0))) > 1))
        run = whole.withColumn("_begins", begins).select("doc_id", "size", "start", "round", "b", "_begins", F.posexplode("_begins").alias("_k", "_i"))
        last = F.get("b", F.coalesce(F.get("_begins", F.col("_k") + 1), F.size("b")) - 1)
        first = F.greatest(F.get("b", F.col("_i")) * n - F.col("start"), F.lit(0))
        run = run.withColumn("first", first).withColumn("words", F.least((last + 1) * n - F.col("start"), F.col("size")) - F.col("first"))
        run = run.select(F.col("doc_id").alias("_mix_id"), F.col("size").alias("_mix_size"), "round", "first", "words")
        joined = docs.drop("round", "first", "words").join(unsent(run), F.col(id_col) == F.col("_mix_id"))
        part = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(PIECE), F.lit(0)), (F.col("first") + 1).cast("int"), F.col("words").cast("int")), "")
        return joined.withColumn(text_col, F.when(F.col("words") < F.col("_mix_size"), part).otherwise(F.col(text_col))).drop("_mix_id", "_mix_size")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 64,
    shard_slots: int = 1024,
    seed: int = 20260918,
) -> Mix:
    """Plans a mix of ``share`` times all words, no document taken more than ``most`` (at most 2) times.

    A source's words in the mix differ from its target by about a block. The same
    rows give the same mix. Null and empty texts have size 0 and are never taken;
    a null source is a source, last in order. Repeated rows are taken each; very
    long texts span many blocks; an empty table gives no rows. Only id, text and
    source are read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = staged(own, "mix-sizes")
    chunks = max(1, -(-sizes.count() // CHUNK))
    totals = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    n_blocks = F.ceil(F.col("source_size") / block)
    fill = F.col("source_size") / n_blocks
    quota = F.when(F.col("source_size") > 0, F.least(F.floor(F.lit(most) * n_blocks), F.round(F.col("target") / fill))).otherwise(0)
    sources = staged(totals.withColumn("blocks", n_blocks.cast("long")).withColumn("quota", quota.cast("long")), "mix-sources")

    # where each document begins in its source's stream
    keyed = sizes.join(sources.select("idx", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source")))
    keyed = keyed.select("doc_id", "idx", "size", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(chunks)).alias("chunk"))
    in_chunk = Window.partitionBy("idx", "chunk").orderBy("doc_id", "size")
    keyed = keyed.withColumn("pos", F.row_number().over(in_chunk))
    keyed = keyed.withColumn("_upto", F.sum("size").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = sizes.join(sources.select("idx", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source")))
    sums = sums.groupBy("idx", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(chunks)).alias("chunk")).agg(F.sum("size").alias("_n"))
    begins = running(sums, "idx", "chunk", "_n", "_begin").drop("_n")
    placed = keyed.join(begins, ["idx", "chunk"]).withColumn("start", F.col("_begin") + F.col("_upto"))
    placed = staged(placed.select("doc_id", "idx", "chunk", "pos", "size", "start"), "mix-docs")

    # slots draw sources; a quota is a span of the number line
    line = Window.partitionBy(F.lit(0)).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    spans = sources.withColumn("_hi", F.sum("quota").over(line)).withColumn("_lo", F.col("_hi") - F.col("quota"))
    slots = sources.agg(F.sum("quota")).first()[0] or 0
    drawn = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, slots))).alias("_u"))
    drawn = located(drawn, "_u", spans.select("idx", "_lo", "_hi"), "_lo", "_hi").withColumn("shard", (F.col("slot") / shard_slots).cast("long"))
    cell = Window.partitionBy("shard", "idx")
    drawn = drawn.select("shard", "slot", "idx", F.row_number().over(cell.orderBy("slot")).alias("_nth"))
    drawn = staged(drawn, "mix-draws")
    counts = drawn.groupBy("shard", "idx").agg(F.count("*").alias("_c"))  # the multinomial counts
    before = running(counts, "idx", "shard", "_c", "_prior")
    got = counts.groupBy("idx").agg(F.sum("_c").alias("_got"))
    state = spans.join(got, "idx", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).select("idx", "quota", "blocks", "_got")
    over, under = F.greatest(F.col("_got") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("_got"), F.lit(0))
    state = state.withColumn("_over", F.sum(over).over(line) - over).withColumn("_uhi", F.sum(under).over(line)).withColumn("_ulo", F.col("_uhi") - under)
    state = staged(state, "mix-state")
    ranked = drawn.join(before.drop("_c"), ["shard", "idx"]).withColumn("_rank", F.col("_prior") + F.col("_nth") - 1)
    ranked = ranked.join(state.select("idx", "quota", "_over"), "idx")
    kept = ranked.filter(F.col("_rank") < F.col("quota")).select("shard", "slot", "idx", "_rank")
    moved = ranked.filter(F.col("_rank") >= F.col("quota")).select("shard", "slot", (F.col("_over") + F.col("_rank") - F.col("quota")).alias("_at"))
    moved = located(moved, "_at", state.select("idx", "_ulo", "_uhi", "_got"), "_ulo", "_uhi")
    moved = moved.select("shard", "slot", "idx", (F.col("_got") + F.col("_at") - F.col("_ulo")).alias("_rank"))
    filled = kept.unionByName(moved).join(state.select("idx", "blocks"), "idx")
    number = permuted(F.col("_rank") % F.col("blocks"), F.col("blocks"), F.xxhash64("idx", F.lit(seed)))
    # written, as a plan of all its shuffles is told to the driver anew after each of them
    slots = staged(filled.select("shard", "slot", "idx", number.alias("block")), "mix-slots")
    return Mix(sources, placed, slots, block)
