"""Connected components by smallest labels, and a bounded membership filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import staged, unsent

#: Links that one task connects; more are connected by rounds of joins.
TASK_LINKS = 1 << 20


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each reaches) of the links a, b."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = x != y
        if not open_.any():
            return nodes, nodes[label]
        x, y = x[open_], y[open_]
        np.minimum.at(label, y, x)  # a root follows the smallest one that it is linked with
        while (label[label] != label).any():
            label = label[label]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node reachable.

    Up to ``TASK_LINKS`` links, 16 MB, are connected by one task, more by rounds of
    joins. A round costs the driver some ten shuffles and broadcasts, whatever it reads.
    """
    links = staged(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b"), "cc-links")
    if links.count() > TASK_LINKS:
        return _by_rounds(links)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in part.columns] for part in parts]
        if held:
            found = smallest(*map(np.concatenate, zip(*held, strict=True)))
            yield from pa.table(list(map(pa.array, found)), ["node", "component"]).to_batches(1 << 16)

    return staged(links.coalesce(1).mapInArrow(run, "node long, component long"), "cc-labels")


def _by_rounds(links: DataFrame) -> DataFrame:
    """``components`` of any number of links.

    Each round takes the smallest label among a node and its neighbours, then
    twice follows the label's own label. Labels are written after each round, which
    cuts the lineage; hubs are aggregated before they are shuffled, and joins on
    them are left to adaptive skew handling.
    """
    both = staged(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-both")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "cc-labels")
    while True:
        near = both.join(unsent(labels), both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        new = labels.join(unsent(near), "node").select("node", F.least("component", "_near").alias("component"), F.col("component").alias("_old"))
        for _ in range(2):
            jump = new.select(F.col("node").alias("component"), F.col("component").alias("_next"))
            new = new.join(unsent(jump), "component").select("node", F.least("component", "_next").alias("component"), "_old")
        new = staged(new, "cc-labels")
        labels = new.drop("_old")
        if new.filter("component <> _old").isEmpty():
            return labels


class IdFilter:
    """Bits of hashed ids: holds every id it was made of, and few others while it is not full.

    Sixteen bits an id, from ``LEAST`` to ``MOST`` bits: a table of at most MOST / 4096
    rows, each an array of ``SPAN`` words, which is broadcast. A row per word would cost
    the driver several times as much. Beyond some ``MOST`` / 4 ids it lets ever more
    pass, and what follows it is still exact.
    """

    LEAST, MOST, SPAN = 1 << 16, 1 << 26, 64

    def __init__(self, ids: DataFrame, column: str):
        count = ids.count()
        self.bits = self.LEAST
        while self.bits < min(16 * count, self.MOST):
            self.bits *= 2
        spot = self._spot(column)
        words = ids.filter(F.col(column).isNotNull()).groupBy((spot / 64).cast("long").alias("_word")).agg(F.bit_or(self._bit(spot)).alias("_bits"))
        words = words.groupBy((F.col("_word") / self.SPAN).cast("long").alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_word") % self.SPAN, "_bits"))).alias("_at"))
        row = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(self.SPAN - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("_at", i), F.lit(0).cast("long")))
        self.blocks = words.select("_block", row.alias("_words"))

    def _spot(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(self.bits))

    @staticmethod
    def _bit(spot: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))

    def mark(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with a boolean column: whether the id may be held. Null ids are not."""
        spot = self._spot(column)
        held = df.withColumn("_block", (spot / (64 * self.SPAN)).cast("long")).join(F.broadcast(self.blocks), "_block", "left")
        word = F.get("_words", ((spot / 64).cast("long") % self.SPAN).cast("int"))
        found = F.col(column).isNotNull() & (F.coalesce(word, F.lit(0)).bitwiseAND(self._bit(spot)) != 0)
        return held.withColumn(name, found).drop("_block", "_words")

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        return self.mark(df, column, "_held").filter("_held").drop("_held")
