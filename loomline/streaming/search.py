"""Micro-batch search: a stream of queries against a static corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.retrieval import Hybrid


def search_stream(queries: DataFrame, hybrid: Hybrid, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 5):
    """Starts a stream that searches every batch of ``queries`` (qid, query) and hands the citations to ``sink(df, batch id)``.

    A batch is run again after a failure, so ``sink`` must overwrite what the same
    batch id has written.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(hybrid.search(batch.dropDuplicates(["qid"]), k), batch_id)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
