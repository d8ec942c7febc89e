"""First-stage search over a stream of queries: each micro-batch is searched against the static corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rankmill.operators import bm25


def search_stream(queries: DataFrame, corpus: DataFrame, index: bm25.Bm25, path: str, checkpoint: str, k: int = 20) -> StreamingQuery:
    """Write the top ``k`` of each arriving query (query_id, query_norm) to ``path``.

    A batch goes to a folder of its own that a repeated batch overwrites, so that results are exactly once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        bm25.search(corpus, rows, index, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
