"""One commit for each micro-batch of a stream.

A batch that is run again after a failure stages the same records over the same head, so it either finds nothing to
commit or finds its number in the state and is passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import algebra


def commit_batches(repo, branch: str, column: str, stream: DataFrame, checkpoint: str, order: str = "order", query_id: str = "stream", **trigger) -> StreamingQuery:
    """``stream`` has sample_key, subsample_key, kind, dtype, shape, data, text and an order column: of a key the last row of a batch counts."""

    def land(batch: DataFrame, number: int) -> None:
        done = repo.store.state().get("streams", {})
        if done.get(query_id, -1) >= number or batch.isEmpty():
            return
        co = repo.checkout(write=True, branch=branch)
        try:
            rows = algebra.last_write(batch.select("sample_key", "subsample_key", "kind", "dtype", "shape", "data", "text", F.col(order).alias("_order")), ["sample_key", "subsample_key"], ["_order"]).drop("_order")
            co.column(column).update_dataframe(rows)
            if co.diff.status() == "DIRTY":
                co.commit(f"{query_id} batch {number}")
            repo.store.set_state(streams=done | {query_id: number})
        finally:
            co.close()

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
