"""New regions against known ones, batch by batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from colinear.plans.jobs import pairwise_chains
from colinear.plans.options import ChainOptions


def chain_arrivals(arrivals: DataFrame, known: DataFrame, path: str, checkpoint: str, scores: DataFrame | None = None, options: ChainOptions = ChainOptions(), trigger: dict | None = None):
    """Starts a streaming query that chains each batch of regions (acr, pos, motif) with all known ones.

    A batch is written under its id, so that one that runs again after a failure replaces its own rows. A region's motifs must
    arrive in one batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        pairwise_chains(batch, known, scores, options).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return for_each_batch(arrivals, each, checkpoint, trigger)


def for_each_batch(arrivals: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
