"""Matching of arriving records against a standing pool, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftlink.operators.blocking import aggregate_evidence, exploded_keys, ranked, route_scores


def start_matching(arriving: DataFrame, index: DataFrame, path: str, checkpoint: str, k: int = 30) -> StreamingQuery:
    """Writes the best ``k`` targets of each source for every arriving normalised S1 record under ``path``.

    ``index`` is a standing blocking index (of :func:`weftlink.operators.blocking.blocking_index`).
    Each micro-batch is joined with it once; a batch that is retried overwrites its own folder, so
    the output has every record once.
    """

    def match(batch: DataFrame, number: int) -> None:
        scores = route_scores(exploded_keys(batch), index)
        ranked(aggregate_evidence(scores), ["s1_id", "source"], "target_id", k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).start()
