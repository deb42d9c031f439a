"""Streams into namespaces, by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.sources.namespace import Engine


def ingest(engine: Engine, ns: str, stream: DataFrame, checkpoint: str, interval: str | None = "1 second") -> StreamingQuery:
    """Upsert every micro-batch of `stream` (with an `id` column) as one write.

    A micro-batch that is replayed after a failure is an upsert of the same rows
    once more, which leaves the documents as they are; its batch id also makes it a
    repeated request, which the namespace's state knows for a while, across drivers.
    `interval` None takes all there is and stops.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            engine.write(ns, upsert=rows, request_id=f"{checkpoint}#{number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def index_as_stream(engine: Engine, ns: str, checkpoint: str) -> StreamingQuery:
    """Fold what the log has gained since the last call into the base."""
    schema = "_seq long"
    log = engine.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(engine.path(ns, "log"))

    def batch(rows: DataFrame, number: int) -> None:
        engine.index(ns)

    return log.select("_seq").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
