"""Incremental ingestion by Structured Streaming: micro-batches of documents into an engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.engine import Engine
from ..sources.store import Change, materialize


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, available_now: bool = True, name: str = "documents") -> StreamingQuery:
    """Insert a stream of (doc_id, content, seq) into an engine.

    Of all rows of one document that ever came, the last by seq counts (of equal ones the last content of
    a batch, the first batch's among batches): stream_progress(doc_id, seq) is published with each
    insert, and so is the number of the batch, so that one that runs again after its insert is passed
    over. Rows without a doc_id go.
    """
    mark = f"batch-of-{name}"

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if engine.store.state().get(mark, {}).get("mark", -1) >= number:
            return
        last = batch.where("doc_id is not null").groupBy("doc_id").agg(F.max("seq").alias("seq"), F.max_by("content", F.struct("seq", "content")).alias("content"))
        known = engine.store.read("stream_progress") if engine.store.has("stream_progress") else spark.createDataFrame([], "doc_id string, seq long")
        old = known.select(F.col("doc_id").alias("id"), F.col("seq").alias("before"))
        fresh = materialize(last.join(old, F.col("doc_id") == F.col("id"), "left").where("before is null or seq > before").select("doc_id", "content", "seq"))

        def also(change: Change) -> None:
            change.merge("stream_progress", fresh.select("doc_id", "seq"), "doc_id", fresh.select("doc_id"))
            change.mark(mark, number)

        engine.insert_documents(fresh.select("doc_id", "content"), also=also)

    writer = stream.select("doc_id", "content", "seq").writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
