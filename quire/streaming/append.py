"""A collection that grows with a stream: each micro-batch is analysed alone and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from quire.operators import merge
from quire.operators.index import Collection


def follow(stream: DataFrame, path: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Appends a stream of docs(docnum, text) to the saved collection under ``path``; options as in ``index.build``.

    A batch's files lie under its own number, and a repeated batch replaces them, so each document counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        merge.append_saved(path, batch, number=number, **options)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, path: str, **options: object) -> Collection:
    """The collection of all batches so far."""
    return Collection.open(spark, path, **options)
