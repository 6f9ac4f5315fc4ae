"""Incremental landing of new files, each application exactly once."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from lendlens.sources.ledger import land_batch


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """Id that a stream keeps as long as its checkpoint is kept."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def ingest_new(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema,
    key: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    format: str = "csv",
    options: dict | None = None,
    order: Sequence[Column] = (),
) -> None:
    """Land every file not seen before, each application once, then stop; read with ``ledger.landed``.

    The stream's checkpoint remembers files. A micro-batch lands under the stream's id and its own number, so one
    that is replayed after a crash replaces what it had half written, or does nothing if it counted
    already. Applications that came in an earlier batch, whichever the stream, are left out by the id ledger.
    """
    reader = spark.readStream.format(format).schema(schema).options(**(options or {"header": "true"}))
    stream = transform(reader.load(source))

    def land(batch: DataFrame, epoch: int) -> None:
        batch.persist()  # read for its prefixes, its repeated keys and its rows
        land_batch(batch, target, key, f"{stream_id(batch.sparkSession, checkpoint)}-{epoch}", order)
        batch.unpersist()

    query = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
