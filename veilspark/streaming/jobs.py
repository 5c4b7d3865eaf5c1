"""Redaction as a stream; the run history is in ``history``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.redact import redact, with_outcome


def redact_stream(docs: DataFrame, **options) -> DataFrame:
    """The row-local redaction plan on a streaming table of documents (no state)."""
    return redact(docs, **options)


def outcome_stream(docs: DataFrame, path: str, checkpoint: str, **options):
    """A writer of two sinks, ``path``/outcome=accepted and ``path``/outcome=rejected, fed by one pass.

    The sink's log names the files of each batch id once, so a batch that is replayed after a failure adds nothing.
    """
    return with_outcome(docs, **options).writeStream.partitionBy("outcome").format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
