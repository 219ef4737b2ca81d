"""Micro-batch normalisation and blocking: new records become key rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import records
from lodestone.operators import blocking
from lodestone.sources.readers import SOURCE


def read(spark: SparkSession, path: str, schema: str = SOURCE) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def normalize(stream: DataFrame) -> DataFrame:
    """Stateless, so it runs on streams as on tables."""
    return records.normalized(stream)


def append_keys(stream: DataFrame, index: str, checkpoint: str, config: blocking.BlockingConfig = blocking.BlockingConfig()) -> StreamingQuery:
    """Appends each batch's normalised records to ``index``/entities and their key rows to ``index``/keys.

    A batch that is run again replaces itself.  Keys are made from the written records: one rule program at a
    time keeps plans small.
    """

    def write(batch: DataFrame, number: int) -> None:
        entities = f"{index}/entities/batch={number}"
        normalize(batch).write.mode("overwrite").parquet(entities)
        rows = blocking.key_rows(batch.sparkSession.read.parquet(entities), config)
        rows.write.mode("overwrite").parquet(f"{index}/keys/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
