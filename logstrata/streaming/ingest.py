"""Continuous ingestion into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logstrata.sources.parse import parse_lines
from logstrata.sources.tail import LogTail
from logstrata.store import LogStore


def file_lines(spark: SparkSession, directory: str, max_files: int | None = None) -> DataFrame:
    """(value): lines of the text files that appear in a directory."""
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(directory)


def tail_lines(spark: SparkSession, path: str, starting: str = "latest") -> DataFrame:
    """(value): lines appended to one file."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("logtail").option("path", path).option("startingOffset", starting).load()


def mock_lines(spark: SparkSession, rate: int) -> DataFrame:
    """(value): `rate` invented lines a second."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return ticks.select(F.concat(F.lit("mock line "), F.col("value").cast("string")).alias("value"))


def ingest(lines: DataFrame, store: LogStore, service: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Parse a stream of (value) and write each micro-batch to the store, exactly once.

    A batch is named by the stream and its number; after a failure the checkpoint replays it and the store skips what it
    already has.
    """
    now = F.unix_millis(F.current_timestamp())

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_lines(batch, F.col("value"), now, F.lit(service))
        store.append_batch(parsed.select("t", "s", "l", "m"), f"{checkpoint}:{number}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
