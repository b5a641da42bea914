"""Structured Streaming ingestion: new files to extractions, each text once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jurisgrid.sources.files import extract

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, delay: str = "7 days") -> DataFrame:
    """A stream of extractions; a text that comes again within ``delay`` of its first file is dropped.

    The state holds one hash for each text of the watermark's span, not the texts.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(path)
    out = extract(files.select("path", "length", "content")).withColumn("at", F.current_timestamp())
    keyed = out.withColumn("text_hash", F.sha2(F.coalesce("normalized_text", "filename"), 256))
    return keyed.withWatermark("at", delay).dropDuplicatesWithinWatermark(["text_hash"])


def stream_units(units: DataFrame, window: str = "1 day", delay: str = "3 days") -> DataFrame:
    """Units by feed and window of ``loaded_at``; late rows count until the watermark passes."""
    return units.withWatermark("loaded_at", delay).groupBy(F.window("loaded_at", window).alias("w"), "feed_code").agg(F.count(F.lit(1)).alias("units"))


def start(stream: DataFrame, out: str, checkpoint: str):  # noqa: ANN201
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
