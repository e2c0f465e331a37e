"""Incremental analysis: new files (or rows with a binary column) are decoded as they arrive.

The same kernels and expressions serve batch and stream.  Entry rows are stateless; votes are a running aggregate by
path, with a watermark on arrival so that state is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flatewise.functions import rules
from flatewise.operators import streams
from flatewise.sources import containers


def files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Stream of (path, content, arrived) of files that appear below a path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "content", F.col("modificationTime").alias("arrived"))


def stream_rows(arriving: DataFrame) -> DataFrame:
    """Decoded streams of arriving files: path, name, sizes, ending, rule hits, error."""
    found = containers.stream_rows(containers.scan_table(arriving))
    records = streams.decode(found.select("path", "name", "payload"))
    return records.select("path", "name", "compressed_bytes", "out_size", rules.ending().alias("ending"), F.transform(rules.signatures(), lambda h: h["rule"]).alias("rules"), "error")


def running_votes(entries: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Bytes by window, path and label of an entry stream (ts, path, label, size), late rows dropped after `delay`."""
    return entries.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "path", "label").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
