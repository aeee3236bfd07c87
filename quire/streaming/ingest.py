"""Files as they arrive: the batch conversion on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quire import engine
from quire.sources.tables import FILES


def files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    rows = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return rows.withColumn("doc_id", F.xxhash64("path"))


def converted(spark: SparkSession, path: str, formats: list[str] | None = None) -> DataFrame:
    return engine.to_markdown(files(spark, path), path="path", formats=formats)


def counts_by_window(spark: SparkSession, path: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Files and bytes per extension and window of their modification time; later files are left out."""
    rows = files(spark, path).withWatermark("modificationTime", late)
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).alias("extension")
    return rows.groupBy(F.window("modificationTime", window), ext).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def to_parquet(stream: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Each file once, whatever fails in between; ends when all that is there is done."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
