"""Tables and folders as rows of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))


def documents(spark: SparkSession, sf_dir: str, extension: str = "txt") -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(f".{extension}")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every file under a folder, on any file system; the id is a hash of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "modificationTime", "length", "content")
