"""Reading the mail tables, and files as attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def deliveries(spark: SparkSession, directory: str) -> DataFrame:
    """Messages, a repeated delivery once: any row of an id, as its deliveries carry the same bodies.

    This moves the bodies; a query over results had better drop repeats there.
    """
    return table(spark, directory, "messages").dropDuplicates(["message_id"])


def attachment_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files of a folder as attachments: attachment_id (hash of the path), content, filename, content_type (unknown), path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select(F.xxhash64("path").alias("attachment_id"), "content", F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(None).cast("string").alias("content_type"), "path", F.col("length").alias("n_bytes"))
