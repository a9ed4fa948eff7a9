"""The same operators on streams: all are row-local, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.attachments import extract_attachments
from ..operators.html_body import extract_bodies


def message_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of messages in a folder, with the schema of those there."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def write_bodies(messages: DataFrame, to: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes message_id, extracted_text and extracted_html of a stream of messages."""
    out = extract_bodies(messages).select("message_id", "extracted_text", "extracted_html")
    writer = out.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_attachments(attachments: DataFrame, to: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = extract_attachments(attachments).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
