"""A drop folder of markup files as a stream: each new file is parsed and its postings are appended, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import boxes as B
from pagelens.operators import index as I


def files(spark: SparkSession, folder: str, per_trigger: int | None = 1000) -> DataFrame:
    """(doc_id, markup): one row per file; the path names the document."""
    reader = spark.readStream.format("text").option("wholetext", "true")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("markup"))


def run_once(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Take in what is new and stop; each batch is an overwrite of its own folder, so a repeated batch writes nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        I.postings(B.boxes(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
