"""File stream to a cleaned table: each micro-batch lands in its own folder, so a repeated batch replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.values import normalise_code, tolerant_binary


def file_stream(spark: SparkSession, pattern: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over Parquet files that match a glob; the schema is read from the files themselves."""
    reader = spark.readStream.schema(spark.read.parquet(pattern).schema).format("parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(pattern)


def clean_stream(df: DataFrame, codes: list[str], flags: list[str]) -> DataFrame:
    """The same cleaning as the batch path: normalised codes and tolerant flags, row by row."""
    return df.withColumns({**{c: normalise_code(F.col(c)) for c in codes}, **{c: tolerant_binary(F.col(c)) for c in flags}})


def run_to_table(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now and stop. Restarting continues after the last finished batch."""

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = df.writeStream.outputMode(mode).foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
