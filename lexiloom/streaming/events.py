"""The decision-event flow as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiloom.operators.events import consensus


def read_events(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def event_ingest_stream(events: DataFrame, out: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Append events once each: ids are kept as state for ``late`` after their event time.

    The time column may have no zone; it is then read in the session's zone.
    """
    unique = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def consensus_stream(votes: DataFrame, store: str, out: str, checkpoint: str) -> StreamingQuery:
    """Consensus refreshed as votes arrive, for the touched terms only.

    A micro-batch is written under its number, so a repeated batch replaces itself; the candidates of the terms in it are
    recomputed from all stored votes and appended with the batch number. The newest row of a term is its state.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        mine = spark.read.schema(batch.schema).parquet(f"{store}/batch={number}")
        touched = mine.select("original", "corrected").distinct()
        everything = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(store)
        found = consensus(everything.join(touched, ["original", "corrected"], "left_semi"))
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return votes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_candidates(spark: SparkSession, out: str) -> DataFrame:
    """The newest state of each term that the stream has written."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    newest = rows.groupBy("original", "corrected").agg(F.max_by(F.struct(*rows.columns), "batch").alias("r"))
    return newest.select("r.*").drop("batch")
