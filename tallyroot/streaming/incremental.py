"""Structured Streaming: windowed counts with late rows, and an index kept up to date from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyroot.functions.text import content_hash
from tallyroot.operators.retrieval import postings


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total): tumbling windows; rows later than the watermark are ignored in a stream."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def _merge(folder: str, key: str, text: str):
    def run(batch: DataFrame, number: int) -> None:
        """Appends the batch's versions and postings under its number; a replayed batch writes the same folder again."""
        rows = batch.withColumn("hash", content_hash(F.col(text))).dropDuplicates([key, "hash"])
        rows.select(F.col(key).alias("doc"), "hash", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{folder}/versions/n={number}")
        postings(rows, key, text).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/postings/n={number}")

    return run


def keep_index(docs: DataFrame, folder: str, key: str, text: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream that adds documents to the index in `folder`; re-delivered batches change nothing."""
    return docs.writeStream.foreachBatch(_merge(folder, key, text)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(postings, terms) of the newest version of each document."""
    versions = spark.read.parquet(f"{folder}/versions")
    newest = versions.groupBy("doc").agg(F.max("batch").alias("batch"))
    live = spark.read.parquet(f"{folder}/postings").join(newest, ["doc", "batch"], "left_semi").select("doc", "term", "tf", "dl")
    return live, live.groupBy("term").agg(F.count("*").alias("df"))


def index_totals(spark: SparkSession, folder: str) -> tuple[int, float]:
    """The number of documents with a token in the index as it stands, and their average length: what a rebuild would give."""
    live = read_index(spark, folder)[0].groupBy("doc").agg(F.max("dl").alias("dl"))
    n, avg = live.agg(F.count("*"), F.avg("dl")).first()
    return n, avg or 0.0
