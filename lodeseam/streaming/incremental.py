"""Incremental maintenance of postings and a change feed over a stream of card files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import changes, retrieval
from ..schema import CARD_SCHEMA, as_cards
from ..sources import sinks


def latest(cards: DataFrame, batch: DataFrame) -> DataFrame:
    """cards with the rows of batch in place of those of the same id; a card without a role is a removal."""
    best = Window.partitionBy("id").orderBy(F.desc("card_order"))
    new = as_cards(batch).withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
    return cards.join(new, "id", "left_anti").unionByName(new.where("role IS NOT NULL"))


def apply_batch(spark: SparkSession, root: str, batch: DataFrame) -> DataFrame:
    """Brings the snapshot under root up to date with a batch and commits a new one; returns the change feed.

    Only new and changed cards are tokenized. A batch applied twice changes nothing the second time, so a restarted
    stream may repeat its last batch.
    """
    if os.path.exists(os.path.join(root, sinks.POINTER)):
        old = sinks.open_snapshot(spark, root)
    else:
        none = spark.createDataFrame([], CARD_SCHEMA)
        old = {"cards": none, "postings": retrieval.postings(none), "hashes": retrieval.document_hashes(none)}
    cards = latest(old["cards"], batch)
    postings, hashes = retrieval.maintain_postings(old["postings"], old["hashes"], cards)
    feed = changes.compare_cards(old["cards"], cards)
    sinks.commit_snapshot(root, {"cards": cards, "postings": postings, "hashes": hashes, "changes": feed})
    return sinks.open_snapshot(spark, root)["changes"]


def maintain(spark: SparkSession, source: str, root: str, checkpoint: str):
    """Starts a query that reads the Parquet files of cards that arrive in source, once and for all that are there."""
    stream = spark.readStream.schema(CARD_SCHEMA).parquet(source)

    def step(batch: DataFrame, epoch: int) -> None:
        apply_batch(batch.sparkSession, root, batch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums of a stream of events(ts, event_type, value) by hour, late rows up to the watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
