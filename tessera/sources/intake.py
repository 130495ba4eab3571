"""Catalogue-driven feed intake (S10-S12, T15, N1-N3) with two sinks.

Feeds are landed as XML below ``category=<name>/feed=<slug>/``.  One pass over
the landed files gives every entry a reason or none: rows without one are the
accepted entries, the others go, with the reason, to the rejected side.  Both
come from one stored batch, so they always add up to what was read, and a feed
that is broken or unknown rejects its own rows only.

As a stream, each micro-batch is such a pass.  An entry whose key an earlier
batch has accepted is a duplicate; within a batch the first in the order of
catalogue and position wins (N2, N3).  A batch writes to folders of its own
number, so a batch that is run again after a failure replaces its output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import articles as A
from ..session import materialize
from . import feeds as FD

#: What is read of an RSS item; anything else in a file is left alone.
RSS_SCHEMA = (f"guid string, title string, link string, description string, pubDate string, updated string, "
              f"source string, {FD.CORRUPT} string, category string, feed string")
ACCEPTED = "category string, source string, title string, url string, summary string, published timestamp, article_key string, guid string"
REJECTED = "category string, feed string, guid string, title string, reason string"


def slug(source: Column) -> Column:
    """Folder name of a catalogue source."""
    return F.lower(F.regexp_replace(source, "[^A-Za-z0-9]+", "-"))


def known_feeds(catalogue: DataFrame) -> DataFrame:
    """(category, feed, catalogue_source, category_order, source_order) of a catalogue's rows."""
    order = F.dense_rank().over(Window.orderBy("category")) if "category_order" not in catalogue.columns else F.col("category_order")
    return catalogue.select("category", slug(F.col("source")).alias("feed"), F.col("source").alias("catalogue_source"),
                            order.alias("category_order"), "source_order")


def read_landed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Landed RSS items; category and feed come from the folders."""
    reader = (spark.readStream if stream else spark.read).format("xml").schema(RSS_SCHEMA).option("rowTag", "item")
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", FD.CORRUPT).option("basePath", path).load(path)


def judged(items: DataFrame, feeds: DataFrame, as_of: str, limit_per_source: int | None = L.LIMIT_PER_SOURCE) -> DataFrame:
    """``items`` (one batch) cleaned, with catalogue fields and ``reason``, null where nothing speaks against them."""
    # position: the order of the rows in their files, before anything is shuffled
    rows = items.withColumn("_at", F.monotonically_increasing_id()).withColumn("_file", F.input_file_name())
    rows = materialize(FD.feed_entries(rows).select("category", "feed", "guid", "raw_title", "url", "raw_summary", F.col("published_ts").alias("published"),
                                                    (F.col(FD.CORRUPT).isNotNull()).alias("_broken"), "_file", "_at"), "landed")
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("category", "feed").orderBy("_file", "_at")) - 1)
    rows = rows.join(feeds, ["category", "feed"], "left")
    e = A.prepare_entries(rows, source=None, default_source=None)
    late = F.col("position") >= (limit_per_source if limit_per_source is not None else 1 << 62)
    reason = (F.when(F.col("_broken"), "malformed").when(F.col("source_order").isNull(), "unknown feed").when(late, "beyond the head of its feed")
              .when(~A.has_title_and_link(), "no title or link").when(~A.has_meaningful_content(), "too short")
              .when(~A.is_recent("published", as_of), "too old"))
    return e.withColumn("reason", reason)


def first_accepted(rows: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``rows`` where all but the first acceptable row of a key, and rows whose
    key is in ``earlier`` (article_key), have the reason ``duplicate``."""
    ok = F.col("reason").isNull()
    if earlier is not None:
        rows = rows.join(earlier.select("article_key", F.lit(True).alias("_known")).dropDuplicates(["article_key"]), "article_key", "left")
        rows = rows.withColumn("reason", F.when(ok & F.col("_known"), "duplicate").otherwise(F.col("reason")))
    fine = rows.where(F.col("reason").isNull())
    place = F.struct("category_order", "source_order", "position", "category", "feed")
    first = fine.groupBy("article_key").agg(F.min(place).alias("_first"))
    out = rows.join(first, "article_key", "left")
    return out.withColumn("reason", F.when(ok & (place != F.col("_first")), "duplicate").otherwise(F.col("reason")))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason is null").select("category", F.col("catalogue_source").alias("source"), "title", "url", "summary", "published", "article_key", "guid")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select("category", "feed", "guid", "title", "reason")


def source_report(rows: DataFrame) -> DataFrame:
    """Per feed: rows read, accepted, and rejected by reason."""
    return rows.groupBy("category", "feed").agg(
        F.count("*").alias("rows"), F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"),
        F.count(F.when(F.col("reason") == "malformed", 1)).alias("malformed"), F.count(F.when(F.col("reason") == "duplicate", 1)).alias("duplicates"))


def run(spark: SparkSession, landed: str, out: str, catalogue: DataFrame, as_of: str,
        limit_per_source: int | None = L.LIMIT_PER_SOURCE, max_files: int | None = None) -> None:
    """Take in all files of ``landed`` that were not seen yet, as a stream that
    ends when there is nothing new.  Output below ``out``: ``accepted`` and
    ``rejected``, a folder for each batch."""
    feeds = materialize(known_feeds(catalogue), "feeds")
    for kind, schema in (("accepted", ACCEPTED), ("rejected", REJECTED)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/{kind}/batch=-1")

    def take(batch: DataFrame, number: int) -> None:
        earlier = read(spark, out, "accepted").where(F.col("batch") < number)
        rows = materialize(first_accepted(judged(batch, feeds, as_of, limit_per_source), earlier), "batch")
        accepted(rows).write.mode("overwrite").parquet(f"{out}/accepted/batch={number}")
        rejected(rows).write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")

    items = read_landed(spark, landed, stream=True) if max_files is None else None
    if items is None:
        items = spark.readStream.format("xml").schema(RSS_SCHEMA).option("rowTag", "item").option("mode", "PERMISSIVE") \
            .option("columnNameOfCorruptRecord", FD.CORRUPT).option("basePath", landed).option("maxFilesPerTrigger", max_files).load(landed)
    query = items.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/_progress").trigger(availableNow=True).start()
    query.awaitTermination()


def read(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """``accepted`` or ``rejected`` rows of all batches, with ``batch``."""
    return spark.read.schema((ACCEPTED if kind == "accepted" else REJECTED) + ", batch int").option("basePath", f"{out}/{kind}").parquet(f"{out}/{kind}")
