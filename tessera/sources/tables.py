"""Scans of the shared parquet tables and the views derived from them.

Each view is a projection over a base table, so Catalyst prunes columns and
pushes filters into the parquet scan.  Nothing here collects data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Reference time of the test feeds; recency and freshness are measured from it.
AS_OF = "2025-01-01 00:00:00"


# Row key of each table, used to spread a narrow scan by hash.
KEYS = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id",
        "conversations": "conv_id", "events": "event_id", "benchmark": "item_id",
        "labels": "doc_id", "lineitem": "l_orderkey", "orders": "o_orderkey"}


SPREAD_MIN_BYTES = 1024 * 1024


def spread(df: DataFrame, key: str | None, min_bytes: int = SPREAD_MIN_BYTES) -> DataFrame:
    """Hash-spread a scan that has fewer partitions than the cluster has
    cores (a file written as one row group scans as one task) when it is big
    enough for the extra exchange to pay.  Planning-time checks only (scan
    partitions, Catalyst's size estimate): a scan of many files is returned
    untouched, with no shuffle."""
    if key is None:
        return df
    par = df.sparkSession.sparkContext.defaultParallelism
    files = tuple(df.inputFiles())
    decision = _SPREAD_CACHE.get((files, par, min_bytes))
    if decision is None:
        narrow = df.rdd.getNumPartitions() < par
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        decision = narrow and size >= min_bytes
        _SPREAD_CACHE[(files, par, min_bytes)] = decision
    return df.repartition(par, key) if decision else df


_SPREAD_CACHE: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, KEYS.get(name))


def comments(spark, sf_dir) -> DataFrame:
    """Raw-comment view: body, subreddit, score (+ row key doc_id)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("body"),
                    F.col("source").alias("subreddit"),
                    F.col("n_chars").alias("score"))


def jokes(spark, sf_dir) -> DataFrame:
    """Raw-joke view: title = first 40 chars, selftext = the rest."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id",
                    F.expr("substring(text, 1, 40)").alias("title"),
                    F.expr("substring(text, 41)").alias("selftext"),
                    F.col("n_chars").alias("score"),
                    F.col("source").alias("subreddit"))


def dumped_comments(spark, sf_dir) -> DataFrame:
    """Raw comments with every column of the dump: of documents labelled as
    poor the comment counts as controversial."""
    lab = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, 1).alias("low"))
    c = comments(spark, sf_dir).join(lab, "doc_id", "left")
    return c.select("body", "subreddit", "score", F.coalesce("low", F.lit(0)).alias("controversiality"), "doc_id")


def dumped_jokes(spark, sf_dir) -> DataFrame:
    """Raw jokes with every column of the dump: ``nsfw`` from the toxic label,
    ``created_utc`` from the time of the event that has the document's number."""
    lab = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long").alias("at"))
    j = jokes(spark, sf_dir).join(lab, "doc_id", "left").join(ev, "doc_id", "left")
    return j.select("title", "selftext", "score", F.col("subreddit").alias("subreddit.name"),
                    F.coalesce("toxic", F.lit(False)).alias("subreddit.nsfw"), F.coalesce("at", F.lit(0)).alias("created_utc"), "doc_id")


_ARTICLES_SQL = """
  page_id AS article_id,
  concat(CASE page_id % 14 WHEN 0 THEN 'Breaking news: ' WHEN 1 THEN 'What is ' WHEN 2 THEN '10 '
    WHEN 3 THEN 'Opinion: ' WHEN 4 THEN 'Company announces AI deal, ' WHEN 5 THEN 'Why the 2018 '
    WHEN 6 THEN 'GTA VI trailer leaked: ' WHEN 7 THEN 'Complete guide to ' WHEN 8 THEN 'Hands-on review: '
    WHEN 9 THEN 'Is it over? ' WHEN 10 THEN 'Top reasons ' WHEN 11 THEN 'Trump said ' ELSE '' END,
    regexp_extract(html, '<title>(.*?)</title>', 1)) AS raw_title,
  CASE WHEN page_id % 17 = 0 THEN 'short' ELSE regexp_extract(html, '<p>(.*?)</p>', 1) END AS raw_summary,
  CASE WHEN page_id % 25 = 3 THEN 'http://dup.example.com/A'
       WHEN page_id % 25 = 4 THEN ' HTTP://DUP.example.com/a' ELSE url END AS url,
  CASE page_id % 9 WHEN 0 THEN 'Reuters' WHEN 1 THEN 'BBC News'
    WHEN 2 THEN 'ABC News - Breaking News, Latest News and Videos' WHEN 3 THEN 'Ignite Blog'
    WHEN 4 THEN NULL WHEN 5 THEN 'The Hindu' WHEN 6 THEN '!!!'
    ELSE regexp_extract(url, '^https?://([^/]+)', 1) END AS source,
  regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS category,
  CASE WHEN page_id % 7 = 0 THEN NULL ELSE
    CAST(TIMESTAMP_NTZ '2025-01-01 00:00:00' - make_dt_interval(0, CAST(page_id % 120 AS INT)) AS TIMESTAMP)
  END AS published,
  page_id AS position
"""


def articles(spark, sf_dir) -> DataFrame:
    """Feed entries derived from ``pages`` (one row per page, raw fields)."""
    p = table(spark, sf_dir, "pages")
    return p.selectExpr(*[s.strip() for s in _split_select(_ARTICLES_SQL)])


def _split_select(sql: str):
    """Split a SELECT list on top-level commas (outside parentheses/quotes)."""
    out, depth, cur, quoted = [], 0, [], False
    for ch in sql:
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch == "(":
            depth += 1
        elif not quoted and ch == ")":
            depth -= 1
        if ch == "," and depth == 0 and not quoted:
            out.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    out.append("".join(cur))
    return [o for o in out if o.strip()]


# FIXED VALUES — the request topics of the test feeds.
TOPICS = [
    (1, "gta 6"),
    (2, "Donald Trump"),
    (3, "Artificial Intelligence"),
    (4, "the latest news"),
    (5, "announces deal"),
    (6, "hands on"),
    (7, "the 2018"),
    (8, "   "),
]


def topics(spark) -> DataFrame:
    return spark.createDataFrame(TOPICS, "topic_id bigint, topic string")
