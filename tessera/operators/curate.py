"""Corpus curation (F1-F11) and corpus assembly.

All steps are narrow column expressions except the exact dedupe, which is a
single shuffle keyed by a 64-bit hash of the text (ties broken by the text
itself, so it is exact).  Spark plans ``row_number() ... = 1`` with a partial
``WindowGroupLimit`` before that shuffle, so a text repeated in a third of
all rows leaves each map task as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as TX
from .profile import unwatched


def drop_null(df: DataFrame, col: str) -> DataFrame:                      # F1
    return df.filter(F.col(col).isNotNull())


def drop_tombstones(df: DataFrame, col: str, tombstones=None) -> DataFrame:  # F2/F3
    """Drop exact tombstone values; NULL is kept (pandas ``~isin`` is True on NaN)."""
    t = tombstones if tombstones is not None else L.TOMBSTONES
    c = F.col(col)
    return df.filter(c.isNull() | ~c.isin(*t))


def strip_col(df: DataFrame, col: str) -> DataFrame:                      # F4
    return df.withColumn(col, TX.strip(col))


def min_length(df: DataFrame, col: str, n: int = L.MIN_TEXT_CHARS) -> DataFrame:  # F5
    """Keep rows whose text has at least n code points (NULL fails)."""
    return df.filter(F.length(col) >= n)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:  # F8
    """Keep the first row per key, first by ``order`` (deterministic).

    Partitioned by (xxhash64(keys), keys): the sort prefix is a long, so
    long texts are only compared on hash ties.
    """
    h = "__h"
    w = Window.partitionBy(h, *keys).orderBy(*[F.col(o).asc() for o in order])
    return (df.withColumn(h, F.xxhash64(*keys))
              .withColumn("__rn", F.row_number().over(w))
              .filter(F.col("__rn") == 1)
              .drop("__rn", h))


def curate_comments(df: DataFrame, text: str = "body", order: str = "doc_id", watch=unwatched) -> DataFrame:  # F10
    """``watch(stage, df)`` sees the rows after each stage."""
    x = watch("raw", df)
    x = watch("non_null", drop_null(x, text))
    x = watch("no_tombstone", drop_tombstones(x, text))
    x = strip_col(x, text)
    x = watch("min_length", min_length(x, text))
    return watch("deduplicated", dedupe_first(x, [text], [order]))


def compose_joke_text(df: DataFrame, title: str = "title", selftext: str = "selftext",
                      out: str = "text") -> DataFrame:                   # F6/F7
    t = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.col(selftext))
    return df.withColumn(out, TX.strip(t))


def curate_jokes(df: DataFrame, order: str = "doc_id", watch=unwatched) -> DataFrame:    # F11
    x = watch("raw", df).withColumn("selftext", F.coalesce(F.col("selftext"), F.lit("")))
    x = watch("no_tombstone", drop_tombstones(x, "selftext"))
    x = compose_joke_text(x)
    x = watch("min_length", min_length(x, "text"))
    return watch("deduplicated", dedupe_first(x, ["text"], [order]))


# ---------------------------------------------------------------------------
# Corpus assembly
# ---------------------------------------------------------------------------

SOURCE_BITS = 48


def corpus_id(source_rank: int, key) -> F.Column:
    """Stable unique id from (source rank, natural key); no positional ids."""
    k = F.col(key) if isinstance(key, str) else key
    return F.shiftleft(F.lit(source_rank).cast("long"), SOURCE_BITS).bitwiseOR(k.cast("long"))


def assemble_corpus(comments: DataFrame, jokes: DataFrame) -> DataFrame:  # C1-C3
    """Union of curated comments and jokes with one wide metadata schema."""
    c = comments.select(
        corpus_id(0, "doc_id").alias("corpus_id"),
        F.col("body").alias("text"),
        F.lit("reddit_comment").alias("source"),
        F.col("subreddit"),
        F.col("score").cast("long").alias("score"),
    )
    j = jokes.select(
        corpus_id(1, "doc_id").alias("corpus_id"),
        F.col("text"),
        F.lit("reddit_joke").alias("source"),
        F.col("subreddit"),
        F.col("score").cast("long").alias("score"),
    )
    return c.unionByName(j, allowMissingColumns=True)


def _given(name: str, kind: str, strict: bool) -> F.Column:
    """A field that its source must have: with ``strict`` a null stops the job, naming the field."""
    c = F.col(name).cast(kind)
    return F.coalesce(c, F.raise_error(F.lit(f"metadata field {name} is null")).cast(kind)) if strict else c


def corpus_metadata(comments: DataFrame, jokes: DataFrame, key: str = "doc_id", strict: bool = True) -> DataFrame:  # C2, C3
    """One metadata row per curated text, with the fields of its source.

    Comments carry ``controversiality``, jokes ``nsfw`` and ``created_utc``;
    what the other source lacks is null.  Numbers must be given, as an int cast
    demands: a null stops the job, or stays null with ``strict=False``.
    A narrow projection of both sides and a union: no shuffle.
    """
    def side(df: DataFrame, rank: int, tag: str, text: str, **own: F.Column) -> DataFrame:
        return df.select(corpus_id(rank, key).alias("doc_id"), F.col(text).alias("text"), F.lit(tag).alias("source"),
                         F.col("subreddit"), _given("score", "long", strict).alias("score"),
                         *[c.alias(name) for name, c in own.items()])

    c = side(comments, 0, "reddit_comment", "body", controversiality=_given("controversiality", "int", strict))
    j = side(jokes, 1, "reddit_joke", "text", nsfw=F.col("nsfw").cast("boolean"), created_utc=_given("created_utc", "long", strict))
    return c.unionByName(j, allowMissingColumns=True)


def alignment_report(texts: DataFrame, metadata: DataFrame, key: str) -> DataFrame:  # C4
    """One row: texts without metadata, metadata without text, duplicate text keys.

    Both sides are reduced to per-key counts (partial aggregation), then one
    full outer join on the key; both empty and no duplicates means aligned.
    """
    t = texts.groupBy(key).agg(F.count(F.lit(1)).alias("nt"))
    m = metadata.groupBy(key).agg(F.count(F.lit(1)).alias("nm"))
    j = t.join(m, key, "full_outer")
    return j.agg(
        F.coalesce(F.sum(F.when(F.col("nm").isNull(), F.col("nt"))), F.lit(0)).alias("texts_without_metadata"),
        F.coalesce(F.sum(F.when(F.col("nt").isNull(), F.col("nm"))), F.lit(0)).alias("metadata_without_text"),
        F.count(F.when(F.col("nt") > 1, 1)).alias("duplicate_text_keys"),
    )


def counts_by_source(corpus: DataFrame) -> DataFrame:                    # C5
    return corpus.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
