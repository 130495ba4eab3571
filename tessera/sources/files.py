"""File scans and sinks for the curation and vector stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V

COMMENTS_SCHEMA = T.StructType([
    T.StructField("body", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("controversiality", T.IntegerType()),
])

JOKES_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("subreddit.name", T.StringType()),
    T.StructField("subreddit.nsfw", T.BooleanType()),
    T.StructField("created_utc", T.LongType()),
])

METADATA_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("controversiality", T.IntegerType()),
    T.StructField("nsfw", T.BooleanType()),
    T.StructField("created_utc", T.LongType()),
])


def _csv(spark: SparkSession, path: str, schema, key: str | None = None) -> DataFrame:
    # Text fields may hold newlines inside quotes: multiLine is required.
    if key is not None:
        schema = T.StructType([*schema.fields, T.StructField(key, T.LongType())])
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
                 .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
                 .csv(path))


def read_comments_csv(spark, path, key: str | None = None) -> DataFrame:  # S1
    """Raw comments; ``key`` names a row key that follows the columns of the dump."""
    return _csv(spark, path, COMMENTS_SCHEMA, key)


def read_jokes_csv(spark, path, key: str | None = None) -> DataFrame:     # S2
    """Raw jokes, the dotted columns renamed; ``key`` as for comments."""
    df = _csv(spark, path, JOKES_SCHEMA, key)
    return (df.withColumnRenamed("subreddit.name", "subreddit")
              .withColumnRenamed("subreddit.nsfw", "nsfw")
              .withColumn("created_at", F.timestamp_seconds("created_utc")))


def read_table(spark, path, fmt: str = "parquet", schema=None) -> DataFrame:  # S3, S8
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None, codec: str | None = None) -> None:  # S4, S5, S7
    """``codec`` compresses the files of a text format (gzip at its fastest level,
    for example); readers know it by the name of the file, one task a file."""
    w = df.write.mode("overwrite").format(fmt)
    if codec is not None:
        w = w.option("compression", codec).option("zlib.compress.level", "BEST_SPEED")
    if fmt == "csv":
        # white space at the ends of a text is part of it; the writer would trim it
        w = (w.option("header", True).option("escape", '"')
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_metadata(df: DataFrame, path: str, codec: str | None = None) -> None:  # S7
    """Corpus metadata as UTF-8 JSON Lines with the fields of METADATA_SCHEMA; a field that is null is left out."""
    write_table(df.select(*[F.col(f.name).cast(f.dataType) for f in METADATA_SCHEMA]), path, "json", codec=codec)


def read_metadata(spark, path, array: bool = False) -> DataFrame:          # S8
    """Corpus metadata with every field of METADATA_SCHEMA, null where an entry has none.

    JSON Lines are split over tasks, compressed ones by file.  ``array`` reads files that hold one JSON
    array of entries each, as the dump scripts write them: one task a file.
    Such entries have no ``doc_id``; a line that is no JSON object has all null.
    """
    return (spark.read.schema(METADATA_SCHEMA).option("mode", "PERMISSIVE")
                 .option("multiLine", array).json(path))


def vectors_report(df: DataFrame, vec: str = "embedding") -> DataFrame:  # S6
    """ntotal, dimension range (a consistent index has min_dim == max_dim),
    element type and unit-norm check, in one aggregate."""
    et = df.schema[vec].dataType.elementType.simpleString()
    n = V.l2_norm(vec)
    return df.agg(F.count(F.lit(1)).alias("ntotal"),
                  F.min(F.size(vec)).cast("long").alias("min_dim"),
                  F.max(F.size(vec)).cast("long").alias("max_dim"),
                  F.min(n).alias("min_norm"), F.max(n).alias("max_norm")) \
             .withColumn("dtype", F.lit(et))


def save_vectors(df: DataFrame, path: str, id_col: str = "doc_id", vec: str = "embedding") -> None:  # S9
    """Persist the normalized vector table once; search reads it back."""
    df.select(F.col(id_col).cast("long").alias(id_col),
              V.l2_normalize(vec).alias(vec)).write.mode("overwrite").parquet(path)
