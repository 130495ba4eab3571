"""Landed feed files (S11, S12), feed catalogue (S10), search manifest.

Feeds are fetched by an external lander; these readers use Spark's built-in
XML source over the landed files (RSS ``item`` or Atom ``entry`` rows), so
one broken file yields one corrupt row and leaves the others intact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import dates as D
from ..functions import lexicons as L
from ..functions import text as TX

CORRUPT = "_corrupt_record"

#: Atom entries (row tag ``entry``), whatever attributes and repeats a file has.
_ATOM_TEXT = "struct<_VALUE: string, _type: string>"
ATOM_SCHEMA = (f"id string, title {_ATOM_TEXT}, link array<struct<_VALUE: string, _href: string, _rel: string, _type: string>>, "
               f"summary {_ATOM_TEXT}, published string, updated string, source struct<title: {_ATOM_TEXT}>, {CORRUPT} string")


def read_feed_files(spark: SparkSession, path: str, row_tag: str = "item",
                    stream: bool = False, schema=None) -> DataFrame:
    """Raw entries with (feed_file, position) from landed RSS/Atom XML."""
    reader = spark.readStream if stream else spark.read
    # texts and dates stay strings: they are parsed by feed_entries
    r = (reader.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("inferSchema", "false")
               .option("columnNameOfCorruptRecord", CORRUPT))
    if schema is not None:
        r = r.schema(schema)
    df = r.load(path).withColumn("feed_file", F.input_file_name())
    if stream:
        return df
    # Feed order inside each file: the scan order of its rows.
    w = Window.partitionBy("feed_file").orderBy(F.monotonically_increasing_id())
    return df.withColumn("position", F.row_number().over(w) - 1)


def _text(c: F.Column, kind) -> F.Column:
    """Text of an element that was read as a string or, for its attributes, as a struct; the first of several."""
    if isinstance(kind, ArrayType):
        return _text(F.get(c, F.lit(0)), kind.elementType)
    if isinstance(kind, StructType):
        name = next((n for n in ("_VALUE", "title") if n in kind.names), None)
        return _text(c[name], kind[name].dataType) if name else F.lit(None).cast("string")
    return c


def _link(c: F.Column, kind) -> F.Column:
    """RSS: the element's text.  Atom: ``href`` of the alternate link, or else of the first."""
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        one = kind.elementType
        if "_rel" in one.names:
            main = F.get(F.filter(c, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))
            return F.coalesce(_link(main, one), _link(F.get(c, F.lit(0)), one))
        return _link(F.get(c, F.lit(0)), one)
    if isinstance(kind, StructType) and "_href" in kind.names:
        return F.coalesce(c["_href"], _text(c, kind))
    return _text(c, kind)


def feed_entries(raw: DataFrame, default_source: str = L.DEFAULT_SOURCE) -> DataFrame:
    """Flatten RSS or Atom fields to (raw_title, url, raw_summary, source, published)."""
    cols = set(raw.columns)

    def col(name, of=_text):
        return of(F.col(name), raw.schema[name].dataType) if name in cols else F.lit(None).cast("string")

    return raw.select(
        "*",
        col("title").alias("raw_title"),
        F.coalesce(col("link", _link), F.lit("")).alias("url"),
        F.coalesce(col("description"), col("summary")).alias("raw_summary"),
        TX.source_or_default(col("source"), default_source).alias("source_name"),
        D.parse_entry_time(col("pubDate") if "pubDate" in cols else col("published"),
                           col("updated")).alias("published_ts"),
    )


def malformed_report(raw: DataFrame, key: str = "feed_file") -> DataFrame:   # S12
    """Per feed file: rows, corrupt rows and a malformed flag."""
    corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)
    # Count a struct of the parsed fields too: a query that reads only the
    # corrupt-record column is not allowed (and would not parse the rows).
    fields = [c for c in raw.columns if c not in (CORRUPT, key, "position")]
    parsed = F.count(F.coalesce(*[F.col(c).cast("string") for c in fields])) if fields else F.lit(0)
    return raw.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), parsed.alias("parsed_rows"),
                                F.sum(corrupt.cast("int")).alias("corrupt_rows")) \
              .withColumn("malformed", F.col("corrupt_rows") > 0)


def search_url(query) -> F.Column:                                            # S13
    """News search URL for a query; url-encoding as Python's quote_plus."""
    q = TX.strip(F.col(query) if isinstance(query, str) else query)
    enc = F.replace(F.replace(F.url_encode(q), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(L.SEARCH_URL_PREFIX), enc, F.lit(L.SEARCH_URL_SUFFIX))


def catalogue(spark: SparkSession) -> DataFrame:                              # S10
    rows = [(cat, src, url, i) for cat, feeds in L.FEED_CATALOGUE.items()
            for i, (src, url) in enumerate(feeds)]
    return spark.createDataFrame(rows, "category string, source string, url string, source_order int")
