"""Line dedup over overlapping three-line windows.

A document's lines that hold anything but white space are numbered; each run
of three of them is a window, compared without white space at the ends of its
lines by a 128-bit hash.  A window that occurs more than once keeps its first
occurrence, in the order of document and line; every later occurrence covers
its lines, overlapping ones merge, and covered lines go.  Windows are judged
on the input, not on what is left.

Scale: windows leave the scan as hashes.  First occurrences come from a
partial aggregate, so a window that stands in a third of all documents is one
row per task there; the join back is splittable by adaptive execution.

Defined results: a text of fewer than three such lines has no window and
stays; null stays null; a text whose lines all go becomes empty; of rows with
the same document id, places are ordered by the hash of the text, and exact
repeats of a row (same id, same text) count as one occurrence; extra columns
pass, ``n_lines``, ``n_removed_lines`` and ``kept_text`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, table

LINES = 3
BLANKS = " \t\n\x0b\x0c\r"


def _content(text: Column) -> Column:
    """(line, its place among all lines) of the lines that hold anything."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(BLANKS)).alias("line"), i.alias("at")))
    return F.filter(lines, lambda x: x["line"] != "")


def windows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per window: two hashes, the document, its text's hash, and the places of its three lines."""
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("_doc"), F.xxhash64(text).alias("_text"), F.explode(F.expr(
            "transform(slice(_l, 1, greatest(size(_l) - 2, 0)), (x, i) -> struct("
            "xxhash64(x.line, _l[i + 1].line, _l[i + 2].line) AS h, "
            "xxhash64('second', x.line, _l[i + 1].line, _l[i + 2].line) AS g, x.at AS a, _l[i + 1].at AS b, _l[i + 2].at AS c))")).alias("w"))
    return rows.select("_doc", "_text", "w.*")


def remove_repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_removed_lines``."""
    carried = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_removed_lines", "_l", "_gone")]
    listed = docs.select(F.col(key), F.col(text)).withColumn("_l", _content(F.col(text)))
    w = windows(listed, key, text)
    place = F.struct("_doc", "_text", "a")
    first = w.groupBy("h", "g").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where(F.col("_first") != F.col("_last"))
    later = w.join(first.drop("_last"), ["h", "g"]).where(place != F.col("_first"))
    gone = later.groupBy("_doc", "_text").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array("a", "b", "c"))))).alias("_gone"))
    joined = docs.select(*carried, F.xxhash64(text).alias("_h")).join(
        gone.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_text")), "left")
    lines = F.split(F.col(text), "\n")
    # the places that stay come from one hashed difference, so the work grows with the lines, not with lines times removed lines
    kept = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(bind(lines, lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)), "\n")))
    # a text of which only blank lines are left holds nothing
    kept = F.when(F.col("_gone").isNotNull() & (F.btrim(kept, F.lit(BLANKS)) == ""), F.lit("")).otherwise(kept)
    return joined.select(*carried, kept.alias("kept_text"),
                         F.coalesce(F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed_lines"))


def op5_line_dedup(spark, sf_dir) -> DataFrame:
    out = remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.coalesce(F.octet_length("kept_text"), F.lit(0)).cast("long").alias("kept_bytes"),
                      F.sha2(F.coalesce(F.col("kept_text"), F.lit("")), 256).alias("kept_sha256"))


#: DuckDB: from {docs} (doc_id, text) the rows (doc_id, text, n_lines, n_removed, kept).
SQL = r"""
l0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {docs}),
l1 AS (SELECT doc_id, ls[i] AS line, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l0 WHERE text IS NOT NULL)),
l2 AS (SELECT doc_id, i, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l1),
l3 AS (SELECT doc_id, i, line, lead(line) OVER p AS y, lead(line, 2) OVER p AS z, lead(i) OVER p AS j, lead(i, 2) OVER p AS k
       FROM l2 WHERE line <> '' WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
l4 AS (SELECT doc_id, i, j, k, row_number() OVER (PARTITION BY line, y, z ORDER BY doc_id, i) AS r FROM l3 WHERE z IS NOT NULL),
l5 AS (SELECT DISTINCT doc_id, unnest([i, j, k]) AS i FROM l4 WHERE r > 1),
l6 AS (SELECT doc_id, list(i) AS gone FROM l5 GROUP BY doc_id),
l7 AS (SELECT l0.doc_id, text, ls, coalesce(gone, []) AS gone,
  CASE WHEN text IS NULL THEN NULL WHEN gone IS NULL THEN text ELSE
  array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda x: NOT list_contains(gone, x)), lambda x: ls[x]), chr(10)) END AS kept0
  FROM l0 LEFT JOIN l6 ON l0.doc_id = l6.doc_id),
deduped AS (SELECT doc_id, CASE WHEN len(gone) > 0 AND NOT regexp_matches(kept0, '[^\x20\x09-\x0D]') THEN '' ELSE kept0 END AS kept,
  CAST(len(gone) AS BIGINT) AS n_removed_lines,
  CAST(coalesce(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0) AS BIGINT) AS n_lines FROM l7)
"""
ORACLE = {"op5_line_dedup": "WITH " + SQL.replace("{docs}", "documents") + """
SELECT doc_id, n_lines, n_removed_lines, CAST(coalesce(strlen(kept), 0) AS BIGINT) AS kept_bytes, sha256(coalesce(kept, '')) AS kept_sha256 FROM deduped"""}
QUERIES = {"op5_line_dedup": op5_line_dedup}
