"""Training-data pipeline over ``documents``: five stages, one operator each.

1. ``quality``: documents that fail a quality rule go.
2. ``line_dedup``: repeated three-line windows lose their later occurrences;
   a document of which nothing is left goes.
3. ``near_duplicates``: of documents whose 5-word shingles are 80 % alike,
   directly or through others, the one with the least id stays.
4. ``decontaminate``: spans of benchmark items are cut out; a document that is
   mostly benchmark goes, as does one of which nothing is left.
5. ``tokenize``: token ids, their number, and digests of ids and decoded text.

Every stage but the last returns the columns of ``documents``; ``n_chars``
follows the text.  ``run`` writes each stage's rows to the shared folder and
reads them back for the next one.

Defined results: null and empty texts fail the quality rules; rows with a
null id have no component and stay; of repeated rows of one document the
first stage that compares documents keeps one; extra columns pass all stages
but the last, which adds its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, line_dedup, partenum, quality
from tessera.llm.common import stored, table


def _with_text(docs: DataFrame, columns: list[str], new: str) -> DataFrame:
    """``columns`` with the text replaced by column ``new``, without documents of which nothing is left."""
    out = docs.where(F.coalesce(F.btrim(F.col(new), F.lit(line_dedup.BLANKS)) != "", F.lit(False)))
    size = {"n_chars": F.length(new).cast("bigint")}
    return out.select(*[F.col(new).alias("text") if c == "text" else size[c].alias(c) if c in size else F.col(c) for c in columns])


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass every rule, with their columns as they were."""
    marked = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    return quality.evaluate(marked).where("kept").select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    out = line_dedup.remove_repeated_windows(marked)
    return _with_text(out.select("_row.*", F.col("kept_text").alias("_new")), docs.columns, "_new")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are the least id of their component; of rows with one id, the one with the least hash."""
    found = partenum.similar_components(docs)
    first = found.where("component_id = doc_id").select(F.col("doc_id").alias("_keep")).distinct()
    # few rows share an id, so the window holds no large group
    several = docs.groupBy("doc_id").agg(F.count("*").alias("_c")).where("_c > 1 and doc_id is not null")
    kept = docs.join(first, F.col("doc_id") == F.col("_keep"), "left").where("_keep is not null or doc_id is null").drop("_keep")
    if several.limit(1).count() == 0:
        return kept
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    again = kept.join(several.drop("_c"), "doc_id", "left_semi").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return kept.join(several.drop("_c"), "doc_id", "left_anti").unionByName(again)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    carried = [c for c in docs.columns if c not in decontam.OUTPUTS]
    marked = docs.select(F.struct(*docs.columns).alias("_row"), "text") if carried != docs.columns else docs
    keep = ["_row"] if carried != docs.columns else docs.columns
    out = decontam.decontaminate(marked, table(spark, sf_dir, "benchmark"), outputs=("dropped", "kept_text"), carried=keep)
    out = out.where(~F.col("dropped")).withColumnRenamed("kept_text", "_new")
    return _with_text(out.select("_row.*", "_new") if carried != docs.columns else out, docs.columns, "_new")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, bpe.vocabulary_path(), ("n_tokens", "ids_sha256", "decoded_sha256"), carried=["doc_id"])


STAGES = [
    ("quality", filter_quality),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("tokenize", tokenize),
]

#: Merging byte pairs is not expressible in SQL; tests/llm compares with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
