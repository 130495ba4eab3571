"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bind(expr: Column, body) -> Column:
    """``body(expr)`` with ``expr`` evaluated once: inside higher-order
    functions a repeated expression would be evaluated at each mention."""
    return F.get(F.transform(F.array(expr), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words of ``text``; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder.  The session names it
    in ``spark.checkpoint.dir``; only a local session may go without."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="llm-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is
    cut, and a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Characters of text that a worker holds as Python objects at a time.
SLICE_CHARS = 4_000_000


def map_texts(df: DataFrame, text: str, carried: list[str], new: str, make, before: list[str] | None = None) -> DataFrame:
    """``carried`` columns of ``df`` plus the columns of the DDL ``new``.

    ``make()`` runs once per task and returns a function from a list of texts
    (None for null) to one list per new column; with ``before``, also from the
    lists of those columns.  Arrow batches are cut into
    slices of about ``SLICE_CHARS``, so memory follows the longest text, not
    the batch.
    """
    from pyspark.sql.types import StructType

    out = StructType([df.schema[c] for c in carried] + list(StructType.fromDDL(new).fields))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in out.fields[len(carried):]]
        work = make()
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
            start, total = 0, 0
            for i in range(len(sizes) + 1):
                if i == len(sizes) or (total and total + sizes[i] > SLICE_CHARS):
                    if i > start:
                        part = batch.slice(start, i - start)
                        of = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
                        made = work(of(text)) if before is None else work(of(text), [of(c) for c in before])
                        yield pa.RecordBatch.from_arrays(
                            [part.column(part.schema.get_field_index(c)) for c in carried]
                            + [pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)], names=out.names)
                    start, total = i, 0
                if i < len(sizes):
                    total += sizes[i]

    ship_package(df.sparkSession)
    need = list(dict.fromkeys([*carried, text, *(before or [])]))
    return df.select(*need).mapInArrow(run, out)


#: Rounds of ``components`` that merge by id, which ends stars at once; the later ones do not depend on the ids.
ID_ROUNDS = 3


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of the nodes of ``edges`` (a, b): the least node that each
    can reach.  Each round merges every node into its least neighbour and
    keeps the edges between different merged nodes, so the graph shrinks; the
    merges of all rounds are put together at the end.  After ``ID_ROUNDS``
    rounds least means by a hash that changes each round: of a path about half
    the nodes are left, whatever its ids, so rounds grow with the logarithm of
    the nodes.  Edges are written to the shared folder after each round, one
    flag returns to the driver."""
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    merges = []
    while True:
        salt = len(merges)
        rank = lambda c: F.struct((F.lit(0) if salt < ID_ROUNDS else F.xxhash64(c, F.lit(salt))).cast("bigint").alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = left.union(left.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("near"))
        merge = stored(near.select("node", F.least(rank("node"), "near")["id"].alias("label")), name)
        merges.append(merge)
        to = lambda c: merge.select(F.col("node").alias(c), F.col("label").alias(f"{c}2"))  # noqa: B023, E731
        moved = left.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2")
        left = stored(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{name}-edges")
        if left.limit(1).count() == 0:
            break
    # from the last round back: where a node's label went on to
    out = merges[-1]
    for k in range(len(merges) - 1, -1, -1):
        if k < len(merges) - 1:
            later = out.select(F.col("node").alias("label"), F.col("label").alias("final"))
            out = stored(merges[k].join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label")), name)
        if k == ID_ROUNDS:  # rounds by id keep the least node of all, so it is among these
            least = out.groupBy("label").agg(F.min("node").alias("least"))
            out = stored(out.join(least, "label").select("node", F.col("least").alias("label")), name)
    return out
