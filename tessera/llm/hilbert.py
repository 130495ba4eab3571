"""Sharding by Hilbert-curve order, with DataFrame functions only.

Metadata dimensions are quantised to ``bits`` bits each, a row's cell gets its
index on the Hilbert curve, rows are range-sorted by that index and the order
is cut into runs of equal row counts (law ``rows``).  Neighbours on the curve
are close in every dimension, so a file holds a small box of each of them and
min/max statistics prune files for filters on any dimension.

The global rank needs no single task: the sorted rows are written once with
the number of their partition and their place in it; the partition sizes (one
row per partition) are summed up and joined back.  A hot cell is no problem:
the sort key continues with the row key, so range partitioning splits it.

Law ``rows`` deals rows, not groups: equal texts of different source, language
or size class may lie in different shards.

Defined results: a null text has no bytes (size 1, CRC 0); null metadata is a
cell of its own; repeated rows get a slot each; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, stored, table

BITS = 5


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer ``axes`` in [0, 2**bits).

    Skilling's transform as folds over (bit, axis) steps: undo the excess
    work bit plane by bit plane, Gray-encode, then interleave the bits.
    """
    n = len(axes)
    put = lambda x, at, v: F.transform(x, lambda e, j: F.when(j == at, v).otherwise(e))
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x, s):
        low = s["q"] - 1
        t = (F.get(x, F.lit(0)).bitwiseXOR(F.get(x, s["i"]))).bitwiseAND(low)
        flip = put(x, 0, F.get(x, F.lit(0)).bitwiseXOR(low))
        swap = F.transform(x, lambda e, j: F.when(((j == 0) | (j == s["i"])) & (s["i"] != 0), e.bitwiseXOR(t)).otherwise(e))
        return F.when(F.get(x, s["i"]).bitwiseAND(s["q"]) != 0, flip).otherwise(swap)

    def gray(x):
        # running XOR over the axes, in place
        return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), x,
                           lambda a, i: F.transform(a, lambda e, j: F.when(j == i, e.bitwiseXOR(F.get(a, i - 1))).otherwise(e))) if n > 1 else x

    def carry(x):
        planes = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
        t = F.aggregate(planes, F.lit(0), lambda a, q: F.when(F.get(x, F.lit(n - 1)).bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        return bind(t, lambda v: F.transform(x, lambda e: e.bitwiseXOR(v)))

    def interleave(x):
        at = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(at, F.lit(0).cast("long"),
                           lambda a, s: a * 2 + F.when(F.get(x, s["i"]).bitwiseAND(s["q"]) != 0, 1).otherwise(0))

    start = F.array(*[a.cast("int") for a in axes])
    undone = F.aggregate(steps, start, undo) if bits > 1 else start
    return bind(undone, lambda a: bind(gray(a), lambda b: bind(carry(b) if bits > 1 else b, interleave)))


def quantised(kind: str, c: Column, bits: int, span: tuple[float, float] = (0.0, 0.0)) -> Column:
    """``log``: equal bins of a size's logarithm over ``span``, its least and
    greatest value in the table; ``label``: a hash bin of a category (0 is null)."""
    cells = 1 << bits
    if kind == "log":
        low, high = (math.log2(max(x, 1)) for x in span)
        at = (F.log2(F.greatest(c, F.lit(1)).cast("double")) - low) * (cells / max(high - low, 1e-9))
        return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(at))), F.lit(0)).cast("int")
    return F.when(c.isNull(), F.lit(0)).otherwise(1 + F.crc32(c.cast("string").cast("binary")) % (cells - 1)).cast("int")


def spans(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each column, from one row of aggregates."""
    if not columns:
        return {}
    r = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))]).first()
    return {c: (r[f"low{i}"] or 0, r[f"high{i}"] or 0) for i, c in enumerate(columns)}


def shard_by_curve(df: DataFrame, dims: list[tuple[str, str]], order: list[str], shards: int = 8,
                   bits: int = BITS, name: str = "hilbert") -> DataFrame:
    """``df`` with ``curve`` (Hilbert index), ``shard`` and ``slot``.

    ``dims``: (column, ``log`` or ``label``); ``order``: columns that break
    ties on the curve.  Shard row counts differ by at most one.  Columns of
    ``df`` that have an output's name are replaced.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("curve", "shard", "slot", "_pid", "_mid")]
    span = spans(df, [c for c, k in dims if k == "log"])
    keyed = df.select(*kept, hilbert_index([quantised(k, F.col(c), bits, span.get(c, (0, 0))) for c, k in dims], bits).alias("curve"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(n, "curve", *order).sortWithinPartitions("curve", *order)
    # the id holds the partition above bit 33 and the gapless place in it below
    placed = stored(ranged.withColumn("_mid", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_at", F.col("_mid").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    # one row per partition: a list of that bound is summed up in one row
    totals = sizes.agg(F.sort_array(F.collect_list(F.struct("_pid", "_n"))).alias("_parts"))
    starts = totals.select(F.explode("_parts").alias("p"), "_parts").select(
        F.col("p._pid").alias("_pid"),
        F.aggregate(F.filter("_parts", lambda x: x["_pid"] < F.col("p._pid")), F.lit(0).cast("long"), lambda a, x: a + x["_n"]).alias("_start"),
        F.aggregate("_parts", F.lit(0).cast("long"), lambda a, x: a + x["_n"]).alias("_total"))
    ranked = placed.join(F.broadcast(starts), "_pid").withColumn("_rank", F.col("_start") + F.col("_at"))
    ranked = ranked.withColumn("shard", F.floor(F.col("_rank") * shards / F.col("_total")).cast("int"))
    ranked = ranked.withColumn("shard", F.when(F.col("_rank") * shards < F.col("shard") * F.col("_total"), F.col("shard") - 1)
                               .when(F.col("_rank") * shards >= (F.col("shard") + 1) * F.col("_total"), F.col("shard") + 1).otherwise(F.col("shard")).cast("int"))
    first = F.expr(f"(shard * _total + {shards} - 1) div {shards}")
    return ranked.select(*kept, "curve", "shard", (F.col("_rank") - first).cast("long").alias("slot"))


def op7_hilbert_sharding(spark, sf_dir) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard_by_curve(docs, [("source", "label"), ("size", "log"), ("lang", "label")], ["text_crc32", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


QUERIES = {"op7_hilbert_sharding": op7_hilbert_sharding}
ORACLE: dict[str, str] = {}
