"""Profiling (P1-P8): every profile is one aggregate pass over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shape(df: DataFrame) -> DataFrame:                                   # P1
    cols = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), cols.alias("columns"))


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:             # P2
    return df.orderBy(F.col(key)).limit(n)


def column_profile(df: DataFrame) -> DataFrame:                          # P3
    """(position, column, dtype, non_null) per column, from one aggregate."""
    aggs = [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    dtypes = dict(df.dtypes)
    stack = ", ".join(f"{i}, '{c}', '{dtypes[c]}', c{i}" for i, c in enumerate(df.columns))
    return one.selectExpr(
        f"stack({len(df.columns)}, {stack}) as (position, column, dtype, non_null)")


def group_sizes(df: DataFrame, key: str, n: int | None = 5) -> DataFrame:  # P4
    g = (df.filter(F.col(key).isNotNull()).groupBy(key)
           .agg(F.count(F.lit(1)).alias("size")))
    return g.orderBy(key).limit(n) if n else g


def histogram(df: DataFrame, key: str) -> DataFrame:                     # P5
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
              .agg(F.count(F.lit(1)).alias("n")))


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:  # P6
    f = F.approx_count_distinct(col) if approx else F.countDistinct(col)
    return df.agg(f.alias("n_distinct"))


def seeded_peek(df: DataFrame, id_col: str, n: int = 10, seed: int = 42) -> DataFrame:  # P7
    """Deterministic 'random' n rows: top-n by md5(id:seed) (TakeOrderedAndProject)."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(h, F.col(id_col)).limit(n)


class StageCounts:                                                       # P8
    """Row counts after each stage of a pipeline, taken by the run itself.

    ``watch(name, df)`` is the identity with an observation; the pipeline
    passes it to its steps.  ``report`` is read after the one action that
    computes the result: there is no second pass.  An observation counts the
    rows of every task that succeeds, so stages above a retried task are
    counted as they were computed."""

    def __init__(self):
        self.stages: list[tuple[str, Observation]] = []

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        ob = Observation(f"{len(self.stages)}-{name}")
        self.stages.append((name, ob))
        return df.observe(ob, F.count(F.lit(1)).alias("rows"))

    def report(self, spark: SparkSession) -> DataFrame:
        """(stage_no, stage, n_rows); blocks until the watched result was computed."""
        rows = [(i, name, ob.get["rows"]) for i, (name, ob) in enumerate(self.stages)]
        return spark.createDataFrame(rows, "stage_no int, stage string, n_rows long")


def unwatched(name: str, df: DataFrame) -> DataFrame:
    """The ``watch`` of a run that nobody counts."""
    return df
