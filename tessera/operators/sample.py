"""Stratified sampling (M1, M3) and quantile bucketing (M2).

Sampling is a seeded hash order inside each group: ``row_number() over
(partition by key order by md5(id:seed), id) <= n``.  It is deterministic,
draws without replacement and gives exactly ``min(n, group size)`` rows.
Spark plans the ``<= n`` filter as a partial ``WindowGroupLimit`` before the
shuffle, so even a group holding a third of the table ships at most n rows
per map task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..session import materialize


class ShortGroupError(ValueError):
    pass


def _seed_order(id_col: str, seed: int):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def sample_per_group(df: DataFrame, key: str, n: int, id_col: str,
                     seed: int = L.SAMPLE_SEED, strict: bool = False) -> DataFrame:
    """Exactly n rows per non-null group (M1, strict) or at most n (M3).

    The sample is the n rows with the smallest seeded hash ``md5(id:seed)``
    (ties by id).  Small n: one ``row_number`` window, which Spark limits
    partially before the shuffle.  Large n (above Spark's window-group-limit
    threshold, where no partial limit is planned): ``_sample_bucketed``.
    """
    x = df.filter(F.col(key).isNotNull())
    if strict:
        # Lazy check, no extra pass: group sizes come from a partial
        # aggregate joined back on the key; a short group fails the job.
        sizes = x.groupBy(key).agg(F.count(F.lit(1)).alias("__gn"))
        msg = F.concat(F.lit("group "), F.col(key).cast("string"), F.lit(" has "),
                       F.col("__gn").cast("string"), F.lit(f" rows, fewer than {n}"))
        x = (x.join(sizes, key)
              .filter(F.when(F.col("__gn") < n, F.raise_error(msg)).otherwise(F.lit(True)))
              .drop("__gn"))
    limit_threshold = int(df.sparkSession.conf.get(
        "spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit_threshold:
        return _sample_bucketed(x, key, n, id_col, seed)
    w = Window.partitionBy(key).orderBy(_seed_order(id_col, seed), F.col(id_col))
    return (x.withColumn("__rn", F.row_number().over(w))
             .filter(F.col("__rn") <= n).drop("__rn"))


HASH_BUCKET_BITS = 20


def _sample_bucketed(x: DataFrame, key: str, n: int, id_col: str, seed: int) -> DataFrame:
    """The same n smallest-hash rows per group, with no task sorting a group.

    The 60-bit hash prefix is cut into 2^20 ranges.  Per (group, range)
    counts are a partial aggregate; a running sum over at most 2^20 ranges
    per group finds the range holding the n-th row.  Rows in earlier ranges
    are kept outright, rows in later ranges dropped, and only the rows of
    the cut range (about group size / 2^20) are ranked.  Even a group with a
    third of all rows is never sorted in one task.
    """
    md5 = _seed_order(id_col, seed)
    h = F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")
    y = x.withColumn("__md5", md5).withColumn("__b", F.shiftright(h, 60 - HASH_BUCKET_BITS))
    # The (group, range) counts are needed anyway: write them once, and when
    # no group exceeds n return the input untouched.
    counts = materialize(y.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__c")), "sample-counts")
    largest = counts.groupBy(key).agg(F.sum("__c").alias("t")).agg(F.max("t")).first()[0]
    if largest is None or largest <= n:
        return x
    wc = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("__cum", F.sum("__c").over(wc))
    cuts = (cum.filter((F.col("__cum") - F.col("__c") < n) & (F.col("__cum") >= n))
               .select(key, F.col("__b").alias("__cut"), (F.lit(n) - (F.col("__cum") - F.col("__c"))).alias("__left")))
    j = y.join(cuts, key, "left")
    keep_all = F.col("__cut").isNull() | (F.col("__b") < F.col("__cut"))
    whole = j.filter(keep_all)
    edge = j.filter(F.col("__b") == F.col("__cut"))
    we = Window.partitionBy(key).orderBy("__md5", F.col(id_col))
    edge = edge.withColumn("__rn", F.row_number().over(we)).filter(F.col("__rn") <= F.col("__left")).drop("__rn")
    cols = [c for c in x.columns]
    return whole.select(*cols).unionByName(edge.select(*cols))


def order_statistics(df: DataFrame, col: str, ranks: list[int], buckets: int = 1024,
                     final_rows: int = 100_000, max_rounds: int = 64,
                     stats: tuple | None = None) -> dict[int, float]:
    """Exact values at the given 0-based ranks of the non-null ``col``.

    Distributed and bounded.  Each round is one partial aggregate that, for
    every pending rank with interval [lo, hi], counts the rows below ``lo``
    and the rows in ``buckets`` equal-width sub-ranges of the interval (at
    most ranks x (buckets + 1) groups reach the driver).  The interval then
    shrinks to the bucket holding the rank plus one bucket on each side.  An
    interval holding one distinct value (a value repeated in a third of all
    rows ends here at once) gives the answer; one holding at most
    ``final_rows`` rows is read directly.  No task holds more than
    ``final_rows`` values.
    """
    x = df.select(F.col(col).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    xc = F.col("x")
    if stats is None:
        b = x.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        stats = (b["n"], b["lo"], b["hi"])
    n, lo0, hi0 = stats
    if not n:
        return {}
    state = {r: (float(lo0), float(hi0)) for r in sorted(set(ranks))}
    out: dict[int, float] = {}

    def read_finals(finals):
        # one pass for all ranks whose interval is small enough to read
        aggs = []
        for j, r in enumerate(finals):
            lo, hi = state[r]
            aggs += [F.count(F.when(xc < lo, 1)).alias(f"b{j}"),
                     F.collect_list(F.when((xc >= lo) & (xc <= hi), xc)).alias(f"v{j}")]
        got = x.agg(*aggs).first()
        for j, r in enumerate(finals):
            out[r] = float(sorted(got[f"v{j}"])[r - got[f"b{j}"]])

    if n <= final_rows:
        read_finals(list(state))
        return out
    for _ in range(max_rounds):
        pend = [r for r in state if r not in out]
        if not pend:
            break
        spec = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(state[r][0]).alias("lo"),
                                  F.lit(state[r][1]).alias("hi")) for i, r in enumerate(pend)])

        def tag(e):
            w = (e["hi"] - e["lo"]) / F.lit(float(buckets))
            inside = F.when(w == 0, F.lit(0)).otherwise(
                F.least(F.greatest(F.floor((xc - e["lo"]) / w), F.lit(0)), F.lit(buckets - 1)).cast("int"))
            return F.struct(e["i"].alias("i"), F.when(xc < e["lo"], F.lit(-1)).otherwise(inside).alias("b"))

        hits = F.transform(F.filter(spec, lambda e: xc <= e["hi"]), tag)
        rows = (x.select(xc, F.explode(hits).alias("h")).groupBy("h.i", "h.b")
                 .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"))
                 .collect())
        per: dict[int, dict[int, tuple]] = {}
        for row in rows:
            per.setdefault(row["i"], {})[row["b"]] = (row["n"], row["mn"], row["mx"])
        finals = []
        for i, r in enumerate(pend):
            lo, hi = state[r]
            cnt = per.get(i, {})
            below = cnt.get(-1, (0, None, None))[0]
            inner = [v for k, v in cnt.items() if k >= 0]
            total = sum(v[0] for v in inner)
            if not (below <= r < below + total):
                raise RuntimeError(f"rank {r} left its interval [{lo}, {hi}]")
            mn, mx = min(v[1] for v in inner), max(v[2] for v in inner)
            if mn == mx:
                out[r] = float(mn)
                continue
            if total <= final_rows:
                finals.append(r)
                continue
            w = (hi - lo) / buckets
            acc, bk = below, 0
            for bk in range(buckets):
                c = cnt.get(bk, (0,))[0]
                if acc + c > r:
                    break
                acc += c
            nlo = lo if bk <= 1 else lo + (bk - 1) * w
            nhi = hi if bk >= buckets - 2 else lo + (bk + 2) * w
            state[r] = (nlo, nhi)
        if finals:
            read_finals(finals)
    missing = [r for r in state if r not in out]
    if missing:
        raise RuntimeError(f"order statistics did not converge for ranks {missing}")
    return out


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float]:
    """Quantiles with linear interpolation (numpy/pandas 'linear', DuckDB
    quantile_cont) from exact order statistics."""
    xd = F.col(col).cast("double")
    b = df.filter(xd.isNotNull() & ~F.isnan(xd)).agg(
        F.count(F.lit(1)).alias("n"), F.min(xd).alias("lo"), F.max(xd).alias("hi")).first()
    n = b["n"]
    if n == 0:
        return []
    pos = [p * (n - 1) for p in probs]
    need = sorted({int(math.floor(p)) for p in pos} | {int(math.ceil(p)) for p in pos})
    v = order_statistics(df, col, need, stats=(n, b["lo"], b["hi"]))
    out = []
    for p in pos:
        lo, hi = v[int(math.floor(p))], v[int(math.ceil(p))]
        out.append(lo + (hi - lo) * (p - math.floor(p)))
    return out


def quantile_edges(df: DataFrame, col: str, q: int = L.JOKE_BUCKETS,
                   exact: bool = True, accuracy: int = 100000) -> list[float]:
    """Distinct bucket edges at quantiles 0, 1/q, ..., 1 (linear interpolation).

    ``exact`` computes exact order statistics with bounded memory per task;
    ``exact=False`` uses ``percentile_approx``.
    """
    probs = [i / q for i in range(q + 1)]
    if exact:
        edges = exact_quantiles(df, col, probs)
    else:
        arr = F.array(*[F.lit(p) for p in probs])
        row = df.filter(F.col(col).isNotNull()).agg(
            F.percentile_approx(F.col(col).cast("double"), arr, accuracy).alias("e")).collect()[0]
        edges = row["e"] or []
    out = []
    for e in edges:
        if not out or e != out[-1]:
            out.append(float(e))
    return out


def assign_bucket(df: DataFrame, col: str, edges: list[float], out: str = "bucket") -> DataFrame:
    """Bucket = index of the right-closed bin (first bin closed at both ends)."""
    if len(edges) < 2:
        return df.withColumn(out, F.lit(None).cast("int"))
    e = F.array(*[F.lit(float(v)) for v in edges])
    x = F.col(col).cast("double")
    b = F.greatest(F.size(F.filter(e, lambda v: v < x)) - 1, F.lit(0))
    return df.withColumn(out, F.when(x.isNull(), F.lit(None)).otherwise(b).cast("int"))


def quantile_buckets(df: DataFrame, col: str, q: int = L.JOKE_BUCKETS,
                     out: str = "bucket", exact: bool = True) -> DataFrame:   # M2
    """Edges need passes over ``df`` before the buckets are assigned, so the
    input is written once to the checkpoint folder and read back instead of
    recomputing its lineage (e.g. curation) on every pass."""
    df = materialize(df, "quantile-input")
    return assign_bucket(df, col, quantile_edges(df, col, q, exact), out)
