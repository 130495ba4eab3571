"""Greedy, order-dependent selection inside a bounded group.

The reference walks rows in order and accepts a row unless it conflicts with
an already *accepted* row.  A skip changes later decisions, so this is not a
window function.  For groups whose size is bounded by a parameter (an
inspection cap, a candidate limit) the walk is an ``aggregate`` fold over the
group's rows sorted by the order key: it stays in the JVM and runs in
parallel over groups.  Unbounded groups use ``greedy_rounds`` instead.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def sorted_items(order_cols: list[str], cols: list[str]) -> Column:
    """array_sort(collect_list(struct(order..., cols...))): sort inside the
    array; collect_list order itself is not guaranteed."""
    return F.array_sort(F.collect_list(F.struct(*order_cols, *cols)))


def fold_select(items: Column, reject, limit: int | None) -> Column:
    """Walk ``items``; append x unless ``reject(acc, x)``; stop at ``limit``."""
    empty = F.filter(items, lambda x: F.lit(False))

    def step(acc, x):
        full = F.size(acc) >= limit if limit is not None else F.lit(False)
        return F.when(full | F.coalesce(reject(acc, x), F.lit(False)), acc) \
                .otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(items, empty, step)


def explode_selected(df: DataFrame, group_cols: list[str], arr: str,
                     pos_name: str = "pick") -> DataFrame:
    """One row per selected item, with its 1-based pick order."""
    x = df.select(*group_cols, F.posexplode(arr).alias("__p", "__item"))
    return x.select(*group_cols, (F.col("__p") + 1).cast("long").alias(pos_name), "__item.*")


# Largest group walked by the in-group fold; bigger groups use the rounds.
FOLD_MAX_GROUP = 20_000


def greedy_two_key(df: DataFrame, group: list[str], order: str, key1: str, key2: str,
                   limit: int | None = None, max_rounds: int | None = None,
                   checkpoint: bool = True, fold_max_group: int = FOLD_MAX_GROUP,
                   known_max_group: int | None = None) -> DataFrame:
    """First-come two-key selection (see ``greedy_two_key_rounds``).

    The input is written once to the checkpoint folder; its largest group
    size is then read from that table.  Both forms below give the same rows;
    the size only chooses the plan.  When every group is at most
    ``fold_max_group`` rows (or ``known_max_group`` says so, e.g. an
    inspection cap) the walk is a fold over each group's sorted rows;
    otherwise the exact round-based selection runs, which never collects a
    group.
    """
    if known_max_group is None:
        if checkpoint:
            df = materialize(df, "greedy-input")
        row = df.groupBy(*group).count().agg(F.max("count").alias("m")).collect()[0]
        known_max_group = row["m"] or 0
    if known_max_group <= fold_max_group:
        return greedy_two_key_fold(df, group, order, key1, key2, limit)
    return greedy_two_key_rounds(df, group, order, key1, key2, limit, max_rounds, checkpoint)


def greedy_two_key_fold(df: DataFrame, group: list[str], order: str, key1: str, key2: str,
                        limit: int | None = None) -> DataFrame:
    """The sequential walk as an ``aggregate`` fold per (bounded) group."""
    cols = [c for c in df.columns if c not in (*group, order, key1, key2)]
    g = df.groupBy(*group).agg(sorted_items([order, key1, key2], cols).alias("__items"))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    picked = g.select(*group, fold_select(
        F.col("__items"),
        lambda acc, x: F.exists(acc, lambda y: same(y[key1], x[key1]) | same(y[key2], x[key2])),
        limit).alias("__acc"))
    return explode_selected(picked, group, "__acc").drop("pick").select(*df.columns)


def greedy_two_key_rounds(df: DataFrame, group: list[str], order: str, key1: str, key2: str,
                          limit: int | None = None, max_rounds: int | None = None,
                          checkpoint: bool = True) -> DataFrame:
    """First-come selection where a row is rejected if an *accepted* row of
    its group shares ``key1`` or ``key2``; returns the accepted rows (at most
    ``limit`` per group, the earliest by ``order``).  Rows of one order value
    are walked by their keys; a null key is like no other.

    Exact for unbounded groups, with no per-group collection.  Rounds of
    the parallel greedy rule: a row is accepted when every earlier row it
    conflicts with is rejected; rejected when an accepted row conflicts.
    The result equals the sequential walk (the lexicographically first
    maximal independent set).  Each round is two partial aggregates keyed by
    (group, key) plus two joins back; exact copies of (group, key1, key2)
    are collapsed first, so a key holding a third of all rows costs one row
    per map task.  Lineage is cut every round by writing the state table to
    the checkpoint folder.
    """
    from pyspark.sql import Window

    g = list(group)
    place = F.struct(F.col(order).alias("o"), F.col(key1).alias("k1"), F.col(key2).alias("k2"))
    # Exact copies cannot both be accepted and fail together: keep the first.
    # Without keys there is nothing to share, so such rows are all accepted.
    w0 = Window.partitionBy(*g, key1, key2).orderBy(F.col(order))
    keyed = F.col(key1).isNotNull() | F.col(key2).isNotNull()
    rows = (df.filter(keyed).withColumn("__r0", F.row_number().over(w0)).filter("__r0 = 1").drop("__r0")
              .withColumn("__st", F.lit(0)))            # 0 undecided, 1 accepted, 2 rejected
    # every round decides the first undecided row of each group, so it ends
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        live = F.col("__st") != 2
        acc = F.col("__st") == 1

        def state_of(key, n):
            found = rows.filter(F.col(key).isNotNull()).groupBy(*g, key).agg(  # noqa: B023
                F.min(F.when(live, place)).alias(f"__m{n}"), F.max(acc).alias(f"__a{n}"))  # noqa: B023
            return found.select(*[F.col(c).alias(f"__g{n}_{i}") for i, c in enumerate(g)], F.col(key).alias(f"__k{n}"), f"__m{n}", f"__a{n}")

        j = rows
        for key, n in ((key1, 1), (key2, 2)):
            cond = F.col(key) == F.col(f"__k{n}")
            for i, c in enumerate(g):
                cond = cond & F.col(c).eqNullSafe(F.col(f"__g{n}_{i}"))
            j = j.join(state_of(key, n), cond, "left")
        first = lambda n: F.coalesce(F.col(f"__m{n}") == place, F.lit(True))
        hit = lambda n: F.coalesce(F.col(f"__a{n}"), F.lit(False))
        new_st = (F.when(F.col("__st") != 0, F.col("__st"))
                   .when(hit(1) | hit(2), F.lit(2))
                   .when(first(1) & first(2), F.lit(1))
                   .otherwise(F.lit(0)))
        rows = j.select(*df.columns, new_st.alias("__st"))
        rows = materialize(rows, "greedy-round") if checkpoint else rows.cache()
        if rows.filter(F.col("__st") == 0).limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"greedy_two_key did not converge in {max_rounds} rounds")
    out = rows.filter(F.col("__st") == 1).drop("__st").unionByName(df.filter(~keyed))
    if limit is not None:
        w = Window.partitionBy(*g).orderBy(place)
        out = out.withColumn("__rk", F.row_number().over(w)).filter(F.col("__rk") <= limit).drop("__rk")
    return out


def greedy_graph(nodes: DataFrame, edges: DataFrame, id_col: str = "id",
                 a: str = "id_a", b: str = "id_b", max_rounds: int | None = None) -> DataFrame:
    """Walk nodes by id; keep a node unless an edge joins it to a kept node.

    The result (the lexicographically first maximal independent set) is
    computed in rounds with no per-group collection: a node whose earlier
    neighbours are all dropped is kept, a node with a kept earlier neighbour
    is dropped.  Each round is one join of the edge list to the node states,
    a partial aggregate per node, and a join back; the state table is written
    to the checkpoint folder every round.  Returns the kept node ids.
    """
    st = nodes.select(F.col(id_col).alias("__id")).distinct().withColumn("__st", F.lit(0))
    e = edges.select(F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b")).filter("__a <> __b")
    e = materialize(e, "graph-edges")      # else every round would run the edges' plan again
    st = materialize(st, "graph-state")
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        sa = st.select(F.col("__id").alias("__a"), F.col("__st").alias("__sa"))
        per = (e.join(sa, "__a").groupBy("__b").agg(
            F.max((F.col("__sa") == 1).cast("int")).alias("__acc"),
            F.max((F.col("__sa") == 0).cast("int")).alias("__und"))
            .withColumnRenamed("__b", "__id"))
        j = st.join(per, "__id", "left")
        new = (F.when(F.col("__st") != 0, F.col("__st"))
                .when(F.coalesce(F.col("__acc"), F.lit(0)) == 1, F.lit(2))
                .when(F.coalesce(F.col("__und"), F.lit(0)) == 0, F.lit(1))
                .otherwise(F.lit(0)))
        st = materialize(j.select("__id", new.alias("__st")), "graph-state")
        if st.filter(F.col("__st") == 0).limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"greedy_graph did not converge in {max_rounds} rounds")
    return st.filter(F.col("__st") == 1).select(F.col("__id").alias(id_col))
