"""Merkle manifest of a dataset with a witness for every row.

A row's leaf is the SHA-256 of its length-prefixed fields.  Per group (here
the language) the leaves, in ascending id, are the lowest level of a binary
tree; a node that stands alone at its level is hashed alone; the group roots
are the leaves of one more tree, whose root names the dataset.

Witnesses grow with the tree (``Appender``).  Leaves are appended one by one;
the open subtrees are a stack, like the digits of a binary counter.  When a
subtree's later sibling is complete, the two become one, and every leaf of
either half gets the other half's digest as the next part of its witness.  So
a partial witness is always true for the subtree that its leaf stands in.

Distribution: a group's leaves are cut into aligned runs of ``RUN``; one task
appends one run at a time.  The run's root, with the run's place, is then
appended to the next level in the same way, until each group has one node;
then the group roots are ranked and appended.  Going back down, each level's
witnesses are extended by those of the node above.  A run has at most ``RUN``
rows, so a group that holds most of the table is many runs.  Ranks come from a
range sort and the row counts of its partitions, not from one task.

``append`` extends a manifest by later rows: only the last, open run of each
group is read again, complete runs and their partial witnesses stay.

Defined results: null fields are marked, so null and empty text differ; null
groups come first; null ids come first in their group; rows of one id are
ordered by leaf, so repeated rows are leaves of their own; an empty table has
no rows.  Names of further columns do not matter, only ``FIELDS`` are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import ship_package
from .common import stored, table

#: Levels that one task builds at a time, and leaves of such a run.
HEIGHT = 12
RUN = 1 << HEIGHT
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(columns[c]) for c in FIELDS]), 256)


def group_name(c: Column) -> Column:
    """A string that orders like ``c`` with null first and is never null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


class Appender:
    """Leaves of one aligned run and the witnesses of all of them."""

    def __init__(self):
        self.open: list[tuple[int, str, int, int]] = []  # (height, digest, first leaf, end), heights falling
        self.witness: list[list[str]] = []
        self.sides: list[list[str]] = []

    def append(self, digest: str) -> None:
        n = len(self.witness)
        self.witness.append([])
        self.sides.append([])
        self.open.append((0, digest, n, n + 1))
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._join()

    def _join(self) -> None:
        """The last two subtrees, of one height, become one; both halves' witnesses grow."""
        from hashlib import sha256

        h, right, mid, end = self.open.pop()
        _, left, first, _ = self.open.pop()
        for i in range(first, mid):
            self.witness[i].append(right)
            self.sides[i].append("r")
        for i in range(mid, end):
            self.witness[i].append(left)
            self.sides[i].append("l")
        self.open.append((h + 1, sha256((left + right).encode()).hexdigest(), first, end))

    def close(self, height: int | None = None) -> str:
        """Root of all leaves: the last open subtree, alone at its level, is
        hashed alone until its sibling's height is reached; with ``height`` the
        root is carried up to it in the same way."""
        from hashlib import sha256

        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            if len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
                self._join()
                continue
            h, digest, first, end = self.open.pop()
            for i in range(first, end):
                self.sides[i].append("-")
            self.open.append((h + 1, sha256(digest.encode()).hexdigest(), first, end))
        return self.open[0][1]


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with ``tree``) plus ``idx``, the place in its tree by
    ``order``, and ``size``, the tree's rows.  A range sort places the rows;
    what is counted per sort partition and tree gives where each starts."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = rows.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order)
    placed = stored(sort.withColumn("_mid", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_pid", F.shiftright("_mid", 33))
    parts = placed.groupBy("tree", "_pid").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    # one row for each partition and tree that meet, far fewer than the rows
    before = Window.partitionBy("tree").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                         F.sum("_n").over(Window.partitionBy("tree")).alias("size"))
    return placed.join(parts, ["tree", "_pid"]).withColumn("idx", F.col("_mid") - F.col("_first") + F.col("_start")).drop("_mid", "_pid", "_first", "_start")


def append_runs(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (``tree, idx, size, digest`` and others) with the witness of
    each in its run: ``witness`` (the siblings' digests, joined), ``sides`` (a
    letter for each level: the sibling is right, left, or there is none) and
    ``top``, the run's root."""
    spark = nodes.sparkSession
    ship_package(spark)
    names = nodes.columns
    dealt = nodes.withColumn("run", F.floor(F.col("idx") / RUN).cast("bigint")).repartition("tree", "run").sortWithinPartitions("tree", "run", "idx")
    schema = StructType([*dealt.schema.fields, *[StructField(c, StringType()) for c in ("witness", "sides", "top")]])

    def run(batches):
        import pyarrow as pa

        held, key, tree = [], None, Appender()

        def flush():
            several = held[0].column(held[0].schema.names.index("size"))[0].as_py() > RUN
            top = tree.close(HEIGHT if several else None)
            cols = pa.Table.from_batches(held).combine_chunks()
            made = [["".join(w) for w in tree.witness], ["".join(s) for s in tree.sides], [top] * cols.num_rows]
            for k, v in zip(("witness", "sides", "top"), made, strict=True):
                cols = cols.append_column(k, pa.array(v, type=pa.string()))
            yield from cols.to_batches()

        for batch in batches:
            at = {k: batch.column(batch.schema.names.index(k)) for k in ("tree", "run", "digest")}
            keys = list(zip(at["tree"].to_pylist(), at["run"].to_pylist(), strict=True))
            digests, start = at["digest"].to_pylist(), 0
            for i, k in enumerate(keys):
                if k != key:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield from flush()
                    held, key, tree, start = [], k, Appender(), i
                tree.append(digests[i])
            if len(keys) > start:
                held.append(batch.slice(start, len(keys) - start))
        if held:
            yield from flush()

    return stored(dealt.mapInArrow(run, schema).select(*names, "run", "witness", "sides", "top"), name)


def _above(level: DataFrame) -> DataFrame:
    """The runs of a level as nodes of the next one."""
    return level.where(F.col("idx") % RUN == 0).select("tree", F.col("run").alias("idx"), F.ceil(F.col("size") / RUN).cast("bigint").alias("size"),
                                                       F.col("top").alias("digest"))


def grow(level: DataFrame, name: str) -> list[DataFrame]:
    """``level`` and the levels above it, until every tree is one node."""
    levels = [level]
    while (levels[-1].agg(F.max("size")).first()[0] or 0) > RUN:
        levels.append(append_runs(_above(levels[-1]), f"{name}-{len(levels)}"))
    return levels


def _extended(level: DataFrame, above: DataFrame) -> DataFrame:
    """``level`` with its witnesses extended by those of ``above`` (tree, idx,
    witness, sides and what else is to be carried down).  A run has at most
    ``RUN`` rows, so no key of this join is hot."""
    more = [c for c in above.columns if c not in ("tree", "idx", "witness", "sides")]
    up = above.select("tree", F.col("idx").alias("run"), F.col("witness").alias("_w"), F.col("sides").alias("_s"), *more)
    out = level.join(up, ["tree", "run"])
    return out.withColumn("witness", F.concat("witness", "_w")).withColumn("sides", F.concat("sides", "_s")).drop("_w", "_s")


def fold(leaf: Column, witness: Column, sides: Column) -> Column:
    """Root recomputed from a leaf and its witness."""
    step = F.struct(leaf.alias("d"), F.lit(0).alias("at"))

    def up(a, side):
        other = F.substring(witness, a["at"] * 64 + 1, F.lit(64))
        both = F.when(side == "r", F.concat(a["d"], other)).when(side == "l", F.concat(other, a["d"])).otherwise(a["d"])
        return F.struct(F.sha2(both, 256).alias("d"), (a["at"] + F.when(side == "-", 0).otherwise(1)).alias("at"))

    return F.when(F.length(sides) == 0, leaf).otherwise(F.aggregate(F.split(sides, ""), step, up)["d"])


def first_level(rows: DataFrame, order: list[str], name: str = "merkle") -> DataFrame:
    """Leaves (``tree``, ``digest``, others) in the runs of their trees."""
    return append_runs(ranked(rows, [*order, "digest"], f"{name}-ranked"), f"{name}-0")


def witnessed(level: DataFrame, name: str = "merkle") -> DataFrame:
    """A ``first_level`` with whole witnesses up to the root of all trees, and ``subroot`` and ``root``."""
    levels = grow(level, name)
    roots = levels[-1].where("idx = 0").select("tree", F.col("top").alias("subroot"))
    # the trees are the leaves of the last tree
    top = append_runs(ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("_of"), F.col("subroot").alias("digest")), ["_of"], f"{name}-roots"), f"{name}-top-0")
    tops = grow(top, f"{name}-top")
    root = tops[-1].where("idx = 0").select("tree", F.lit(0).cast("bigint").alias("idx"), F.lit("").alias("witness"), F.lit("").alias("sides"), F.col("top").alias("root"))
    joined = reduce(lambda up, lv: _extended(lv, up.select("tree", "idx", "witness", "sides", "root")), reversed(tops), root)
    above = joined.select(F.col("_of").alias("tree"), F.lit(0).cast("bigint").alias("idx"), "witness", "sides", F.col("digest").alias("subroot"), "root")
    for lv in reversed(levels[1:]):
        above = _extended(lv, above).select("tree", "idx", "witness", "sides", "subroot", "root")
    return _extended(levels[0], above)


def append(level: DataFrame, rows: DataFrame, order: list[str], name: str = "merkle-append") -> DataFrame:
    """A ``first_level`` extended by ``rows`` that come after all of its own.
    Complete runs keep their rows and partial witnesses; the open last run of
    each tree is appended anew with the new rows."""
    carried = [c for c in level.columns if c not in ("run", "witness", "sides", "top")]
    sizes = level.groupBy("tree").agg(F.count("*").alias("_old"))
    new = ranked(rows, [*order, "digest"], f"{name}-ranked").withColumnRenamed("size", "_new")
    total = sizes.join(new.groupBy("tree").agg(F.count("*").alias("_added")), "tree", "full")
    total = total.select("tree", F.coalesce("_old", F.lit(0)).alias("_old"), (F.coalesce("_old", F.lit(0)) + F.coalesce("_added", F.lit(0))).alias("_size"))
    total = stored(total, f"{name}-sizes")  # one row for each tree
    small = F.broadcast(total) if total.count() <= 100_000 else total
    old = level.join(small, "tree").withColumn("size", F.col("_size"))
    # a complete run changes only when its tree had no more than that run
    whole = ((F.col("run") + 1) * RUN <= F.col("_old"))
    late = new.join(small, "tree").withColumn("idx", F.col("idx") + F.col("_old")).withColumn("size", F.col("_size"))
    again = old.where(~whole).select(*carried).unionByName(late.select(*carried))
    return stored(old.where(whole).select(*level.columns).unionByName(append_runs(again, f"{name}-open").select(*level.columns)), name)


def manifest(docs: DataFrame) -> DataFrame:
    """Leaves, group roots, root and whole witnesses of rows with ``tree``,
    ``digest``, ``doc_id`` and ``_absent`` (0 for a null id)."""
    return witnessed(first_level(docs, ["_absent", "doc_id"]))


def op13_merkle_manifest(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cols = {c: F.col(c) for c in FIELDS}
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = docs.select("doc_id", F.col("doc_id").isNotNull().cast("int").alias("_absent"), group_name(F.col("lang")).alias("tree"),
                       leaf_hash(cols).alias("digest"), F.when(touched, leaf_hash(cols | {"n_chars": F.col("n_chars") + 1})).alias("found"))
    out = manifest(rows).withColumn("folded_root", fold(F.coalesce("found", "digest"), F.col("witness"), F.col("sides")))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2("witness", 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') AS f1,
    coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS f2,
    coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS f3,
    coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') AS f3t,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS f4,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)),
      4294967295) % 7 = 0 AS touched
  FROM documents),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(f1 || f2 || f3 || f4) AS leaf,
    CASE WHEN touched THEN sha256(f1 || f2 || f3t || f4) ELSE sha256(f1 || f2 || f3 || f4) END AS found FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
up(tree, lvl, idx, digest) AS (
  SELECT tree, 0, idx, leaf FROM placed
  UNION ALL
  SELECT tree, lvl + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM
    (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM up) WHERE n > 1 GROUP BY tree, lvl, idx // 2),
last_lvl AS (SELECT tree, max(lvl) AS top FROM up GROUP BY tree),
subroots AS (SELECT u.tree, u.digest AS subroot, row_number() OVER (ORDER BY u.tree) - 1 AS idx FROM up u JOIN last_lvl l ON l.tree = u.tree AND l.top = u.lvl),
over(lvl, idx, digest) AS (
  SELECT 0, idx, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS n FROM over) WHERE n > 1 GROUP BY lvl, idx // 2),
rooted AS (SELECT digest AS root, lvl AS top FROM over ORDER BY lvl DESC LIMIT 1),
steps AS (
  SELECT p.tree, p.idx AS place, l.lvl, s.digest AS sib, (p.idx >> l.lvl) % 2 AS isright FROM placed p
    JOIN (SELECT DISTINCT tree, lvl FROM up) l ON l.tree = p.tree JOIN last_lvl t ON t.tree = p.tree AND l.lvl < t.top
    LEFT JOIN up s ON s.tree = p.tree AND s.lvl = l.lvl AND s.idx = xor(p.idx >> l.lvl, 1)
  UNION ALL
  SELECT p.tree, p.idx, 1000 + l.lvl, s.digest, (r.idx >> l.lvl) % 2 FROM placed p JOIN subroots r ON r.tree = p.tree
    JOIN (SELECT DISTINCT lvl FROM over) l ON l.lvl < (SELECT top FROM rooted)
    LEFT JOIN over s ON s.lvl = l.lvl AND s.idx = xor(r.idx >> l.lvl, 1)),
proofs AS (SELECT tree, place, coalesce(string_agg(sib, '' ORDER BY lvl), '') AS proof,
    list(CASE WHEN sib IS NULL THEN '-' WHEN isright = 1 THEN 'l' || sib ELSE 'r' || sib END ORDER BY lvl) AS path FROM steps GROUP BY tree, place),
done AS (
  SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(q.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(p.found, coalesce(q.path, [])), lambda a, b: sha256(CASE WHEN b = '-' THEN a WHEN b[1] = 'l' THEN b[2:] || a ELSE a || b[2:] END)) AS folded_root
  FROM placed p JOIN subroots s ON s.tree = p.tree CROSS JOIN rooted r LEFT JOIN proofs q ON q.tree = p.tree AND q.place = p.idx)
SELECT *, folded_root = root AS verified FROM done
"""

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLE = {"op13_merkle_manifest": _SQL}
