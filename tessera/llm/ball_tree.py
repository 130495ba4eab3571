"""Exact ranked lexical search by sparse ball trees.

A document is a sparse vector over the terms that the queries hold: term
weight times saturated term frequency, in whole numbers.  A query is the vector
of its term counts, so a score is an inner product.

1. One pass over whole texts counts the queries' terms of each document and
   the document's length; document frequencies and the totals come from that.
2. The vectors are dealt by document length, so blocks hold like documents.
   For each block of ``BLOCK`` documents and each group of ``GROUP`` queries a
   ball tree is built over the group's terms: a node has a centroid, a radius
   and the terms that its documents hold; it is halved by the distances to two
   far members.
3. Each query walks the tree best-first.  With q cut to the node's terms,
   q.x <= q.c + |q| r bounds every document x below a node (centroid c, radius
   r).  Radius and bound are rounded up by more than the error of the double
   arithmetic, so a subtree is passed over only when its best score is surely
   below the query's ``k``-th best so far.  Leaves are scored in 64-bit integers.
4. Each task keeps ``k`` documents a query over all its blocks; the best of
   those are the result.

Queries are read in blocks of ``VOCABULARY`` terms; a worker holds one
block of vectors and its trees.  The documents are scanned once for each block
of queries.

Defined results: null, empty and term-less texts take no part (``N`` and ``L``
leave them out) and have score 0, as have documents without a query term; such
are not returned.  Equal scores are by ascending id, null ids first; repeated
documents each take a rank.  Repeated rows of the items are one item; rows of
one id with different texts are ranked each on its own.  Without documents or
items there are no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_texts, stored, table

K = 20
BLOCK, LEAF, GROUP = 4096, 32, 16
#: Most distinct terms of the queries that are searched at a time, and most vector entries of a block.
VOCABULARY, ENTRIES = 200_000, 2_000_000
#: Bytes of a text that are cut into terms at a time.
PIECE = 4_000_000
#: Rounding: relative widening of squared distances and of bounds, far above the error of sums of doubles.
SLACK = 1e-9

_DELIMITERS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(0x20 if b in _DELIMITERS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def term_counts(text: bytes | None) -> tuple[int, Counter]:
    """Number of terms and count of each; delimiters are all below 0x80, so bytes cut like code points."""
    found, n, at = Counter(), 0, 0
    while text and at < len(text):
        end = at + PIECE
        # a piece ends at a delimiter
        while end < len(text) and _FOLD[text[end]] != 0x20:
            end += 1
        terms = text[at:end].translate(_FOLD).split()
        n += len(terms)
        found.update(terms)
        at = end
    return n, found


class BallTree:
    """Ball tree over sparse rows (``indptr``, ``cols``, ``vals`` of at least
    one entry a row) in ``width`` dimensions.  ``order`` lists the rows so that
    a node is a run of it: node i holds ``order[first[i]:end[i]]``, its children
    are 2i+1 and 2i+2 where ``leaf[i]`` is false."""

    def __init__(self, indptr, cols, vals, width: int, leaf: int = LEAF):
        import numpy as np

        n = len(indptr) - 1
        lens = np.diff(indptr)
        row = np.repeat(np.arange(n), lens)
        x = vals.astype(np.float64)
        norm = np.bincount(row, x * x, n)
        order, place = np.arange(n), np.arange(n)
        self.first, self.end, self.leaf, self.centroid, self.radius, self.holds = {}, {}, {}, {}, {}, {}
        runs = [(0, 0, n)]

        def distance(points, square, node):
            """Squared distance of each row to its node's point, never below the true one by more than the slack."""
            at = np.maximum(node[row], 0)
            dot = np.bincount(row, x * points[at, cols] * (node[row] >= 0), n)
            d = np.maximum(norm - 2 * dot + square[np.maximum(node, 0)], 0)
            return d, SLACK * 1e-3 * (norm + square[np.maximum(node, 0)])

        while runs:
            node = np.full(n, -1)
            for j, (_, a, b) in enumerate(runs):
                node[order[a:b]] = j
            size = np.array([b - a for _, a, b in runs], float)
            live = node[row] >= 0
            key = node[row][live] * width + cols[live]
            cent = np.bincount(key, x[live], len(runs) * width).reshape(len(runs), width) / size[:, None]
            held = np.bincount(key, minlength=len(runs) * width).reshape(len(runs), width) > 0
            d, slack = distance(cent, (cent * cent).sum(1), node)
            reach = np.sqrt(d + slack)
            splits = []
            for j, (i, a, b) in enumerate(runs):
                rows = order[a:b]
                self.first[i], self.end[i], self.centroid[i], self.holds[i] = a, b, cent[j], held[j]
                self.radius[i] = float(reach[rows].max())
                self.leaf[i] = b - a <= leaf or self.radius[i] ** 2 <= 4 * SLACK * float(norm[rows].max())
                if not self.leaf[i]:
                    splits.append((j, i, a, b, rows[np.argmax(d[rows])]))
            if not splits:
                break

            def dense(rows):
                out = np.zeros((len(runs), width))  # noqa: B023
                for (j, *_), r in zip(splits, rows, strict=True):  # noqa: B023
                    out[j, cols[indptr[r]:indptr[r + 1]]] = x[indptr[r]:indptr[r + 1]]
                return out

            far = dense([s[4] for s in splits])
            da, _ = distance(far, (far * far).sum(1), node)
            other = dense([order[a:b][np.argmax(da[order[a:b]])] for _, _, a, b, _ in splits])
            db, _ = distance(other, (other * other).sum(1), node)
            runs = []
            for _, i, a, b, _ in splits:
                rows = order[a:b]
                order[a:b] = rows[np.argsort((da - db)[rows], kind="stable")]
                mid = (a + b) // 2
                runs += [(2 * i + 1, a, mid), (2 * i + 2, mid, b)]
        self.order, place[order] = order, np.arange(n)
        # entries in the order of the tree, so that a leaf is one slice
        at = np.argsort(place[row], kind="stable")
        self.cols, self.vals = cols[at], vals[at]
        self.indptr = np.concatenate([[0], np.cumsum(lens[order])])

    def bounds(self, queries):
        """Upper bounds of the inner products of rows below each node with each of the ``queries``: {node: array}."""
        import numpy as np

        ids = list(self.first)
        cent, held = np.array([self.centroid[i] for i in ids]), np.array([self.holds[i] for i in ids], float)
        radius = np.array([self.radius[i] for i in ids])
        top = cent @ queries.T + np.sqrt(held @ (queries * queries).T) * radius[:, None]
        return dict(zip(ids, top * (1 + SLACK) + 1, strict=True))

    def search(self, q, bound, worth, visit) -> int:
        """Best-first: ``visit(rows, scores)`` gets exact scores of leaves for
        the integer query ``q`` while ``worth(bound)`` holds; the number of rows scored."""
        import numpy as np

        heap, scored = [(-bound[0], 0)], 0
        while heap:
            top, i = heapq.heappop(heap)
            if not worth(-top):
                break
            if not self.leaf[i]:
                for c in (2 * i + 1, 2 * i + 2):
                    heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = self.first[i], self.end[i]
            s, e = self.indptr[a], self.indptr[b]
            scored += b - a
            visit(self.order[a:b], np.add.reduceat(self.vals[s:e] * q[self.cols[s:e]], self.indptr[a:b] - s))
        return scored


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and which of the vocabulary it holds how often."""
    def make():
        def work(texts):
            out = [[], [], []]
            for t in texts:
                n, found = term_counts(t)
                here = [(vocabulary[w], c) for w, c in found.items() if w in vocabulary]
                for to, v in zip(out, (n, [i for i, _ in here], [c for _, c in here]), strict=True):
                    to.append(v)
            return out
        return work

    return map_texts(docs.select("doc_id", F.col("text").cast("binary").alias("text")), "text", ["doc_id"],
                     "n bigint, terms array<int>, tfs array<bigint>", make)


def _search(vectors: DataFrame, queries: list[Counter], weight: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): each task's ``k`` best documents of each query; ``queries`` count term numbers."""
    common = [sorted(q, key=lambda t: (weight[t], t)) for q in queries]
    # queries that share their commonest terms share a tree
    ordered = sorted((i for i, q in enumerate(queries) if q), key=lambda i: common[i])
    groups = [ordered[a:a + GROUP] for a in range(0, len(ordered), GROUP)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = np.array(weight, dtype=np.int64)
        prepared = []
        for g in groups:
            dims = sorted({t for i in g for t in queries[i]})
            local = np.full(len(w), -1)
            local[dims] = np.arange(len(dims))
            q = np.zeros((len(g), len(dims)), dtype=np.int64)
            for r, i in enumerate(g):
                for t, c in queries[i].items():
                    q[r, local[t]] = c
            prepared.append((g, local, len(dims), q))
        best: dict[int, list] = {i: [] for i in ordered}

        def block(ids, n, indptr, terms, tfs):
            lens = np.diff(indptr)
            m = 75 + (25 * n * n_docs) // n_terms
            vals = w[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * np.repeat(m, lens)))
            row = np.repeat(np.arange(len(n)), lens)
            for g, local, width, q in prepared:
                here = (local[terms] >= 0) & (vals > 0)
                if not here.any():
                    continue
                rows, counts = np.unique(row[here], return_counts=True)
                tree = BallTree(np.concatenate([[0], np.cumsum(counts)]), local[terms[here]], vals[here], width)
                bound = tree.bounds(q.astype(np.float64))
                for r, i in enumerate(g):
                    top = best[i]

                    def worth(b, top=top):
                        return len(top) < k or b >= -top[-1][0]

                    def visit(found, scores, top=top, rows=rows):
                        if len(top) == k:
                            keep = scores >= -top[-1][0]
                            found, scores = found[keep], scores[keep]
                        some = scores > 0
                        top.extend((-int(s), ids[j] is not None, ids[j] or 0) for s, j in zip(scores[some], rows[found[some]], strict=True))
                        top.sort()
                        del top[k:]

                    tree.search(q[r], {x: b[r] for x, b in bound.items()}, worth, visit)

        for batch in batches:
            col = {c: batch.column(batch.schema.names.index(c)) for c in ("doc_id", "n", "terms", "tfs")}
            ids, n = col["doc_id"].to_pylist(), col["n"].to_numpy(zero_copy_only=False)
            offsets = col["terms"].offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            terms, tfs = (col[c].flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
            a = 0
            while a < len(ids):
                b = min(a + BLOCK, len(ids), max(a + 1, int(np.searchsorted(offsets, offsets[a] + ENTRIES, "right")) - 1))
                s, e = offsets[a], offsets[b]
                block(ids[a:b], n[a:b], offsets[a:b + 1] - s, terms[s:e], tfs[s:e])
                a = b
        out = [(i, d if has else None, -s) for i, top in best.items() for s, has, d in top]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], type=t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))],
                                         names=["query", "doc_id", "score"])

    ship_package(vectors.sparkSession)
    return vectors.mapInArrow(run, "query int, doc_id bigint, score bigint")


def _item_blocks(items: DataFrame):
    """Lists of (item_id, term counts), of about ``VOCABULARY`` distinct terms each."""
    block, seen = [], set()
    for r in items.select("item_id", F.col("text").cast("binary").alias("text")).distinct().orderBy("item_id", "text").toLocalIterator():
        _, found = term_counts(bytes(r.text) if r.text is not None else None)
        if block and len(seen | found.keys()) > VOCABULARY:
            yield block
            block, seen = [], set()
        block.append((r.item_id, found))
        seen |= found.keys()
    if block:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, name: str = "ball-tree") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    spark = docs.sparkSession
    parts = []
    for block in _item_blocks(items):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, found in block for t in found}))}
        vectors = stored(_vectors(docs, vocabulary), name)
        total = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # one row for each term of the queries
        df = {r.t: r.df for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        weight = [math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))]
        queries = [Counter({vocabulary[t]: c for t, c in found.items() if vocabulary[t] in df}) for _, found in block]
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = vectors.where(F.size("terms") > 0).repartitionByRange(n, "n", "doc_id").sortWithinPartitions("n")
        best = _search(dealt, queries, weight, total[0], max(1, total[1]), k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(block)], "query int, item_id bigint")
        parts.append(stored(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), f"{name}-best"))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for p in parts:
        out = out.unionByName(p)
    return out


def op12_ball_tree_search(spark, sf_dir) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
live AS (SELECT * FROM d WHERE len(t) > 0),
tot AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM live),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM live) GROUP BY rid, term),
it AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, tot),
m AS (SELECT rid, doc_id, 75 + (25 * len(t) * n_docs) // n_terms AS m FROM live, tot),
s AS (SELECT it.item_id, m.rid, m.doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM it JOIN tf ON tf.term = it.term JOIN w ON w.term = it.term JOIN m ON m.rid = tf.rid GROUP BY it.item_id, m.rid, m.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""

QUERIES = {"op12_ball_tree_search": op12_ball_tree_search}
ORACLE = {"op12_ball_tree_search": _SQL}
