"""Closed syncmers, ball-tree search and the Merkle manifest."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import fixtures as X
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ball_tree, hilbert, merkle, syncmers

# ---------------------------------------------------------------------------
# Closed syncmers
# ---------------------------------------------------------------------------

ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
PIECE = regex.compile(rf"[{ALONE}]|[[\p{{L}}\p{{M}}\p{{N}}]--[{ALONE}]]{{1,48}}|[^\p{{L}}\p{{M}}\p{{N}}]{{1,48}}", regex.V1)


def plain_tokens(text):
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        out += [w] if len(w.encode()) <= 48 else PIECE.findall(w)
    return out


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def xx(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True), seed=h)
    return signed(h)


def plain_syncmers(text):
    t = [w.encode() for w in plain_tokens(text)]
    if not t:
        return []
    if len(t) < 5:
        return [(0, xx(*t) & 0xFFFFFFFF)]
    out = []
    for p in range(len(t) - 4):
        s = [xx(t[p + j], t[p + j + 1]) for j in range(4)]
        if min(s) in (s[0], s[3]):
            out.append((p, xx(s[0], s[2], s[3]) & 0xFFFFFFFF))
    return out


def plain_print(found):
    out, last = "", 0
    for p, c in found:
        out += f"{p - last:x}{c:08x}"
        last = p
    return out


def plain_likeness(a, b):
    a, b = {c for _, c in a}, {c for _, c in b}
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def plain_edits(rows):
    """In ascending id, null first; equal ids by hash of the text."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, xx(r[1].encode())))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        e = t[:len(t) - cut] + nxt[:cut]
        own, edit, then = plain_syncmers(t), plain_syncmers(e), plain_syncmers(nxt)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_print(own), plain_print(edit),
                    plain_likeness(own, edit), plain_likeness(own, then)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edits(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_syncmers_brute_force(spark):
    got = syncmers.op11_closed_syncmers(spark, X.SF001)
    assert got.columns == COLUMNS
    assert edits(got) == plain_edits(X.texts(spark))


def test_syncmers_edges(spark):
    odd = [(20, "中文没有空格的很长的一句话需要切开成单个的字。" * 3), (21, "𝒳𝒴 " * 40), (22, "word"), (23, "a b c d"), (24, "a b c d e"),
           (25, "same " * 300), (26, "x" * 500), (27, "<<>>" * 60 + " end")]
    rows = [(r[0], r[1]) for r in X.ROWS] + odd
    df = X.documents(spark, clash=("_bucket", "_key", "fingerprint", "n_chars2")).select("doc_id", "text", "_bucket", "_key", "fingerprint")
    df = df.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    assert edits(syncmers.fingerprint_edits(df)) == plain_edits(rows)
    assert syncmers.fingerprint_edits(X.empty(spark)).count() == 0
    one = syncmers.fingerprint_edits(spark.createDataFrame([(1, "alone in the table with six words")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_syncmers_are_context_free(spark):
    """A passage has the same anchors in any surroundings, and gaps stay below K - S + 1."""
    random.seed(1)
    passage = " ".join(f"p{random.randrange(10 ** 6)}" for _ in range(60))
    rows = [(i, " ".join(f"n{i}x{random.randrange(10 ** 6)}" for _ in range(i)) + " " + passage + " tail" * i) for i in range(0, 30, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("f", syncmers.syncmers(syncmers.tokens(F.col("text"))))
    inner = {c for _, c in plain_syncmers(passage)}
    for r in df.collect():
        assert inner <= {x.code for x in r.f}
        at = [x.pos for x in r.f]
        assert all(b - a <= syncmers.K - syncmers.S for a, b in zip(at, at[1:], strict=False))


def test_positional_matches(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "one two three " + passage), (2, "an other start of seven words is here " + passage + " and more")]
    fp = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", syncmers.encoded(syncmers.syncmers(syncmers.tokens(F.col("text")))).alias("fingerprint"))
    got = syncmers.positional_matches(spark.createDataFrame([(1, 2)], "a long, b long"), fp).collect()
    best = max(got, key=lambda r: r.n_anchors)
    assert best.shift == 5 and best.n_anchors >= 12 and best.first >= 3
    back = [(r.pos, int(r.code, 16)) for r in syncmers.anchors(fp, "doc_id", "fingerprint").where("doc_id = 1").orderBy("n").collect()]
    assert back == plain_syncmers(rows[0][1])


def test_syncmers_native():
    import inspect

    body = inspect.getsource(syncmers)
    assert not any(x in body for x in ("mapInArrow", "udf", "mapInPandas", "applyInPandas", ".rdd", "toPandas"))


# ---------------------------------------------------------------------------
# Ball-tree search
# ---------------------------------------------------------------------------

def plain_search(docs, items, k=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    docs = [(d, cut(t)) for d, t in docs]
    docs = [(d, len(w), Counter(w)) for d, w in docs if w]
    n_docs, n_terms, df = len(docs), sum(d[1] for d in docs), Counter(w for d in docs for w in d[2])
    out = []
    for i, t in items:
        scores = []
        for d, n, tf in docs:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in cut(t) if w in tf)
            if s:
                scores.append((-s, d is not None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def ranks(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_search_sql(spark):
    got, want = X.against_sql(spark, ball_tree.op12_ball_tree_search, ball_tree.ORACLE["op12_ball_tree_search"])
    assert got == want and got


def test_search_edges(spark):
    items = [(1, "One TWO line"), (2, None), (3, ""), (4, "nowhere_to_be-found zzzz"), (5, "shared3 shared4 shared3 w1x1"), (6, "é 中文 the"), (7, "!!")]
    docs = X.documents(spark, clash=("n", "terms", "score", "rank"))
    made = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("rank", F.lit("x"))
    got = ranks(ball_tree.ranked_search(docs, made))
    assert got == plain_search([(r[0], r[1]) for r in X.ROWS], items)
    assert ball_tree.ranked_search(X.empty(spark), made).count() == 0
    assert ball_tree.ranked_search(docs, made.limit(0)).count() == 0


def test_search_blocks_and_pieces(spark, monkeypatch):
    """Queries in several blocks, many small trees, texts cut into pieces: the result is the same."""
    rows, items = X.texts(spark), [(r.item_id, r.text) for r in spark.read.parquet(f"{X.SF001}/benchmark.parquet").collect()]
    for name, v in (("VOCABULARY", 150), ("BLOCK", 64), ("LEAF", 4), ("GROUP", 3), ("PIECE", 1000)):
        monkeypatch.setattr(ball_tree, name, v)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ranks(ball_tree.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string"), k=7))
    assert got == plain_search(rows, items, 7)


def sparse(dense):
    rows = [np.flatnonzero(r) for r in dense]
    return np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), np.concatenate([dense[i, r] for i, r in enumerate(rows)])


@pytest.mark.parametrize("seed", range(4))
def test_tree_bounds_hold_and_prune(seed):
    """No row's product is above the bound of any node over it, and clusters are passed over."""
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 10 ** 10, (12, 40)) * (rng.random((12, 40)) < 0.3)
    dense = centers[rng.integers(0, 12, 800)] + rng.integers(0, 10 ** 7, (800, 40)) * (rng.random((800, 40)) < 0.2)
    dense[:, 0] += 1
    dense[:200] = dense[0]  # a group of copies
    tree = ball_tree.BallTree(*sparse(dense), 40, leaf=16)
    queries = (rng.integers(0, 3, (6, 40)) * (rng.random((6, 40)) < 0.2)).astype(np.int64)
    bounds = tree.bounds(queries.astype(float))
    exact = dense @ queries.T
    for i, top in bounds.items():
        rows = tree.order[tree.first[i]:tree.end[i]]
        assert (exact[rows] <= top[None, :]).all()
    scored = 0
    for r, q in enumerate(queries):
        best = []

        def visit(rows, scores, r=r, best=best):
            assert (scores == exact[rows, r]).all()
            best.extend(scores.tolist())
            best.sort(reverse=True)
            del best[5:]

        scored += tree.search(q, {i: b[r] for i, b in bounds.items()}, lambda b, best=best: len(best) < 5 or b >= best[-1], visit)
        assert best == sorted(exact[:, r].tolist(), reverse=True)[:5]
    assert scored < 0.6 * 800 * len(queries)


def test_term_counts_long_text():
    text = ("Ab-c " * 50_000 + "é" * 30_000 + "_x9").encode()
    n, found = ball_tree.term_counts(text)
    assert (n, found[b"ab"], found[b"c"], found["é".encode() * 30_000], found[b"x9"]) == (100_002, 50_000, 50_000, 1, 1)
    assert ball_tree.term_counts(None) == (0, Counter()) and ball_tree.term_counts(b" -- ")[0] == 0


# ---------------------------------------------------------------------------
# Merkle manifest
# ---------------------------------------------------------------------------

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_tree(leaves):
    """Root, and for each leaf the list of (siblings before, siblings after) from the lowest level up."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i in range(len(leaves)):
            a = at[i]
            pair = level[a - a % 2:a - a % 2 + 2]
            paths[i].append((pair[:a % 2], pair[a % 2 + 1:]))
            at[i] = a // 2
        level = [sha("".join(level[j:j + 2])) for j in range(0, len(level), 2)]
    return level[0], paths


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified by the contract, whole trees in memory."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, g, s, n: sha("".join(map(show, (d, s, g, n, t))))
    groups = {}
    for d, t, g, s, n in rows:
        touched = d is not None and n is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups.setdefault(g, []).append((d is not None, d or 0, leaf(d, t, g, s, n), leaf(d, t, g, s, n + 1) if touched else None, d))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in names}
    root, over = plain_tree([trees[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for r, path in zip(sorted(groups[g], key=lambda r: r[:3]), trees[g][1], strict=True):
            path = path + over[k]
            node = r[3] or r[2]
            for before, after in path:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join(x for b, a in path for x in [*b, *a]))
            out.append((r[4], r[2], trees[g][0], root, proof, node, node == root))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert out.columns == NAMES
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_merkle_sql(spark):
    got, want = X.against_sql(spark, merkle.op13_merkle_manifest, merkle.ORACLE["op13_merkle_manifest"])
    assert got == want
    tampered = [r for r in got if zlib.crc32(str(r[0]).encode()) % 7 == 0]
    assert tampered and not any(r[6] for r in tampered)


@pytest.mark.parametrize("height", [1, 2, 3, 12])
def test_merkle_levels(spark, tmp_path, monkeypatch, height):
    """Runs of few leaves, so that several levels of block roots are appended: one group holds most rows."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "RUN", 1 << height)
    rows = [(i, f"text {i % 7}", "big" if i % 5 else f"g{i % 3}", "s", i) for i in range(83)] + X.ROWS
    assert manifest(spark, spark.createDataFrame(rows, X.SCHEMA), tmp_path) == plain_manifest(rows)


def test_merkle_edges(spark, tmp_path):
    got = manifest(spark, X.documents(spark, clash=("tree", "idx", "witness", "digest")), tmp_path / "a")
    assert got == plain_manifest(X.ROWS)
    assert manifest(spark, X.empty(spark), tmp_path / "b") == []
    one = [(5, "only", None, None, None)]
    assert manifest(spark, spark.createDataFrame(one, X.SCHEMA), tmp_path / "c") == plain_manifest(one)
    assert plain_manifest(one)[0][4] == sha("")


@pytest.mark.parametrize("cut", [0, 1, 5, 8, 16, 23])
def test_merkle_append(spark, monkeypatch, cut):
    """A manifest that grows has the witnesses of one built at once; complete runs are not read again."""
    monkeypatch.setattr(merkle, "HEIGHT", 3)
    monkeypatch.setattr(merkle, "RUN", 8)
    rows = [(i, f"g{int(i % 3 == 0)}", sha(str(i))) for i in range(40)] + [(99, "new", sha("n"))]
    df = spark.createDataFrame(rows, "doc_id long, tree string, digest string")
    whole = merkle.witnessed(merkle.first_level(df, ["doc_id"]))
    level = merkle.first_level(df.where(F.col("doc_id") < cut), ["doc_id"])
    grown = merkle.append(level, df.where(F.col("doc_id") >= cut), ["doc_id"])
    pick = lambda d: sorted((r.doc_id, r.subroot, r.root, r.witness, r.sides) for r in d.collect())
    assert pick(merkle.witnessed(grown)) == pick(whole)


def test_appender_partial_witnesses():
    """At any time each open subtree's leaves fold to its digest."""
    leaves, tree = [sha(str(i)) for i in range(21)], merkle.Appender()
    for n, leaf in enumerate(leaves):
        tree.append(leaf)
        assert [1 << h for h, *_ in tree.open] == [1 << b for b in range(5, -1, -1) if (n + 1) >> b & 1]
        for _, digest, first, end in tree.open:
            for i in range(first, end):
                node = leaves[i]
                for w, s in zip(tree.witness[i], tree.sides[i], strict=True):
                    node = sha(node + w if s == "r" else w + node)
                assert node == digest
    assert tree.close() == plain_tree(leaves)[0]


# ---------------------------------------------------------------------------
# Hilbert sharding: cells over the measured range, pruning of written files
# ---------------------------------------------------------------------------

def test_size_cells_span_the_measured_range(spark):
    """Long texts do not share one cell, wherever the range lies."""
    for low in (1, 1 << 16, 1 << 30):
        df = spark.createDataFrame([(low * (1 << k),) for k in range(8)], "size long")
        span = hilbert.spans(df, ["size"])["size"]
        cells = [r[0] for r in df.select(hilbert.quantised("log", F.col("size"), 5, span)).collect()]
        assert len(set(cells)) == 8 and min(cells) == 0 and max(cells) == 31
    one = spark.createDataFrame([(7,), (7,), (None,)], "size long")
    assert {r[0] for r in one.select(hilbert.quantised("log", F.col("size"), 5, hilbert.spans(one, ["size"])["size"])).collect()} == {0}


def test_curve_visits_every_cell_of_the_registered_grid(spark):
    """Three dimensions of five bits: the index is a bijection onto 0..32767 and neighbours differ by one step in one dimension."""
    grid = spark.range(32 ** 3).select((F.col("id") % 32).alias("x"), (F.floor(F.col("id") / 32) % 32).alias("y"), F.floor(F.col("id") / 1024).alias("z"))
    rows = grid.select(hilbert.hilbert_index([F.col(c) for c in "xyz"], hilbert.BITS).alias("h"), "x", "y", "z").collect()
    at = {r.h: (r.x, r.y, r.z) for r in rows}
    assert sorted(at) == list(range(32 ** 3))
    assert all(sum(abs(a - b) for a, b in zip(at[h], at[h + 1], strict=True)) == 1 for h in range(32 ** 3 - 1))


def test_written_shards_prune_by_size(spark, tmp_path):
    """Statistics of the written files leave out half of them or more for a narrow filter on the size, which is not the first dimension."""
    import pyarrow.parquet as pq

    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.xxhash64("id") % 16).cast("string")).alias("source"),
                                  F.pow(F.lit(2.0), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(18))).cast("long").alias("size"), F.lit("en").alias("lang"))
    out = hilbert.shard_by_curve(df, [("source", "label"), ("size", "log")], ["doc_id"], shards=16, name="prune")
    out.repartition("shard").write.partitionBy("shard").parquet(f"{tmp_path}/shards")
    files = list((tmp_path / "shards").rglob("*.parquet"))

    def kept(column, value):
        n = 0
        for f in files:
            meta = pq.ParquetFile(f)
            i = meta.schema_arrow.names.index(column)
            stats = [meta.metadata.row_group(g).column(i).statistics for g in range(meta.metadata.num_row_groups)]
            n += any(s.min <= value <= s.max for s in stats)
        return n

    assert len(files) == 16 and kept("size", 1) <= 8 and kept("size", 1 << 17) <= 8
