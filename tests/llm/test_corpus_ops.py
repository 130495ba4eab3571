"""Jaccard join, suffix-array dedup, sharding, WARC and the pipeline."""

import base64
import collections
import hashlib
import random
import re

import corpus_pipeline
import fixtures as X
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, hilbert, partenum, suffix, warc
from tessera.llm.shingles import shingle_sets


def plain_sets(rows):
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_components(sets):
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and label[a] != label[b] and min(len(sets[a]), len(sets[b])) * 5 >= 4 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    old, new = label[b], label[a]
                    label = {d: new if x == old else x for d, x in label.items()}
    least = {}
    for d, x in label.items():
        least[x] = min(least.get(x, d), d)
    return {d: least[x] for d, x in label.items()}


def family(n=120):
    """Near copies of a few texts, with edits that bring pairs to both sides of the bound."""
    random.seed(9)
    bases = [[f"b{k}w{i}" for i in range(m)] for k, m in enumerate((12, 30, 60, 150, 400))]
    rows = []
    for d in range(n):
        w = list(random.choice(bases))
        for _ in range(random.randint(0, max(1, len(w) // 40))):
            w[random.randrange(len(w))] = f"e{random.randrange(10 ** 6)}"
        rows.append((d, " ".join(w[:len(w) - random.choice([0, 0, 1, 3])])))
    return rows


@pytest.mark.parametrize("limit", [partenum.LIMIT, 2000])
def test_jaccard_brute_force(spark, limit):
    rows = family()
    want = plain_components(plain_sets(rows))
    out = partenum.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit)
    assert {r.doc_id: r.component_id for r in out.collect()} == want
    assert len(set(want.values())) > 5


def test_jaccard_query(spark):
    sets = plain_sets(X.texts(spark))
    want = plain_components(sets)
    got = partenum.op3_ngram_jaccard_join(spark, X.SF001).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(d, len(s), want[d]) for d, s in sets.items()}


def test_jaccard_edges(spark):
    out = partenum.similar_components(X.documents(spark, ["n_shingles", "class", "key"])).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert len(out) == len(X.ROWS) and got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3)
    assert got[4] == (1, 4) and got[13] == (1, 4) and got[None] == (1, None) and got[5][1] == got[6][1] == 5
    assert partenum.similar_components(X.empty(spark)).count() == 0


def test_similar_pairs_share_a_signature():
    """For random pairs at the bound, of every size: with and without frequent features."""
    rng = np.random.default_rng(3)
    scheme = partenum.Scheme()
    for n in [5, 6, 7, 9, 10, 13, 18, 25, 40, 77, 160, 333, 700]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, n // 9 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or (a.tobytes() == b.tobytes()):
                continue
            for frequent in (a[:0], np.sort(rng.permutation(a)[:n // 2]), a):
                assert len(np.intersect1d(partenum.signatures(a, scheme, frequent), partenum.signatures(b, scheme, frequent)))


def test_shingles_ignore_space_and_case():
    sets = shingle_sets(["A b\tC  d e f", "a B c d\n\nE f ", None, "", "É b", "é b"])
    assert (sets[0] == sets[1]).all() and len(sets[0]) == 2 and len(sets[2]) == len(sets[3]) == 0 and sets[4][0] != sets[5][0]


def test_components_of_a_chain(spark):
    ids = list(range(60))
    random.seed(1)
    random.shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:], strict=False)] + [(100, 101), (101, 100), (102, 102)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in ids) and got[100] == got[101] == 100


def test_components_of_long_paths(spark):
    """Ascending ids, which a merge by id shortens by one edge a round; the least id may stand anywhere."""
    up = [(i, i + 1) for i in range(1000, 1400)]
    bent = [(5000 + i, 5001 + i) for i in range(200)] + [(5200, 7), (7, 5300)] + [(5300 + i, 5301 + i) for i in range(50)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(up + bent, "a long, b long")).collect()}
    assert got == {i: 1000 for i in range(1000, 1401)} | {i: 7 for i in [7, *range(5000, 5201), *range(5300, 5351)]}


def test_jaccard_of_versions(spark):
    """Each version is alike to its neighbours only, and the block is dealt to chunks."""
    rows = [(d, " ".join(f"w{i}" for i in range(3 * d, 3 * d + 50))) for d in range(500)]
    out = partenum.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), limit=9_000)
    assert {r.doc_id: r.component_id for r in out.collect()} == {d: 0 for d in range(500)}


def plain_removed(rows, length):
    seen = collections.Counter(t[i:i + length] for _, t in rows for i in range(len(t) - length + 1))
    return [[any(seen[t[i:i + length]] > 1 for i in range(max(0, p - length + 1), min(p, len(t) - length) + 1)) for p in range(len(t))] for _, t in rows]


@pytest.mark.parametrize("length, chunk", [(8, 2_000_000), (8, 30), (40, 200)])
def test_suffix_brute_force(spark, length, chunk):
    random.seed(length + chunk)
    part = ["".join(random.choice("ab") for _ in range(random.randint(5, 60))) for _ in range(6)]
    rows = [(d, "".join(random.choice([*part, "x", "yz"]) for _ in range(random.randint(0, 6)))) for d in range(40)] + [(90, "a" * 300), (91, "c" * 30)]
    raw = [(d, t.encode()) for d, t in rows]
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, chunk=chunk).collect()
    got = {r.doc_id: r for r in out}
    for (d, t), gone in zip(raw, plain_removed(raw, length), strict=True):
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        assert bytes(got[d].kept) == kept and got[d].n_removed == sum(gone), d
        assert got[d].n_spans == sum(g and not h for g, h in zip(gone, [False, *gone], strict=False))


def test_two_stage_order():
    random.seed(3)
    for _ in range(200):
        al, n = random.choice([1, 2, 3, 26]), random.randint(1, 100)
        t = [random.randint(1, al) for _ in range(n)] + [0]
        order = suffix.two_stage_order(np.array(t, np.int32), 1000).tolist()
        assert order == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_edges_and_query(spark):
    out = suffix.remove_repeats(X.documents(spark, ["removed", "m", "text_hash", "key"]))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(X.ROWS) and rows[1].n_bytes == 0 and rows[5].n_removed == rows[5].n_bytes and rows[7].n_spans == 1
    assert rows[8].n_removed >= len(X.PASSAGE) and rows[4].n_removed == 0 and rows[1].m == "mine"
    assert suffix.remove_repeats(X.empty(spark)).count() == 0
    raw = [(d, (t or "").encode()) for d, t in X.texts(spark)]
    seen = collections.Counter(t[i:i + 400] for _, t in raw for i in range(len(t) - 399))
    got = {r.doc_id: r for r in suffix.op8_suffix_array_dedup(spark, X.SF001).collect()}
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i:i + 400]] > 1:
                gone[i:i + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (len(t), sum(gone), hashlib.sha256(kept).hexdigest())


def test_suffix_planted_passages(spark):
    """Passages of over 50 words in two documents each: they go from 400 bytes on, shorter ones stay whatever their words."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    fill = lambda: " ".join(word(6) for _ in range(200))
    rows, size = [], {}
    for i, (words, chars) in enumerate([(51, 5), (55, 6), (57, 6), (58, 6), (70, 6), (200, 4)] * 3):
        passage = " ".join(word(chars) for _ in range(words))
        for d in (2 * i, 2 * i + 1):
            rows.append((d, f"{fill()}\n{passage}\n{fill()}"))
            size[d] = len(passage) + 2  # the line ends around it recur too
    rows += [(1000 + i, fill()) for i in range(20)]
    assert sorted(set(size.values()))[:3] == [307, 386, 400]
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), outputs=("n_bytes", "n_removed"), carried=["doc_id"])
    got = {r.doc_id: r for r in out.collect()}
    assert {d: got[d].n_bytes for d, _ in rows} == {d: len(t) for d, t in rows}
    for d, _ in rows:
        # a letter beside the passage may happen to be equal in both documents
        assert got[d].n_removed == 0 if size.get(d, 0) < 398 else size[d] <= got[d].n_removed < size[d] + 8


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 3), (3, 2), (1, 3)])
def test_curve_visits_neighbours(spark, n, bits):
    cells = spark.range(1 << (n * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).cast("int").alias(f"x{i}") for i in range(n)])
    rows = sorted(cells.select(hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], bits).alias("h"), "*").collect())
    assert [r.h for r in rows] == list(range(len(rows)))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:], strict=True)) == 1 for p, q in zip(rows, rows[1:], strict=False))


def test_shards(spark):
    rows = hilbert.op7_hilbert_sharding(spark, X.SF001).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.law == "rows" and r.grown_shard is None
    text = dict(X.texts(spark))
    assert len(rows) == len(text) and max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(8))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert all(r.size == len(text[r.doc_id].encode()) + 1 for r in rows)
    ranges = sorted((min(r.curve for r in v), max(r.curve for r in v)) for v in by.values())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    plan = hilbert.op7_hilbert_sharding(spark, X.SF001)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    df = X.documents(spark, ["shard", "curve"]).withColumn("size", F.length("text"))
    out = hilbert.shard_by_curve(df, [("source", "label"), ("size", "log"), ("lang", "label")], ["doc_id"], shards=4).collect()
    assert len(out) == len(X.ROWS) and sorted(collections.Counter(r.shard for r in out).values()) == [3, 4, 4, 4]
    assert hilbert.shard_by_curve(X.empty(spark), [("source", "label")], ["doc_id"]).count() == 0


def test_arc_versions_and_errors():
    for version in "12":
        arc = warc.ArcWriter("x.arc", version)
        arc.add("http://a/b c", "20240102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\n", b"one\n\nURL 1 2 3 4\n")
        arc.add("http://e/", "2024", "text/plain", b"", b"")
        got = list(warc.arc_records(arc.content()))
        assert [g[2] for g in got] == [b"HTTP/1.1 200 OK\r\n\r\none\n\nURL 1 2 3 4\n", b""] and got[0][1]["URL"] == "http://a/b%20c"
        assert len(got[0][1]) == len(warc.ARC_FIELDS[version])
        with pytest.raises(ValueError):
            list(warc.arc_records(arc.content()[:-30]))


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é</p>", None, "", "x" * 300_000, "<p>é</p>", "WARC/1.0\r\n\r\n\r\n\r\nnot a record", "<p>é</p>", "<p>é</p>"]
    rows = [(i if i != 6 else None, f"http://h/{i} \n" if i % 2 else None, h, "mine") for i, h in enumerate(html)] + [(0, "http://h/0", html[0], "mine")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op10_arc_to_warc(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        h = next((x[2] or "").encode() for x in rows if x[0] == r.page_id)
        assert r.payload_bytes == len(h) and r.payload_digest == base64.b32encode(hashlib.sha1(h).digest()).decode()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == {(0, "response", None): 1, (0, "revisit", 0): 1, (4, "revisit", 0): 1, (7, "revisit", 0): 1, (None, "revisit", 0): 1,
                     (1, "response", None): 1, (2, "revisit", 1): 1, (3, "response", None): 1, (5, "response", None): 1}
    spark.createDataFrame([], pages.schema).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert warc.op10_arc_to_warc(spark, f"{tmp_path}/none").count() == 0


def test_warc_hot_payload_and_large_pages(spark, tmp_path, monkeypatch):
    """Most pages hold one payload: their revisits lie in many parts, responses are not joined; files of large pages are read record by record."""
    hot = [(i, f"http://h/{i}", "the same page") for i in range(3, 300)]
    large = [(i, f"http://h/{i}", f"{i}" + "y" * 3_000_000) for i in range(3)]
    pages = spark.createDataFrame(hot + large, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op10_arc_to_warc(spark, str(tmp_path))
    rows = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got.collect()}
    assert rows == {i: ("response", None, len(h)) if i <= 3 else ("revisit", 3, len(h)) for i, _, h in hot + large}
    back = got.select(F.col("page_id").cast("string").alias("record_id"), "record_type", "page_id", F.col("refers_to").cast("string").alias("refers_to"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        parts = warc.referred_pages(back).where("refers_to = 3").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r[1] for r in parts) == 296 and len(parts) == 4 and max(r[1] for r in parts) < 200


def test_pipeline_against_plain_code(spark):
    """The rows that plain code keeps, stage by stage, on the smallest tables."""
    docs = corpus_pipeline.table(spark, X.SF001, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.stored(stage(spark, docs, X.SF001), f"t-{name}")
        assert docs.columns == before.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "line_dedup":
            lines = X.plain_kept_lines(kept["quality"].items())
            assert kept[name] == {d: t for d, (t, _) in lines.items() if t.strip(X.BLANKS)}
        if name == "near_duplicates":
            want = plain_components(plain_sets(kept["line_dedup"].items()))
            assert set(kept[name]) == {d for d, c in want.items() if c == d}
        if name == "decontaminate":
            windows = set()
            for r in corpus_pipeline.table(spark, X.SF001, "benchmark").collect():
                w = corpus_pipeline.decontam.normalised(r.text)
                windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))}
            for d, t in kept["near_duplicates"].items():
                w = corpus_pipeline.decontam.normalised(t)
                if any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9)):
                    assert kept[name].get(d) != t
                else:
                    assert kept[name][d] == t
    last = corpus_pipeline.STAGES[-1][1](spark, docs, X.SF001).collect()
    run = corpus_pipeline.run(spark, X.SF001).collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, run)) and len(run) == len(kept["decontaminate"])
    assert names == ["quality", "line_dedup", "near_duplicates", "decontaminate", "tokenize"]


def test_pipeline_edges(spark):
    for docs in (X.documents(spark, ["kept", "items", "_row", "n_words"]), X.empty(spark)):
        left = {}
        for name, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, X.SF001), f"e-{name}")
            left[name] = sorted(r.doc_id for r in docs.collect())
        assert docs.columns[0] == "doc_id" and set(left["tokenize"]) <= set(left["decontaminate"]) <= set(left["quality"])
        assert not {1, 2, 3, 4, 7} & {*left["quality"]}  # null, empty, blank, short and one-word texts fail the rules
    many = spark.createDataFrame([(i, " ".join(f"the of to w{i}x{j % 60}" for j in range(40)), "en", "s", 1) for i in range(5)] * 2, X.SCHEMA)
    out = corpus_pipeline.drop_near_duplicates(spark, many, X.SF001)
    assert sorted(r.doc_id for r in out.collect()) == list(range(5))
