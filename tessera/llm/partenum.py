"""N-gram Jaccard join with PartEnum signatures.

A document's features are the 64-bit hashes of its distinct word shingles.
Sets of a size band that are similar enough differ in at most ``k`` features.
The feature domain (hash order) is cut into ``n1`` ranges of ``n2`` parts;
one of the ranges has at most ``k2`` differences, and some choice of
``n2 - k2`` of its parts has none, so two similar sets share the hash of that
choice: every choice of every range is a signature.  Features that recur most and choices
without a feature are left out in a way that loses no link (``signatures``).

1. Equal sets become one class; classes go on alone (pre-aggregation).
2. Signatures leave the scan in packed blocks, and each bucket of two or more
   classes links its members to the least one: candidates, not yet links.
3. Connected candidates form blocks.  Each candidate's set is sent once, to
   its block, where links are verified exactly: candidate pairs are those that
   share one of the rarest features of both (what is left out cannot reach the
   similarity) and are not connected yet.  Pairs never leave the task.
4. A block of over ``LIMIT`` features, say of documents that only share a
   passage, is cut again by its rarest features, and what is still larger is
   solved by pairs of chunks; links of chunks are connected afterwards.

Defined results: null and empty texts have empty sets, are their own component
and link with nothing; rows with one key are one node and repeated rows stay;
a null key has a null component; only the key, the set size and the component
are returned, with the columns asked for.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import components, map_texts, stored, table
from .shingles import K, mix, shingle_sets

PERCENT = 80
RATIO = 1.3
LEAST = 1
#: Most features that may be set aside as frequent (8 bytes each, sent to every task), and the least count.
FREQUENT = 65_536
FREQUENT_FROM = 16
WANTED = 3.0
LIMIT = 4_000_000


def bands(most: int, percent: int, ratio: float = RATIO) -> list[int]:
    """Upper sizes of the bands: each is the largest size that it holds."""
    out, top = [], 1
    while not out or out[-1] < most:
        out.append(top)
        top = max(top + 1, int(top * ratio))
    return out


def plan(low: int, top: int, percent: int) -> tuple[int, int, int, int] | None:
    """(n1, n2, k2, agreed) for sets of ``low`` to ``top`` features; None where only equal sets are similar.

    The cheapest scheme of which a signature has ``WANTED`` features at
    ``low``, or the one with the largest signatures.  ``agreed`` ranges at
    least have ``k2`` differences or fewer in a similar pair.
    """
    k = 2 * top * (100 - percent) // (100 + percent)
    if k == 0:
        return None
    best = None
    for k2 in range(0, min(k, 8) + 1):
        ranges = k // (k2 + 1)  # as many ranges can have more than k2 differences
        n1 = ranges + 1 if ranges == 0 else ranges + 1 + -(-ranges // 5)
        for n2 in range(k2 + 1, k2 + 7):
            cost, size = n1 * comb(n2, k2), low / n1 * (n2 - k2) / n2
            if cost > max(40, 0.6 * top):
                continue
            key = (size < WANTED, cost if size >= WANTED else -size, cost)
            if best is None or key < best[0]:
                best = (key, (n1, n2, k2, n1 - ranges))
    return best[1]


class Scheme:
    """Bands and their plans, made as sizes turn up."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.tops, self.plans = percent, bands(64, percent), {}

    def of(self, size: int) -> list[int]:
        """The bands a set takes part in: its own, and the next if a similar set may be in it."""
        while self.tops[-1] < size * 2:
            self.tops = bands(self.tops[-1] * 4, self.percent)
        own = int(np.searchsorted(self.tops, size))
        return [own] + [own + 1] * (size * 100 >= self.percent * (self.tops[own] + 1))

    def plan(self, band: int):
        if band not in self.plans:
            # sets that join from the band below are at least percent of this band's least
            least = self.tops[band - 1] + 1 if band else 1
            self.plans[band] = plan(max(1, least * self.percent // 100), self.tops[band], self.percent)
            if self.plans[band]:
                n2, k2 = self.plans[band][1:3]
                self.plans[band] += (np.array(list(combinations(range(n2), n2 - k2))),)
        return self.plans[band]


def signatures(features: np.ndarray, scheme: Scheme, frequent: np.ndarray) -> np.ndarray:
    """All signatures of one sorted set.

    Features in ``frequent`` are left out first: that takes no two sets
    further apart, so ``k`` still holds, and documents that only share a
    common passage no longer meet.  A range is unsafe if some choice of its
    parts has no feature left.  While a set has fewer unsafe ranges than a
    similar pair agrees on, one agreeing range is safe in both.  A set with
    more emits signatures of its whole set as well, so that two such meet.
    """
    rest = features
    if len(frequent):
        at = np.searchsorted(frequent, features)
        at[at == len(frequent)] = 0
        rest = features[frequent[at] != features]
    out = []
    for band in scheme.of(len(features)):
        p = scheme.plan(band)
        if p is None:
            continue
        made, small, unsafe = _choices(rest, p, band << 40)
        out.append(made[~small])
        if unsafe >= p[3]:
            made, small, unsafe = _choices(features, p, (1 << 60) | (band << 40))
            out.append(made.ravel() if unsafe >= p[3] else made[~small])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _choices(features: np.ndarray, p: tuple, salt: int):
    """Signature of every choice of every range, which of them hold too little, and the number of unsafe ranges."""
    n1, n2, _, _, choices = p
    cell = ((features >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)
    cut = np.searchsorted(cell, np.arange(n1 * n2 + 1, dtype=np.uint64))
    total = np.zeros(len(features) + 1, np.uint64)
    np.cumsum(weigh(features), out=total[1:], dtype=np.uint64)
    chosen = (total[cut[1:]] - total[cut[:-1]]).reshape(n1, n2)[:, choices].sum(axis=2, dtype=np.uint64)
    small = np.diff(cut).reshape(n1, n2)[:, choices].sum(axis=2) < LEAST
    label = (np.arange(chosen.size, dtype=np.uint64) + np.uint64(salt)).reshape(chosen.shape)
    return mix(chosen + mix(label + np.uint64(1))), small, int(small.any(axis=1).sum())


def class_of(features: np.ndarray, weights: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(mix(np.array([weights.sum(dtype=np.uint64) + np.uint64(len(features))]))[0].view(np.int64))


def weigh(features: np.ndarray) -> np.ndarray:
    return mix(features ^ np.uint64(0x9E3779B97F4A7C15))


def _facts(texts):
    """Set size and class per text; the first row of a slice also has the features that recur in it, and how often."""
    sets = shingle_sets(texts)
    names = [class_of(s, weigh(s)) if len(s) else None for s in sets]
    found, times = np.unique(np.concatenate(list(dict(zip(names, sets, strict=True)).values())), return_counts=True)
    found, times = found[times > 1].view(np.int64), times[times > 1]
    rest = [None] * (len(sets) - 1)
    return [[len(s) for s in sets], names, [found, *rest], [times, *rest]]


def _frequent(facts: DataFrame) -> np.ndarray:
    """Features that recur most over the slices of all texts: a bounded list
    that only saves work, results do not depend on it."""
    counted = facts.where(F.size("again") > 0).select(F.explode(F.arrays_zip("again", "times")).alias("x"))
    top = counted.groupBy("x.again").agg(F.sum("x.times").alias("c")).where(F.col("c") >= FREQUENT_FROM).orderBy(F.desc("c"), "again").limit(FREQUENT)
    return np.sort(np.array([r.again for r in top.select("again").collect()], np.int64).view(np.uint64))


SIG_BYTES = 5


def _packed(docs: DataFrame, text: str, percent: int, parts: int, frequent) -> DataFrame:
    """(bucket, count per class, classes, signatures): the signatures of a slice of texts for one of ``parts`` buckets."""
    def run(batches):
        import pyarrow as pa

        scheme = Scheme(percent)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= 4_000_000):
                    size += len(texts[stop] or "")
                    stop += 1
                made = {}
                for s in shingle_sets(texts[at:stop]):
                    if len(s):
                        c = class_of(s, weigh(s))
                        if c not in made:
                            made[c] = signatures(s, scheme, frequent.value)
                at = stop
                classes = np.array(list(made), np.int64)
                if not len(classes):
                    continue
                sig = np.concatenate(list(made.values()))
                own = np.repeat(np.arange(len(classes)), [len(x) for x in made.values()])
                part = (sig >> np.uint64(40)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                sig, own, part = sig[order], own[order], part[order]
                raw = np.ascontiguousarray(sig).view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]
                cuts = np.searchsorted(part, np.arange(parts + 1))
                rows = []
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    lo, hi = cuts[b], cuts[b + 1]
                    o = own[lo:hi]
                    heads = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                    rows.append((b, np.diff(np.r_[heads, len(o)]).astype(np.int32).tobytes(), classes[o[heads]].tobytes(), raw[lo:hi].tobytes()))
                cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                                 names=["bucket", "counts", "classes", "sigs"])

    ship_package(docs.sparkSession)
    return docs.select(text).mapInArrow(run, "bucket int, counts binary, classes binary, sigs binary")


def _stars(packed: DataFrame, parts: int) -> DataFrame:
    """Candidate pairs (a, b): each class of a signature's bucket with the bucket's least class."""
    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            for b, n, c, s in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                held.setdefault(b, []).append((n, c, s))
        for blocks in held.values():
            classes = np.concatenate([np.repeat(np.frombuffer(c, np.int64), np.frombuffer(n, np.int32)) for n, c, _ in blocks])
            raw = np.frombuffer(b"".join(s for _, _, s in blocks), np.uint8).reshape(-1, SIG_BYTES)
            sig = np.zeros(len(raw), np.uint64)
            for i in range(SIG_BYTES):
                sig |= raw[:, i].astype(np.uint64) << np.uint64(8 * i)
            blocks.clear()
            # only signatures that occur again, then by signature and class
            order = np.argsort(sig, kind="stable")
            sig, classes = sig[order], classes[order]
            same = sig[1:] == sig[:-1]
            again = np.r_[False, same] | np.r_[same, False]
            sig, classes = sig[again], classes[again]
            order = np.lexsort((classes, sig))
            sig, classes = sig[order], classes[order]
            head = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
            least = np.repeat(classes[head], np.diff(np.r_[head, len(sig)]))
            differ = least != classes
            pairs = np.unique(np.stack([least[differ], classes[differ]], axis=1), axis=0)
            for i in range(0, len(pairs), 100_000):
                p = np.ascontiguousarray(pairs[i:i + 100_000].T)
                yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

    return packed.repartition(parts, "bucket").mapInArrow(run, "a bigint, b bigint")


def _blocks(stars: DataFrame) -> DataFrame:
    """(class, block) of connected candidates.  A class goes with the least
    centre of its buckets, which its other centres are tied to: a list no
    longer than its signatures.  Only the centres are left to be connected."""
    members = stored(stars.groupBy("b").agg(F.min("a").alias("low"), F.collect_set("a").alias("centres")), "members")
    centres = stars.select("a").distinct()
    ties = members.select(F.col("low").alias("a"), F.explode("centres").alias("b")).union(
        members.select("low", "b").join(centres.withColumnRenamed("a", "b"), "b", "left_semi").select("low", "b"))
    labels = components(ties, "blocks")
    alone = members.select(F.col("b").alias("class"), "low").unionByName(centres.select(F.col("a").alias("class"), F.col("a").alias("low")))
    found = alone.join(labels.select(F.col("node").alias("low"), "label"), "low", "left")
    return found.groupBy("class").agg(F.min(F.coalesce("label", "low")).alias("block"))


def solve(names: list[int], keys: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """Per set the least key of those it is linked with, directly or through others of the block."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, token, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    starts = np.r_[0, np.cumsum(sizes)]
    # each set's rarest features: a similar pair shares one of them
    order = np.lexsort((token, freq[token], owner))
    place = np.arange(len(order)) - starts[owner]
    reach = sizes - -(-sizes * percent // 100) + 1
    rare = order[place < reach[owner[order]]]
    rare = rare[freq[token[rare]] > 1]
    by_token = rare[np.argsort(token[rare], kind="stable")]
    t, o = token[by_token], owner[by_token]
    heads = np.searchsorted(t, t, side="left")
    mine: dict[int, list[int]] = {}
    for i in range(len(t)):
        if i > heads[i]:
            mine.setdefault(int(o[i]), []).append(i)
    label = np.arange(n)
    flag = np.zeros(len(freq), bool)
    for x in sorted(mine):
        # earlier sets that share a rare feature, are of a fitting size and not connected yet
        near = np.unique(np.concatenate([o[heads[i]:i] for i in mine[x]]))
        near = near[(near != x) & (label[near] != label[x])]
        near = near[(100 * sizes[near] >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes[near])]
        if not len(near):
            continue
        flag[token[starts[x]:starts[x + 1]]] = True
        for part in np.array_split(near, max(1, int(sizes[near].sum() // 2_000_000))):
            lengths = sizes[part]
            at = np.repeat(starts[part] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            both = np.add.reduceat(flag[token[at]].astype(np.int64), np.r_[0, np.cumsum(lengths)[:-1]])
            linked = part[100 * both >= percent * (lengths + sizes[x] - both)]
            for root in np.unique(label[linked]).tolist():
                if root != label[x]:
                    label[label == root] = label[x]
        flag[token[starts[x]:starts[x + 1]]] = False
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, np.array(keys, np.int64))
    return least[label].tolist()


def _solve_blocks(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """(class, key, low): rows (block, class, key, features) are sorted by block, one block is held at a time."""
    def run(batches):
        import pyarrow as pa

        def done(held):
            names, keys = [h[0] for h in held], [h[1] for h in held]
            low = solve(names, keys, [np.frombuffer(h[2], np.uint64) for h in held], percent)
            linked = [(a, k, x) for a, k, x in zip(names, keys, low, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*linked, strict=True)], names=["class", "key", "low"])

        block, held = None, []
        for batch in batches:
            for b, c, k, f in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if b != block and held:
                    yield done(held)
                    held = []
                block = b
                held.append((c, k, f))
        if held:
            yield done(held)

    return rows.repartition(parts, "block").sortWithinPartitions("block", "class").mapInArrow(run, "class bigint, key bigint, low bigint")


def _cut_again(sets: DataFrame, percent: int, limit: int, parts: int) -> DataFrame:
    """Rows of blocks that are too large, with finer blocks: sets that share
    none of the rarest features of both are not similar.  What is still too
    large is dealt to pairs of chunks."""
    def features_of(batches):
        import pyarrow as pa

        for batch in batches:
            for c, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = np.frombuffer(f, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), c)), pa.array(f)], names=["class", "f"])

    feats = sets.select("class", "features").mapInArrow(features_of, "class bigint, f bigint")
    freq = feats.groupBy("f").agg(F.count("*").alias("df")).where("df > 1")
    # features of one set only come first in its order, and no other set has them
    shared = feats.join(freq, "f").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "f"))).alias("fs"))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - (F.col("n") - F.size("fs"))
    rare = shared.join(sets.select("class", "n"), "class").select("class", F.explode(F.slice("fs", F.lit(1), F.greatest(reach, F.lit(0)))).alias("x")).select("class", "x.f")
    stars = rare.join(rare.groupBy("f").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z"), "f").where("class <> a")
    labels = components(stars.select("a", F.col("class").alias("b")).distinct(), "recut")
    cut = sets.join(labels.withColumnRenamed("node", "class"), "class").drop("block")
    chunks = cut.groupBy("label").agg(F.ceil(F.sum("n") * 2 / limit).cast("int").alias("m"))
    mine = F.pmod(F.xxhash64("class"), F.col("m")).cast("int")
    cut = cut.join(chunks, "label").withColumn("i", mine).withColumn("m", F.when(F.col("m") <= 2, 1).otherwise(F.col("m")))
    cut = cut.withColumn("i", F.pmod("i", "m"))
    dealt = cut.select("class", "key", "features", "label", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    return dealt.select(F.xxhash64("label", F.least("i", "j"), F.greatest("i", "j")).alias("block"), "class", "key", "features")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, limit: int = LIMIT) -> DataFrame:
    """(key, n_shingles, component_id) per row of ``docs``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    facts = stored(map_texts(rows, "text", ["key"], "n bigint, class bigint, again array<bigint>, times array<bigint>", lambda: _facts), "sets")
    frequent = spark.sparkContext.broadcast(_frequent(facts))
    facts = facts.select("key", "n", "class")
    # a key with several texts joins their classes
    classes = facts.where("n > 0 and key is not null").groupBy("class").agg(F.min("key").alias("low"))
    stars = stored(_stars(_packed(rows.where("key is not null"), "text", percent, parts, frequent), parts).distinct(), "stars")
    blocks = _blocks(stars)
    chosen = blocks.join(classes, "class").select("class", "block", F.col("low").alias("key"))
    # the least key may have other texts too: its class tells which one is meant
    texts = rows.join(chosen.hint("shuffle_hash"), "key").select("key", "class", "block", "text")
    features = map_texts(texts, "text", ["key", "class", "block"], "n int, own bigint, features binary", lambda: _features)
    sets = stored(features.where("own = class").dropDuplicates(["class"]).select("class", "block", "key", "n", "features"), "features")
    sizes = sets.groupBy("block").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    large = stored(sizes.where(F.col("total") > limit).select("block"), "large")
    if large.limit(1).count():
        small, big = sets.join(large, "block", "left_anti"), sets.join(large, "block", "left_semi")
        work = small.select("block", "class", "key", "features").union(_cut_again(big, percent, limit, parts))
    else:
        work = sets.select("block", "class", "key", "features")
    solved = stored(_solve_blocks(work, percent, parts), "solved")
    links = solved.select(F.col("key").alias("a"), F.col("low").alias("b")).where("a <> b")
    several = facts.where("n > 0 and key is not null").select("key", "class").distinct().groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    own = facts.where("n > 0").join(several, "key", "left_semi").join(classes, "class").select(F.col("key").alias("a"), F.col("low").alias("b")).where("a <> b")
    if large.limit(1).count() or own.limit(1).count():
        roots = components(links.union(own), "linked")
        linked = classes.join(roots, classes.low == roots.node).select("class", F.col("label").alias("root"))
    else:
        linked = solved.select("class", F.col("low").alias("root")).where("key <> root")
    found = classes.join(linked, "class", "left").select("class", F.coalesce("root", "low").alias("root"))
    out = facts.join(found, "class", "left")
    # a key all of whose texts have words is in one component; one without words is its own
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("key").isNull(), F.lit(None)).otherwise(F.coalesce("root", "key")).cast("bigint").alias("component_id"))


def _features(texts):
    sets = shingle_sets(texts)
    return [[len(s) for s in sets], [class_of(s, weigh(s)) if len(s) else None for s in sets], [s.tobytes() for s in sets]]


def op3_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


#: Small fixtures only: DuckDB would compare all pairs that share a shingle.
ORACLE: dict[str, str] = {}
QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
assert K == 5
