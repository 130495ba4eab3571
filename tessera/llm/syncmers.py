"""Document fingerprints from closed syncmers, with DataFrame functions only.

The alphabet is the tokens of a text: its words, where a word of more than
``LONG`` bytes is cut into runs of ``LONG`` letters and digits, runs of other
marks, and single characters of scripts that are written without spaces.  A
k-mer is ``K`` consecutive tokens, an s-mer ``S`` of them.  A k-mer is an
anchor (a closed syncmer) when the least of its ``K - S + 1`` s-mers, by hash,
is its first or its last one.  That depends on the k-mer alone, so texts that
share a passage share its anchors wherever it stands, and of ``K - S``
consecutive k-mers at least one is an anchor.

A fingerprint is the text's anchors in order, ``WIDTH`` hex digits each: one
for the number of tokens since the last anchor (at most ``K - S``), the others
for 32 bits of the hash of the k-mer.  Positions can be read back
(``anchors``), so two fingerprints can be laid over each other
(``positional_matches``).  The likeness of two fingerprints is the Jaccard
index of their k-mer hashes.

Defined results: null, empty and blank texts have the empty fingerprint; a
text of fewer than ``K`` tokens has one anchor, all its tokens.  Two empty
fingerprints have likeness 1, an empty and another one 0.  Rows are in
ascending id, null ids first, equal ids by hash of the text; a table of one
row is its own next row.  Columns of the input are not carried, so none can
clash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, bind, table

K, S = 5, 2
CODE = 8
WIDTH = CODE + 1
LONG = 48
#: Scripts without spaces between words: each character of a long word is a token.
ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
PIECE = rf"[{ALONE}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{ALONE}]]{{1,{LONG}}}|[^\p{{L}}\p{{M}}\p{{N}}]{{1,{LONG}}}"
#: Buckets of the id order for each shuffle partition.
SPREAD = 4


def tokens(text: Column) -> Column:
    def cut(w):
        piece = lambda x: F.when(F.octet_length(x) <= LONG, F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(PIECE), F.lit(0)))
        return F.when(F.exists(w, lambda x: F.octet_length(x) > LONG), F.flatten(F.transform(w, piece))).otherwise(w)
    return bind(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), ""), cut)


def syncmers(toks: Column, k: int = K, s: int = S) -> Column:
    """Array of (pos, code) of the closed syncmers of a token array; a code is
    32 bits of the hash of the s-mers that cover the k-mer."""
    last = k - s
    low = lambda h: h.bitwiseAND(F.lit((1 << 4 * CODE) - 1))

    def of(t):
        smers = F.transform(t, lambda w, i: F.xxhash64(w, *[F.get(t, i + j) for j in range(1, s)]))

        at = lambda a, p, js: [F.get(a, p + j) for j in js]
        pair = lambda p, code: F.struct(p.alias("pos"), low(code).alias("code"))
        cover = sorted({*range(0, last, s), last})  # offsets of s-mers that make up the k-mer

        def chosen(h):
            inner = lambda p: F.least(*at(h, p, range(1, last))) if last > 2 else F.get(h, p + 1)
            starts = F.sequence(F.lit(0), F.size(t) - k)
            edge = F.filter(starts, lambda p: F.least(*at(h, p, (0, last))) <= inner(p)) if last > 1 else starts
            return F.transform(edge, lambda p: pair(p, F.xxhash64(*at(h, p, cover))))

        # of a shorter text the absent tokens do not enter the hash
        whole = F.array(pair(F.lit(0), F.xxhash64(*at(t, F.lit(0), range(k)))))
        none = F.array().cast("array<struct<pos:int,code:bigint>>")
        return F.when(F.size(t) >= k, bind(smers, chosen)).when(F.size(t) > 0, whole).otherwise(none)

    return bind(toks, of)


def encoded(found: Column) -> Column:
    """The fingerprint of an array of ``syncmers``."""
    def digits(a, x, i):
        gap = x["pos"] - F.when(i > 0, F.get(a, i - 1)["pos"]).otherwise(F.lit(0))
        return F.substring(F.hex(F.shiftleft(16 + gap.cast("bigint"), 4 * CODE).bitwiseOR(x["code"])), 2, WIDTH)
    return bind(found, lambda a: F.lower(F.array_join(F.transform(a, lambda x, i: digits(a, x, i)), "")))


def anchors(df: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, n, pos, code): the anchors of a fingerprint with their token positions."""
    gap = F.conv(F.left("r", F.lit(1)), 16, 10).cast("int")
    parts = df.select(key, F.posexplode(F.regexp_extract_all(F.col(fingerprint), F.lit(f".{{{WIDTH}}}"), F.lit(0))).alias("n", "r"))
    running = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return parts.select(key, "n", F.sum(gap).over(running).cast("int").alias("pos"), F.substring("r", 2, CODE).alias("code"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of k-mer hashes; 1 for two empty ones."""
    def of(x, y):
        both = F.size(F.array_intersect(x, y))
        return bind(both, lambda n: F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(
            n / (F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - n)))
    return bind(a, lambda x: bind(b, lambda y: of(x, y)))


def positional_matches(pairs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """For each pair (a, b) of ids the alignments of their fingerprints:
    (a, b, shift, n_anchors, first, last), where anchors at ``pos`` in a stand
    at ``pos + shift`` in b.  ``fingerprints``: (doc_id, fingerprint).  Anchors
    meet on (a, b, code), so no task holds more than a pair's equal k-mers;
    a code that a text repeats is matched by its order of occurrence, one to
    one, not by all combinations."""
    fp = anchors(fingerprints, "doc_id", "fingerprint")
    nth = F.row_number().over(Window.partitionBy("doc_id", "code").orderBy("pos"))
    fp = fp.select("doc_id", "pos", "code", nth.alias("nth"))
    left = pairs.select("a", "b").join(fp.select(F.col("doc_id").alias("a"), F.col("pos").alias("pa"), "code", "nth"), "a")
    both = left.join(fp.select(F.col("doc_id").alias("b"), F.col("pos").alias("pb"), "code", "nth"), ["b", "code", "nth"])
    return both.groupBy("a", "b", (F.col("pb") - F.col("pa")).alias("shift")).agg(
        F.count("*").alias("n_anchors"), F.min("pa").alias("first"), F.max("pa").alias("last"))


def _order_key(id_col: str, text: str) -> Column:
    return F.struct(F.col(id_col).isNotNull().cast("int").alias("a"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("b"),
                    F.xxhash64(text).alias("c"))


def in_buckets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``df`` with ``_key`` (its place in the id order), ``_bucket`` (runs of
    that order) and ``_extra``: the first rows of a bucket also stand, marked
    extra, at the end of the bucket before it, and the first rows of all at
    the end of the last one.  The bounds of the runs, one for each partition
    of a range partitioning of the ids, come to the driver."""
    spark = df.sparkSession
    n = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", _order_key(id_col, text))
    ranges = keyed.select("_key").repartitionByRange(n, "_key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("_key").alias("k"))
    bounds = sorted((r.k.a, r.k.b, r.k.c) for r in ranges.collect())
    if not bounds:
        return keyed.withColumn("_bucket", F.lit(0)).withColumn("_extra", F.lit(0))
    made = F.from_json(F.lit(json.dumps([{"a": a, "b": b, "c": c} for a, b, c in bounds])), "array<struct<a:int,b:bigint,c:bigint>>")
    # binary search: the last bound that is not above the key
    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))
    span = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(x, _):
        mid = F.shiftright(x["lo"] + x["hi"], 1)
        up = F.get(made, mid) <= F.col("_key")
        narrow = x["hi"] - x["lo"] > 1
        return F.struct(F.when(narrow & up, mid).otherwise(x["lo"]).alias("lo"), F.when(narrow & ~up, mid).otherwise(x["hi"]).alias("hi"))

    at = keyed.withColumn("_b", F.aggregate(steps, span, halve)["lo"])
    own = lambda b, extra: F.struct(b.cast("int").alias("bucket"), F.lit(extra).alias("extra"))
    first = F.get(made, F.col("_b")) == F.col("_key")
    to = F.when(first, F.array(own(F.col("_b"), 0), own(F.pmod(F.col("_b") - 1, F.lit(len(bounds))), 1))).otherwise(F.array(own(F.col("_b"), 0)))
    out = at.withColumn("_to", F.explode(to))
    return out.withColumn("_bucket", F.col("_to.bucket")).withColumn("_extra", F.col("_to.extra")).drop("_to", "_b")


def fingerprint_edits(docs: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edit,
    whose last ``n_chars div share`` characters give way to the first as many
    of the next text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # one exchange: the fingerprints are taken above it, the window finds its rows in place
    dealt = in_buckets(rows, "doc_id", "text").repartition("_bucket")
    found = dealt.withColumn("_found", syncmers(tokens(F.col("text"))))
    own = found.withColumn("fingerprint", encoded(F.col("_found"))).withColumn("_codes", F.transform("_found", lambda x: x["code"]))
    order = Window.partitionBy("_bucket").orderBy("_extra", "_key")
    then = own.withColumn("_next", F.lead(F.struct("text", "_codes")).over(order)).where("_extra = 0")
    n = F.length("text")
    cut = F.floor(n / share).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("_next.text"), F.lit(1), cut))
    then = then.withColumn("_edited", edited).withColumn("_efound", syncmers(tokens(F.col("_edited"))))
    return then.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint",
        encoded(F.col("_efound")).alias("edited_fingerprint"),
        likeness(F.col("_codes"), F.transform("_efound", lambda x: x["code"])).alias("near_edited"),
        likeness(F.col("_codes"), F.col("_next._codes")).alias("near_next"))


def op11_closed_syncmers(spark, sf_dir) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


QUERIES = {"op11_closed_syncmers": op11_closed_syncmers}
ORACLE: dict[str, str] = {}
