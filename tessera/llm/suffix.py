"""Suffix-array dedup of byte strings that recur anywhere in a corpus.

A byte goes if it is covered by a string of ``length`` bytes that also starts
elsewhere, in any document.  Strings are judged on the input.

Equal strings must meet to be sorted, without one suffix array of everything.
Every string of ``length`` bytes is filed under the least hash of the
``GRAM``-byte grams in it, so equal strings have the same key.  Consecutive
strings of a document with one key form a context.  Keys with one context are
done; equal contexts are counted as one.  The distinct contexts of a key are
sent to one task, which sorts their suffixes by two-stage sorting:
suffixes smaller than their successors are sorted directly (their pieces up
to the next such suffix are named, then names are doubled), all others are
induced by a scan over the buckets of first bytes; common prefixes of
neighbours then show which strings recur.

A key of which the contexts exceed ``CHUNK`` bytes, such as that of a passage
in a third of all documents, is dealt to several tasks; what a chunk cannot
decide alone is settled by hashes of its strings, one per distinct string and
chunk.  Nothing is ever compared pair by pair.

Defined results: null is an empty text; texts shorter than ``length`` bytes
stay; repeated rows recur in each other; extra columns pass and outputs
replace columns of their name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_texts, stored, table
from .shingles import _VALUE, _powers, mix

LENGTH = 400
GRAM = 32
CHUNK = 2_000_000
PIECE = 1_000_000
_ODD = 0x9E3779B97F4A7C15 | 1


def two_stage_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (small non-negative integers, its last one the
    least) in the order of their suffixes, exact to ``depth`` symbols."""
    n = len(text)
    # a suffix is smaller than its successor if the next different symbol is larger
    rise = np.r_[np.diff(text), 1]
    change = np.where(rise != 0, np.arange(n), n)
    change = np.minimum.accumulate(change[::-1])[::-1]
    small = rise[change] > 0
    at = np.flatnonzero(small)
    rank = _sort_small(text, small, at, depth)
    direct = at[np.argsort(rank, kind="stable")]
    heads = text[direct]
    cuts = np.searchsorted(heads, np.arange(int(text.max()) + 2))
    pending: dict[int, list] = {}
    order = []
    for c in range(len(cuts) - 1):
        found = pending.pop(c, [])
        new = np.concatenate(found) if found else direct[:0]
        parts = []
        while len(new):  # runs of one symbol induce inside their own bucket
            parts.append(new)
            before = new[new > 0] - 1
            new = before[(text[before] == c) & ~small[before]]
        whole = np.concatenate([*parts, direct[cuts[c]:cuts[c + 1]]])
        order.append(whole)
        before = whole[whole > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            edges = np.flatnonzero(first[1:] != first[:-1]) + 1
            for b, part in zip(first[np.r_[0, edges]].tolist(), np.split(before, edges), strict=True):
                pending.setdefault(b, []).append(part)
    return np.concatenate(order)


def _refine(rank: np.ndarray, tied: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Split groups of equal rank by ``keys``, the last one first; returns the members of groups still tied.  A rank is the place of its group's first member."""
    if len(keys) == 1 and len(rank) < 1 << 31:
        both = rank[tied] * (len(rank) + 2) + keys[0]
        order = np.argsort(both)
        tied, both = tied[order], both[order]
        r = rank[tied]
        new_g = np.r_[True, both[1:] != both[:-1]]
    else:
        order = np.lexsort((*keys, rank[tied]))
        tied = tied[order]
        r = rank[tied]
        new_g = np.r_[True, r[1:] != r[:-1]]
        for k in keys:
            k = k[order]
            new_g[1:] |= k[1:] != k[:-1]
    new_r = np.r_[True, r[1:] != r[:-1]]
    place = np.arange(len(tied))
    rank[tied] = r + np.maximum.accumulate(np.where(new_g, place, 0)) - np.maximum.accumulate(np.where(new_r, place, 0))
    alone = new_g & np.r_[new_g[1:], True]
    return tied[~alone]


def _sort_small(text: np.ndarray, small: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at ``at``: pieces up to the next of them are named by their symbols and types, then doubled."""
    m = len(at)
    symbol = np.r_[text.astype(np.int64) * 2 + small, np.zeros(8, np.int64)]
    last = np.r_[at[1:], at[-1:]]
    rank, tied, done = np.zeros(m, np.int64), np.arange(m), 0
    while len(tied) and done < depth:
        key = np.zeros(len(tied), np.int64)
        for j in range(6):
            p = at[tied] + done + j
            key = (key << 10) | np.where(p <= last[tied], symbol[np.minimum(p, len(symbol) - 1)], 0)
        tied = _refine(rank, tied, key & ((1 << 30) - 1), key >> 30)
        done += 6
        long = last[tied] - at[tied] >= done
        if not long.any():
            break
        tied = tied[long]
    step = 1
    tied = _tied(rank)
    while len(tied) and step <= m:
        ahead = tied + step
        tied = _refine(rank, tied, np.where(ahead < m, rank[np.minimum(ahead, m - 1)] + 1, 0))
        step *= 2
        # groups go on as a whole while a member's prefix is short of the depth
        short = tied[at[np.minimum(tied + step, m - 1)] - at[tied] < depth]
        going = np.zeros(m, bool)
        going[rank[short]] = True
        tied = tied[going[rank[tied]]]
    return rank


def _tied(rank: np.ndarray) -> np.ndarray:
    count = np.bincount(rank, minlength=len(rank))
    return np.flatnonzero(count[rank] > 1)


def adjacent_prefixes(data: bytes, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix length of the suffixes at ``a`` and ``b``, up to ``depth``, in steps of eight bytes."""
    padded = data + b"\0" * 8
    word = np.ndarray((len(data),), "<u8", padded, 0, (1,))
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for t in [*range(0, depth - 8, 8), depth - 8]:
        live = live[word[a[live] + t] == word[b[live] + t]]
        out[live] = t + 8
        if not len(live):
            break
    return out


def recurring(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per context the offsets of its strings of ``length`` bytes that start in another place of the contexts too."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1)
    data = b"\0".join(contexts) + b"\0"
    text = np.frombuffer(data, np.uint8).astype(np.int32) + 1
    text[ends - 1] = 0
    left = np.repeat(ends - 1, sizes + 1) - np.arange(len(text))
    order = two_stage_order(text, length)
    order = order[left[order] >= length]
    prefix = adjacent_prefixes(data, order[:-1], order[1:], length) >= length
    hit = np.zeros(len(text), bool)
    hit[order[:-1][prefix]] = True
    hit[order[1:][prefix]] = True
    found, starts = np.flatnonzero(hit), ends - sizes - 1
    cuts = np.searchsorted(found, np.r_[starts, len(text)])
    return [found[cuts[i]:cuts[i + 1]] - starts[i] for i in range(len(contexts))]


def merged(starts: np.ndarray, length: int) -> list[int]:
    """Flat list of the maximal runs [a, b, ...] that strings at sorted ``starts`` cover."""
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length) + 1
    return np.stack([starts[np.r_[0, gap]], starts[np.r_[gap - 1, len(starts) - 1]] + length], axis=1).ravel().tolist()


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (minimum or maximum) over each window of ``width``."""
    size = 1
    while size * 2 <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


class Filer:
    """Cuts texts into contexts."""

    def __init__(self, length: int):
        self.length, self.gram = length, min(GRAM, length)
        self.width = length - self.gram + 1

    def contexts(self, raws: list[bytes]):
        """Per text five arrays: key, start, size and hash of each context, and whether a string may recur inside it."""
        none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
        out = [none] * len(raws)
        todo, size = [], 0
        for i, r in enumerate(raws):
            if len(r) >= self.length:
                todo.append(i)
                size += len(r)
            if todo and (size >= PIECE or i == len(raws) - 1):
                for j, x in zip(todo, self._piece([raws[j] for j in todo]), strict=True):
                    out[j] = x
                todo, size = [], 0
        if todo:
            for j, x in zip(todo, self._piece([raws[j] for j in todo]), strict=True):
                out[j] = x
        return out

    def _piece(self, raws):
        data = np.frombuffer(b"".join(raws), np.uint8)
        sizes = np.array([len(r) for r in raws])
        ends = np.cumsum(sizes)
        total, unshift = prefix_hashes(data)
        g = self.gram
        gram = mix((total[g:] - total[:-g]) * unshift[:len(data) - g + 1])
        least = _slide(gram, self.width, np.minimum)
        # a gram is an anchor if it is the least of some string
        pad = np.full(self.width - 1, 0, np.uint64)
        anchor = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), self.width, np.maximum) == gram)
        start = np.arange(len(least))
        own = np.repeat(np.arange(len(raws)), sizes)[:len(least)]
        inside = start + self.length <= ends[own]
        new = np.r_[True, least[1:] != least[:-1]] | np.r_[True, own[1:] != own[:-1]]
        start, key, own, new = start[inside], least[inside], own[inside], new[inside]
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(start)] - 1
        a, b, key, own = start[head], start[tail] + self.length, key[head], own[head]
        name = mix((total[b] - total[a]) * unshift[a] + (b - a).astype(np.uint64))
        lo, hi = np.searchsorted(anchor, a), np.searchsorted(anchor, b - g + 1)
        ties = np.where(hi - lo > 8, 2, 0)
        for k in range(8):
            at = np.minimum(lo + k, len(anchor) - 1)
            ties += (lo + k < hi) & (gram[anchor[at]] == key)
        a -= (ends - sizes)[own]
        b -= (ends - sizes)[own]
        cuts = np.searchsorted(own, np.arange(len(raws) + 1))
        cols = [key.view(np.int64), a, b - a, name.view(np.int64), ties > 1]
        return [[c[cuts[i]:cuts[i + 1]] for c in cols] for i in range(len(raws))]


def prefix_hashes(data: np.ndarray):
    """Prefix sums of a polynomial hash, and the factors that make a range's hash independent of its place."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_ODD, len(data)), out=total[1:], dtype=np.uint64)
    return total, _powers(pow(_ODD, -1, 1 << 64), len(data) + 1)


def _utf8(texts):
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _file(length):
    filer = Filer(length)
    return lambda texts: [list(c) for c in zip(*filer.contexts(_utf8(texts)), strict=True)]


_PICKED = "m bigint, ctx bigint, n bigint, chunk int, chunks int, bytes binary"
_SORTED = "m bigint, ctx bigint, spans array<int>, bucket int, hashes binary, owners binary"


def _pick(batches):
    """The bytes of the chosen contexts (m, ctx, start, size, n, chunk, chunks) of each text."""
    import pyarrow as pa

    for batch in batches:
        for text, picks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            rows = [(p["m"], p["ctx"], p["n"], p["chunk"], p["chunks"], raw[p["start"]:p["start"] + p["size"]]) for p in picks]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=["m", "ctx", "n", "chunk", "chunks", "bytes"])


def _sorter(length: int, parts: int):
    """Sorts whole keys (or chunks of a key) at a time, several small ones together."""
    def work(rows):
        spans, undecided = [], {}
        for (m, ctx, n, _, chunks, raw), starts in zip(rows, recurring([r[5] for r in rows], length), strict=True):
            if n < 2 and len(starts):
                spans.append((m, ctx, merged(starts, length), None, None, None))
            if chunks > 1:
                undecided.setdefault(m, []).append((ctx, n, raw, starts))
        for m, held in undecided.items():
            spans += _left_open(m, held, length, parts)
        return spans

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()]
        pack = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["m", "ctx", "spans", "bucket", "hashes", "owners"])
        held, size, key = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if (row[0], row[3]) != key and size >= CHUNK // 2:
                    yield pack(work(held))
                    held, size = [], 0
                key = (row[0], row[3])
                held.append(row)
                size += len(row[5])
        if held:
            yield pack(work(held))

    return run


def _left_open(m, held, length, parts):
    """For the other chunks of key ``m``: each distinct string's hash once, with its owner where it stands once in this chunk."""
    hashes, owners, offsets = [], [], []
    for i, (_, n, raw, starts) in enumerate(held):
        total, unshift = prefix_hashes(np.frombuffer(raw, np.uint8))
        at = np.arange(len(raw) - length + 1)
        hashes.append(mix((total[length:] - total[:-length]) * unshift[at]))
        known = np.isin(at, starts) | (n > 1)
        owners.append(np.where(known, -1, i))
        offsets.append(at)
    h, o, off = np.concatenate(hashes), np.concatenate(owners), np.concatenate(offsets)
    first = np.unique(h, return_index=True)[1]
    h, o, off = h[first], o[first], off[first]
    names = np.array([x[0] for x in held] + [0], np.int64)
    bucket = (mix(h) % np.uint64(parts)).astype(np.int64)
    rows = []
    for b in np.unique(bucket).tolist():
        sel = bucket == b
        own = np.zeros((int(sel.sum()), 2), np.int64)
        own[:, 0], own[:, 1] = names[o[sel]], np.where(o[sel] < 0, -1, off[sel])
        rows.append((m, None, None, b, h[sel].tobytes(), own.tobytes()))
    return rows


def _settler(length: int):
    """Strings that stand once in their chunk but in another chunk too, as spans of their context."""
    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for batch in batches:
            for m, h, o in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                held.setdefault(m, []).append((h, o))
        for m, blobs in held.items():
            h = np.frombuffer(b"".join(x[0] for x in blobs), np.uint64)
            own = np.frombuffer(b"".join(x[1] for x in blobs), np.int64).reshape(-1, 2)
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order]
            same = h[1:] == h[:-1]
            hit = own[(np.r_[False, same] | np.r_[same, False]) & (own[:, 1] >= 0)]
            hit = hit[np.lexsort((hit[:, 1], hit[:, 0]))]
            cut = np.flatnonzero(hit[1:, 0] != hit[:-1, 0]) + 1 if len(hit) else []
            rows = [(m, int(p[0, 0]), merged(p[:, 1], length)) for p in np.split(hit, cut) if len(p)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                                  pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["m", "ctx", "spans"])

    return run


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """(key, text_hash, spans): per document that has any, the covered byte ranges, flat and unmerged across contexts."""
    spark = docs.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    filed = stored(map_texts(rows, "text", ["key", "text_hash"], "m array<bigint>, start array<int>, size array<int>, ctx array<bigint>, ties array<boolean>",
                             lambda: _file(length)), "contexts")
    one = filed.select("key", "text_hash", F.explode(F.arrays_zip("m", "start", "size", "ctx", "ties")).alias("x")).select("key", "text_hash", "x.*")
    keys = one.groupBy("m").agg(F.count("*").alias("c"), F.max("ties").alias("t")).where("c > 1 or t").select("m")
    shared = stored(one.join(keys, "m"), "shared")
    contexts = shared.groupBy("m", "ctx").agg(F.count("*").alias("n"), F.max("ties").alias("ties"), F.min(F.struct("key", "text_hash", "start", "size")).alias("at"))
    of_key = contexts.groupBy("m").agg(F.count("*").alias("d"), F.max("ties").alias("t"), F.ceil(F.sum("at.size") / chunk).cast("int").alias("chunks")).where("d > 1 or t")
    todo = contexts.join(of_key, "m").select("m", "ctx", "n", "at.*", F.pmod("ctx", "chunks").cast("int").alias("chunk"), "chunks")
    picks = todo.groupBy("key", "text_hash").agg(F.collect_list(F.struct("m", "ctx", "n", "start", "size", "chunk", "chunks")).alias("picks"))
    # exact repeats of a row would be picked twice
    texts = rows.join(picks.withColumnsRenamed({"key": "_key", "text_hash": "_hash"}).hint("shuffle_hash"),
                      F.col("key").eqNullSafe(F.col("_key")) & (F.col("text_hash") == F.col("_hash")))
    picked = texts.select("text", "picks").mapInArrow(_pick, _PICKED)
    dealt = picked.repartition(parts, "m", "chunk").sortWithinPartitions("m", "chunk", "ctx")
    found = stored(dealt.mapInArrow(_sorter(length, parts), _SORTED), "sorted")
    open_ = found.where("bucket is not null").select("m", "hashes", "owners", "bucket").repartition(parts, "m", "bucket")
    settled = open_.select("m", "hashes", "owners").mapInArrow(_settler(length), "m bigint, ctx bigint, spans array<int>")
    alone = found.where("spans is not null").select("m", "ctx", "spans").unionByName(settled)
    twice = contexts.where("n > 1").select("m", "ctx", F.array(F.lit(0), F.col("at.size")).alias("spans"))
    marks = alone.unionByName(twice).groupBy("m", "ctx").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    placed = shared.select("m", "ctx", "key", "text_hash", "start").join(marks, ["m", "ctx"])
    return placed.groupBy("key", "text_hash").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: (x + F.col("start")).cast("int")))).alias("spans"))


OUTPUTS = {"n_bytes": "bigint", "removed": "array<array<int>>", "n_removed": "bigint", "n_spans": "bigint", "kept": "binary", "kept_sha256": "string"}


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, chunk: int = CHUNK,
                   outputs=tuple(OUTPUTS), carried: list[str] | None = None) -> DataFrame:
    """``docs`` with ``outputs``: bytes, removed ranges, what is kept."""
    keep = [c for c in (docs.columns if carried is None else carried) if c not in outputs]
    spans = repeated_spans(docs, key, text, length, chunk)
    joined = docs.select(*dict.fromkeys([*keep, key, text]), F.xxhash64(text).alias("_th")).join(
        spans.withColumnsRenamed({"key": "_key", "text_hash": "_hash", "spans": "_spans"}).hint("shuffle_hash"),
        F.col(key).eqNullSafe(F.col("_key")) & (F.col("_th") == F.col("_hash")), "left").drop("_key", "_hash", "_th")

    def work(texts, before):
        rows = []
        for raw, flat in zip(_utf8(texts), before[0], strict=True):
            runs = []
            for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)) if flat else ():
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            parts, last = [], 0
            for a, b in runs:
                parts.append(raw[last:a])
                last = b
            kept = b"".join([*parts, raw[last:]])
            made = {"n_bytes": len(raw), "removed": runs, "n_removed": len(raw) - len(kept), "n_spans": len(runs), "kept": kept}
            rows.append([hashlib.sha256(kept).hexdigest() if o == "kept_sha256" else made[o] for o in outputs])
        return [list(c) for c in zip(*rows, strict=True)]

    return map_texts(joined, text, keep, ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs), lambda: work, before=["_spans"])


def op8_suffix_array_dedup(spark, sf_dir) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"), carried=["doc_id"])


ORACLE: dict[str, str] = {}
QUERIES = {"op8_suffix_array_dedup": op8_suffix_array_dedup}
