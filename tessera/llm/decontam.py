"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised to words; one automaton over the word numbers holds
every run of words of every item.  Training documents are streamed through
it: per word the automaton keeps the longest run that ends there and stands
in some item.  A run of ``window`` words (or a whole shorter item) is a hit;
the words of overlapping hits merge into spans, which are removed.  A document
of which the hits cover more than ``max_coverage`` is marked to be dropped.

The item table is read in blocks of about ``block_bytes`` by a hash of the
item, one automaton per block and pass; the driver holds one block at a time.
A worker holds one automaton, about 60 bytes for a byte of random words, and a
task runs ``PASSES`` of them at a time: after as many passes the rows so far
are written to the shared folder.  With one block, which is the normal case,
documents are scanned once.  Documents are never shuffled.

Defined results: null and empty texts have no words and no hits; items
without words are no windows; repeated items with one id count once; a null
item id is left out of the list of ids; extra columns pass.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored, table

WINDOW = 10
MAX_COVERAGE = 0.8
BLOCK_BYTES = 4 << 20
#: Blocks whose automata one task may hold, each in a worker of its own.
PASSES = 2
#: On UTF-8 bytes after A-Z are lowered: digits, letters, and all beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalised(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class SuffixAutomaton:
    """Of several word sequences; every path from the root is a run of some sequence.

    States are numbers into flat arrays.  Most states have one step, which is
    kept in two of these arrays; only further steps, and all of the root, are
    in dictionaries.  The items of a state are a node of a tree of lists that
    states share.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.length, self.link = array("i", [0]), array("i", [-1])
        self.word, self.next = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {0: {}}
        self.window = window
        numbered = [(i, array("i", [self.numbers.setdefault(w, len(self.numbers)) for w in words])) for i, words in items if words]
        for _, seq in numbered:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self._label(numbered)

    def step(self, state: int, w: int) -> int | None:
        if self.word[state] == w:
            return self.next[state]
        further = self.more.get(state)
        return None if further is None else further.get(w)

    def _set(self, state: int, w: int, to: int) -> None:
        if state and self.word[state] in (-1, w):
            self.word[state], self.next[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _extend(self, last: int, w: int) -> int:
        length, link = self.length, self.link
        q = self.step(last, w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        new = self._state(length[last] + 1)
        p = last
        while p >= 0 and (q := self.step(p, w)) is None:
            self._set(p, w, new)
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.word.append(-1)
        self.next.append(-1)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        """Split off the shorter runs of state ``q``."""
        copy = self._state(self.length[p] + 1)
        self.word[copy], self.next[copy] = self.word[q], self.next[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.step(p, w) == q:
            self._set(p, w, copy)
            p = self.link[p]
        return copy

    def _label(self, numbered) -> None:
        """Per state: the items that hold its window, the whole short items that end it, and the least length that is a hit."""
        length, link, window = self.length, self.link, self.window
        n = len(length)
        self.list_item, self.list_rest = [None], array("i", [-1])
        lists: dict[tuple[int, str], int] = {}
        # an item is put into a list once, last, while its words are walked
        holds, last = array("i", bytes(4 * n)), array("i", [-1])
        whole: dict[int, set] = {}
        for number, (item, seq) in enumerate(numbered):
            state = 0
            for w in seq:
                state = up = self.step(state, w)
                while len(seq) >= window and up > 0 and length[up] >= window and last[holds[up]] != number:
                    node = lists.setdefault((holds[up], number), len(self.list_item))
                    if node == len(self.list_item):
                        self.list_item.append(item)
                        self.list_rest.append(holds[up])
                        last.append(number)
                    holds[up] = node
                    up = link[up]
            if len(seq) < window:
                whole.setdefault(state, set()).add((len(seq), item))
        self.items, self.short, self.least = holds, array("i", bytes(4 * n)), array("i", [window]) * n
        self.shorts: list[tuple] = [()]
        order = np.argsort(np.frombuffer(length, dtype=np.int32), kind="stable")[1:]
        for part in range(0, len(order), 65_536):
            for s in order[part:part + 65_536].tolist():
                up = link[s]
                self.short[s], self.least[s] = self.short[up], self.least[up]
                if s in whole:
                    self.short[s] = len(self.shorts)
                    self.shorts.append(self.shorts[self.short[up]] + tuple(sorted(whole[s], key=repr)))
                    self.least[s] = min(m for m, _ in self.shorts[-1])
                if length[s] >= window and length[up] >= window:
                    # the state of the window itself: the last ancestor that is long enough
                    holds[s] = holds[up]

    def items_of(self, state: int) -> set:
        out, node = set(), self.items[state]
        while node:
            out.add(self.list_item[node])
            node = self.list_rest[node]
        return out

    def hits(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged spans of words [start, end) inside hits, and the items hit."""
        spans, found, short_found = [], set(), set()
        step, link, length, least, window = self.step, self.link, self.length, self.least, self.window
        root = self.more[0]
        state = run = 0
        for end, w in enumerate(map(self.numbers.get, words), 1):
            if w is None:
                state = run = 0
                continue
            nxt = step(state, w) if state else root.get(w)
            while nxt is None and state:
                state = link[state]
                run = length[state]
                nxt = step(state, w)
            if nxt is None:
                continue
            state = nxt
            run += 1
            if run >= least[state]:
                size = 0
                if run >= window:
                    size = window
                    found.add(state)
                for m, item in self.shorts[self.short[state]]:
                    if m <= run:
                        size = max(size, m)
                        short_found.add(item)
                if size:
                    if spans and spans[-1][1] >= end - size:
                        spans[-1][1] = end
                        while len(spans) > 1 and spans[-2][1] >= min(spans[-1][0], end - size):
                            spans[-2][1] = end
                            spans.pop()
                        spans[-1][0] = min(spans[-1][0], end - size)
                    else:
                        spans.append([end - size, end])
        for s in found:
            short_found |= self.items_of(s)
        return spans, short_found


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without_spans(text: str, spans: list) -> str:
    """``text`` without the words of ``spans``; a gap keeps one line break or blank of those around it."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    keep, last = [], 0
    for a, b in spans:
        keep.append(raw[last:at[a][0]])
        last = at[b - 1][1]
    keep.append(raw[last:])
    out = keep[0]
    for piece in keep[1:]:
        out = out + piece if not out or not piece else out.rstrip(b" ") + b" " + piece.lstrip(b" ") if out[-1:] != b"\n" else out + piece.lstrip(b" ")
    return out.decode("utf-8", "surrogatepass")


OUTPUTS = {"n_words": "bigint", "n_hit": "bigint", "spans": "array<array<int>>", "items": "array<string>",
           "coverage": "double", "dropped": "boolean", "kept_text": "string"}


def decontaminate(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW,
                  max_coverage: float = MAX_COVERAGE, block_bytes: int = BLOCK_BYTES, outputs=tuple(OUTPUTS),
                  carried: list[str] | None = None) -> DataFrame:
    """``docs`` with ``outputs``; those that ``docs`` has already are replaced."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if carried is None else carried) if c not in outputs and c not in ("_spans", "_items")]
    tests = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = tests.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out, state = docs.select(*dict.fromkeys([*keep, text])), []
    for b in range(blocks):
        # one block of at most about block_bytes is in the driver at a time
        block = [(r.i, r.t) for r in tests.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]
        shared, last = spark.sparkContext.broadcast(block), b == blocks - 1

        def work_on(texts, before, shared=shared, last=last):
            machine = automaton_of(shared, window)
            rows = []
            for k, t in enumerate(texts):
                w = normalised(t)
                spans, found = machine.hits(w)
                if before:
                    spans, found = _merged(spans + (before[0][k] or [])), found | {*(before[1][k] or [])}
                found = sorted({i for i in found if i is not None})
                if not last:
                    rows.append((spans, found))
                    continue
                hit = sum(y - x for x, y in spans)
                part = hit / len(w) if w else 0.0
                rows.append(tuple({"n_words": len(w), "n_hit": hit, "spans": spans, "items": found, "coverage": part, "dropped": part > max_coverage,
                                   "kept_text": without_spans(t, spans) if spans and "kept_text" in outputs else t}[o] for o in outputs))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in (outputs if last else "ab")]

        new = ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs) if last else "_spans array<array<int>>, _items array<string>"
        out = map_texts(out, text, keep if last else [*dict.fromkeys([*keep, text])], new, lambda f=work_on: f, before=state)
        state = ["_spans", "_items"]
        if not last and b % PASSES == PASSES - 1:
            out = stored(out, "decontam")
    return out


_MACHINES: dict = {}


def automaton_of(shared, window: int) -> SuffixAutomaton:
    """The automaton of a broadcast block, built once per worker; an earlier one is let go."""
    key = (shared.value.__len__(), hash(tuple(shared.value)), window)
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = SuffixAutomaton([(i, normalised(t)) for i, t in shared.value], window)
    return _MACHINES[key]


def op9_decontamination(spark, sf_dir) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                        outputs=("n_words", "n_hit", "items"), carried=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
item_words AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s, least(len(w), 10) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
dw AS (SELECT doc_id, text, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {docs}),
sizes AS (SELECT DISTINCT m FROM win),
grams AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, g.m, item_id FROM grams g JOIN win USING (s, m)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
"""
ORACLE = {"op9_decontamination": "WITH " + SQL.replace("{docs}", "documents") + """
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN ids i USING (doc_id)"""}
QUERIES = {"op9_decontamination": op9_decontamination}
