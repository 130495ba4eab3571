"""BPE encoding and decoding with a pair occurrence index.

Each task collects the distinct pre-tokens of a slice of texts that it has
not met yet and lays their symbols out in arrays.  An index maps every
adjacent pair that the merge table holds to all its positions.  Active ranks
are taken in ascending order; a rank's merge is applied at its positions and
the lists of the pairs that vanish or arise next to them are updated.  A word
has its leftmost occurrence merged first and the others put back, so a new
pair of a lower rank next to it takes precedence, as in a per-word queue.

Vocabulary and merges are read from a tokenizers JSON file (word ends marked
by a suffix, byte-level alphabet); its path is a parameter.  Per-worker tables
are caches of bounded size: results do not depend on them.

Defined results: a null or empty text has no ids and decodes to the empty
string; repeated rows and extra columns pass; very long texts without white
space are one chunk.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, table

#: Distinct white-space separated chunks that a worker remembers.
CACHE_CHUNKS = 300_000
NONE = np.int64(1) << 40
#: FIXED VALUES: marks that are neither letter, digit nor apostrophe; characters that the pre-tokenizer takes as white space.
MARKS = ".,;:!?|*&%$#"
SPACES = "\t\n\x0b\x0c\r\x20\x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [chr(shifted.get(b, b)) for b in range(256)]


class Vocabulary:
    """Merge table and token strings of one tokenizers file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.final = np.array([vocab[c + suffix] for c in alphabet], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in chain(vocab.items(), self.special.items())}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.odd_space = regex.compile("[\x1c-\x1f]").search
        self.spaces = regex.compile(f"[{SPACES}]+").split

    def rank_of(self, left, right):
        """Rank of each pair, or NONE."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def chunks(self, text: str) -> list[str]:
        """Normalised text cut at white space; no pre-token crosses it."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # lower-casing is by code point: no final sigma
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return [c for c in self.spaces(text) if c] if self.odd_space(text) else text.split()


def merge_words(v: Vocabulary, words: list[bytes]) -> list[tuple[int, ...]]:
    """Token ids of each word, all merged together through the occurrence index."""
    if not words:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    sym = v.inner[raw]
    sym[ends - 1] = v.final[raw[ends - 1]]
    word = np.repeat(np.arange(len(words)), lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[ends - lengths] = -1
    alive = np.ones(n, bool)
    rank_at = np.full(n, NONE)
    index: dict[int, list] = {}
    active: list[int] = []

    def enlist(at):
        """Rank the pairs that start at these positions and add them to the index."""
        ranks = v.rank_of(sym[at], sym[after[at]])
        rank_at[at] = ranks
        good = ranks < NONE
        at, ranks = at[good], ranks[good]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(active, r)

    enlist(np.flatnonzero(after >= 0))
    while active:
        r = heapq.heappop(active)
        parts = index.pop(r)
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = np.unique(at[rank_at[at] == r])
        if not len(at):
            continue
        w = word[at]
        first = np.r_[True, w[1:] != w[:-1]]
        if not first.all():
            index[r] = [at[~first]]
            heapq.heappush(active, r)
            at = at[first]
        right = after[at]
        sym[at] = v.merged[r]
        alive[right] = False
        rank_at[right] = rank_at[at] = NONE
        beyond = after[right]
        after[at] = beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        ahead = before[at]
        enlist(np.concatenate([at[has], ahead[ahead >= 0]]))
    left = np.flatnonzero(alive)
    ids, bounds = sym[left].tolist(), np.cumsum(np.bincount(word[left], minlength=len(words))).tolist()
    return [tuple(ids[a:b]) for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]


class Encoder:
    """Texts to ids with a bounded table of chunks already encoded."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        self.v, self.most, self.known = Vocabulary(path), most, {}

    def _learn(self, new: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of chunks not met before, merged together."""
        cut = []
        for c in new:
            # letters with a tail of marks are the common case; the pattern cuts the rest
            if c.isalpha():
                cut.append([c])
                continue
            body = c.rstrip(MARKS)
            cut.append([body, c[len(body):]] if body.isalpha() else self.v.pieces(c))
        distinct = list(dict.fromkeys(chain.from_iterable(cut)))
        ids = dict(zip(distinct, merge_words(self.v, [p.encode("utf-8", "surrogatepass") for p in distinct]), strict=True))
        return {c: ids[p[0]] if len(p) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, p))) for c, p in zip(new, cut, strict=True)}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        v = self.v
        cut = []  # per text: chunks, or (None, id) for a special token
        for t in texts:
            t = t or ""
            if v.split_special and "<" in t and v.split_special.search(t):
                cut.append([x for i, p in enumerate(v.split_special.split(t)) for x in ([(None, v.special[p])] if i % 2 else v.chunks(p))])
            else:
                cut.append(v.chunks(t))
        wanted = set().union(*cut)
        special = {x: (x[1],) for x in wanted if x.__class__ is tuple}
        new = self._learn([x for x in wanted.difference(special) if x not in self.known])
        # frequent chunks come first, so a full table is left as it is
        if len(self.known) + len(new) <= self.most:
            self.known.update(new)
            new = special
        else:
            new |= special
        at = (self.known | new if new else self.known).__getitem__
        return [list(chain.from_iterable(map(at, c))) for c in cut]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by a space: the file names no decoder."""
        return " ".join(map(self.v.tokens.__getitem__, ids))


OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, path: str, outputs=("ids", "n_tokens", "decoded"), text: str = "text",
                  carried: list[str] | None = None) -> DataFrame:
    """``docs`` with ``outputs``: the ids, their number, the text decoded from
    them, and digests of both (taken in the task, so that neither needs to
    leave it).  Columns of ``docs`` with an output's name are replaced."""
    keep = [c for c in (docs.columns if carried is None else carried) if c not in outputs]
    new = ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs)

    def make():
        import hashlib

        enc = Encoder(path)
        name = {i: str(i) for i in enc.v.tokens}

        def digest(s: str) -> str:
            return hashlib.sha256(s.encode()).hexdigest()

        def work(texts):
            rows = [[] for _ in outputs]
            for ids in enc.encode(texts):
                decoded = enc.decode(ids) if {"decoded", "decoded_sha256"} & {*outputs} else None
                for col, o in zip(rows, outputs, strict=True):
                    col.append(ids if o == "ids" else len(ids) if o == "n_tokens" else decoded if o == "decoded"
                               else digest(decoded) if o == "decoded_sha256" else digest(" ".join(map(name.__getitem__, ids))))
            return rows

        return work

    return map_texts(docs, text, keep, new, make)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe_round_trip(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_decode(docs, vocabulary_path(), ("n_tokens", "ids_sha256", "decoded_sha256"), carried=["doc_id"])


QUERIES = {"op4_bpe_round_trip": op4_bpe_round_trip}
ORACLE: dict[str, str] = {}
