"""Toxicity by a subsequence string-kernel support vector machine.

The kernel of two words is the gap-weighted number of their common character
subsequences of length ``P``, normalised: an inserted, doubled or dropped
character costs a factor, not the match.  A sentence is compared with a
landmark word by its most similar word.  Landmarks are the words that tell the
labelled classes apart best; ``K^(-1/2)`` of their kernel matrix (Nyström) maps
similarities to features, on which a linear SVM (squared hinge) is trained.
Its training rows are sentences: of each labelled document the one that is
closest to the landmarks, chosen again by the machine after each round.  A
text's score is that of its worst sentence, put between 0 and 1 by a logistic
fit on the training rows.

A word is compared only with landmarks of which it holds ``SHARED`` of the
ordered letter pairs (at distance one or two) and is at most ``LONGER`` times
as long, and similarities below ``FLOOR`` count as none: both are part of the
feature's definition.  Runs of three or more single characters are a word too.
A sentence ends at a mark before white space or at the end of a line.  A word
with such marks inside is compared whole, without them, and in the parts
between them.

The fit reads at most ``MOST_LABELLED`` labelled documents (those with the
least hash of their id, a bounded sample) and the driver gets the similarities
of their sentences that are not zero, ten bytes each.  Scoring reads every whole text, no shuffle.

Defined results: null and empty texts have no words and get the score of a
sentence without similarities; without labels of both classes all scores are
the share of toxic labels (0 if none); repeated labels of one document count
once, the toxic one first; extra columns pass, outputs replace their namesakes.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored, table

P = 3
DECAY = 0.7
LANDMARKS = 128
MOST_LABELLED = 12_000
SHARED = 0.5
LONGER = 3
FLOOR = 0.3
THRESHOLD = 0.3
#: Words that a worker remembers.
CACHE_WORDS = 400_000
MARKS = ".,;:!?\"'()[]{}<>«»„“”…"
SPELT = re.compile(r"(?<!\S)[{0}]*\S(?:\s\S){{2,}}[{0}]*(?!\S)".format(re.escape(MARKS)))
#: What every such run holds; far quicker to rule out than a run is to look for.
MAYBE_SPELT = re.compile(r"\s\S\s\S(?=[\s{0}]|\Z)".format(re.escape(MARKS)))
#: White space behind a mark, or line ends; starts with a character set, for which the engine scans fast.
SENTENCE = re.compile(r"\s(?:(?<=[.!?]\s)\s*|(?<=[.!?][\"')\]»”]\s)\s*|(?<=\n)\n*)")
INSIDE = re.compile(r"[.!?]+")


def _codes(words: list[str]) -> np.ndarray:
    width = max(map(len, words))
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(words), width)


def kernel(a: list[str], b: list[str], p: int = P, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of each pair (a[i], b[i])."""
    if not a:
        return np.zeros(0)
    s, t = _codes(a), _codes(b)
    n, m, d2 = s.shape[1], t.shape[1], decay * decay
    s, t = np.ascontiguousarray(s.T), np.ascontiguousarray(t.T)  # the pairs lie side by side
    same = ((s[:, None] == t[None]) & (s[:, None] != 0)).astype(float)
    prior = np.ones((n + 1, m + 1, len(a)))
    for _ in range(p - 1):
        new = np.zeros_like(prior)
        for i in range(1, n + 1):
            step = d2 * same[i - 1] * prior[i - 1, :-1]
            run = np.zeros(len(a))
            for j in range(1, m + 1):
                run = decay * run + step[j - 1]
                new[i, j] = decay * new[i - 1, j] + run
        prior = new
    return d2 * (same * prior[:-1, :-1]).sum(axis=(0, 1))


def _blocked(a: list[str], b: list[str]) -> np.ndarray:
    """``kernel`` in blocks of pairs of similar length."""
    out = np.zeros(len(a))
    order = np.lexsort(([*map(len, b)], [*map(len, a)])).tolist()
    start = 0
    while start < len(order):
        stop, n, m = start, len(a[order[start]]) + 2, len(b[order[start]]) + 4
        while stop < len(order) and stop - start < 1024 and len(a[order[stop]]) <= n and len(b[order[stop]]) <= m:
            stop += 1
        idx = order[start:stop]
        out[idx] = kernel([a[i] for i in idx], [b[i] for i in idx])
        start = stop
    return out


def similarity(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel of each pair."""
    words = list({*a, *b})
    own = dict(zip(words, _blocked(words, words).tolist(), strict=True))
    scale = np.array([own[x] * own[y] for x, y in zip(a, b, strict=True)])
    return np.where(scale > 0, _blocked(a, b) / np.sqrt(np.where(scale > 0, scale, 1)), 0)


def pairs_of(words: list[str]) -> np.ndarray:
    """Two 64-bit masks per word: its ordered pairs of characters at distance one or two, by a hash modulo 128."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in words])
    own = np.repeat(np.arange(len(words)), sizes)
    masks = np.zeros((2, len(words)), np.uint64)
    for gap in (1, 2):
        at = np.flatnonzero(own[gap:] == own[:-gap])
        code = (flat[at] * 40_503 + flat[at + gap] * 9_973) >> 3 & 127
        for half in (0, 1):
            sel = code >> 6 == half
            np.bitwise_or.at(masks[half], own[at[sel]], np.uint64(1) << (code[sel] & 63).astype(np.uint64))
    return masks


class Matcher:
    """Similarities of words to the landmarks, remembered per worker."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.known, self.dull = landmarks, {}, set()
        if landmarks:
            self.bits = pairs_of(landmarks)
            self.need = np.ceil(np.bitwise_count(self.bits).sum(axis=0) * SHARED)

    def learn(self, tokens: set[str]) -> None:
        """Fill ``known`` (token to its similarities) and ``dull`` (tokens without any)."""
        if not self.landmarks:
            return
        new = [t for t in tokens if t not in self.known]
        tokens_of: dict[str, list[int]] = {}  # tokens that differ in marks only share their forms
        for i, t in enumerate(new):
            for w in forms_of(t):
                if len(w) >= P:
                    tokens_of.setdefault(w, []).append(i)
        forms = list(tokens_of)
        found: dict[int, list] = {}
        if forms:
            bits = pairs_of(forms)
            sizes = np.array([len(w) for w in forms])
            left, right = [], []
            for j, need in enumerate(self.need):
                both = np.bitwise_count(bits & self.bits[:, j, None])
                hit = np.flatnonzero((both[0] + both[1] >= need) & (sizes <= LONGER * len(self.landmarks[j])))
                left += [forms[k] for k in hit]
                right += [j] * len(hit)
            sim = similarity(left, [self.landmarks[j] for j in right])
            for k in np.flatnonzero(sim >= FLOOR).tolist():
                for i in tokens_of[left[k]]:
                    found.setdefault(i, []).append((right[k], float(sim[k])))
        for i, t in enumerate(new):
            if i in found:
                self.known[t] = found[i]
            elif len(self.dull) < CACHE_WORDS:  # frequent words come first
                self.dull.add(t)
        if len(self.known) > CACHE_WORDS:
            self.known = {t: self.known[t] for t in tokens if t in self.known}

    def sentences(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """Per text the similarity vectors of its sentences that have any."""
        lowered = [(t or "").lower() for t in texts]
        cut = [spelled(t) for t in lowered]
        self.learn(set().union(*cut) - self.dull)
        known, out = self.known, []
        for text, tokens in zip(lowered, cut, strict=True):
            rows = []
            if not known.keys().isdisjoint(tokens):
                # cut at white space only, runs before it: the words are those that were learnt
                if MAYBE_SPELT.search(text):
                    text = SPELT.sub(lambda run: " ".join(joined(run.group())), text)
                for s in SENTENCE.split(text):
                    hits = [known[w] for w in s.split() if w in known]
                    if hits:
                        best: dict[int, float] = {}
                        for h in hits:
                            for j, x in h:
                                if x > best.get(j, 0.0):
                                    best[j] = x
                        v = np.zeros(len(self.landmarks))
                        v[list(best)] = list(best.values())
                        rows.append(v)
            out.append(rows)
        return out


def spelled(text: str) -> list[str]:
    """Words, and those that runs of three or more single characters spell."""
    runs = SPELT.findall(text) if MAYBE_SPELT.search(text) else []
    return text.split() + [w for run in runs for w in joined(run)]


def joined(run: str) -> list[str]:
    """The word that a run of single characters spells, after those of its lines if it has several."""
    lines = [line for line in run.split("\n") if line] if "\n" in run else []
    return [*("".join(line.split()).strip(MARKS) for line in lines), "".join(run.split())]


def forms_of(token: str) -> list[str]:
    """What is compared with the landmarks: the bare word; with sentence marks inside also the word without them and the parts between them."""
    bare = token.strip(MARKS)
    if not INSIDE.search(bare):
        return [bare]
    return list({bare, INSIDE.sub("", bare), *(part.strip(MARKS) for part in INSIDE.split(bare))})


class Model:
    """Landmarks, the weight of each similarity, offset and logistic scale; picklable and of bounded size."""

    def __init__(self, landmarks, weights, offset, slope, shift):
        self.landmarks, self.weights, self.offset, self.slope, self.shift = landmarks, weights, offset, slope, shift

    def scores(self, sentences: list[list[np.ndarray]]) -> list[float]:
        worst = np.array([max([self.offset, *(float(v @ self.weights) + self.offset for v in rows)]) for rows in sentences])
        return (1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -500, 500)))).tolist()


def packed(rows: list[np.ndarray]) -> bytes:
    """Similarity vectors of a text's sentences as (sentence, landmark, value): few are not zero."""
    at = np.argwhere(np.array(rows) > 0) if rows else np.zeros((0, 2), np.int64)
    out = np.zeros(len(at), PACKED)
    if rows:
        out["row"], out["col"], out["sim"] = at[:, 0], at[:, 1], np.array(rows)[at[:, 0], at[:, 1]]
    return out.tobytes()


PACKED = np.dtype([("row", "<i4"), ("col", "<i2"), ("sim", "<f4")])


def chosen_sentence(bag: bytes, value, size: int) -> np.ndarray:
    """The sentence with the largest sum of ``value(entries)``; one without similarities counts zero."""
    x = np.frombuffer(bag, PACKED)
    out = np.zeros(size)
    if len(x):
        total = np.bincount(x["row"], value(x))
        best = int(total.argmax())
        if total[best] > 0:
            hit = x[x["row"] == best]
            out[hit["col"]] = hit["sim"]
    return out


def train(landmarks: list[str], bags: list[bytes], y: np.ndarray, rounds: int = 3, cost: float = 1.0) -> Model:
    """SVM on one sentence per bag, chosen anew in each round, and its logistic scale."""
    share = float(y.mean()) if len(y) else 0.0
    if not landmarks or share in (0.0, 1.0):
        flat = np.log(share / (1 - share)) if 0 < share < 1 else 500.0 if share else -500.0
        return Model(landmarks, np.zeros(len(landmarks)), 0.0, 0.0, flat)
    m = len(landmarks)
    pairs = [(a, b) for a in landmarks for b in landmarks]
    k = similarity([a for a, _ in pairs], [b for _, b in pairs]).reshape(m, m)
    value, vector = np.linalg.eigh((k + k.T) / 2 + 1e-3 * np.eye(m))
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T  # Nyström map
    pick = [chosen_sentence(b, lambda x: x["sim"] ** 2, m) for b in bags]
    sign = 2.0 * y - 1
    for _ in range(rounds):
        x = np.c_[np.array(pick) @ root, np.ones(len(y))]
        w = np.zeros(m + 1)
        for _ in range(30):  # Newton steps of the squared hinge
            active = sign * (x @ w) < 1
            a = x[active]
            ridge = np.eye(m + 1) / cost
            ridge[m, m] = 1e-6
            new = np.linalg.solve(a.T @ a + ridge, a.T @ sign[active])
            if np.allclose(new, w, atol=1e-9):
                break
            w = new
        weights, offset = root @ w[:m], float(w[m])
        pick = [chosen_sentence(b, lambda x: x["sim"] * weights[x["col"]], m) for b in bags]  # noqa: B023
    f = np.array(pick) @ weights + offset
    slope, shift = 1.0, 0.0
    for _ in range(50):  # logistic regression of the labels on the margin
        q = 1 / (1 + np.exp(-np.clip(slope * f + shift, -30, 30)))
        g = np.array([((y - q) * f).sum() - 1e-3 * slope, (y - q).sum()])
        r = np.maximum(q * (1 - q), 1e-9)
        h = np.array([[(r * f * f).sum() + 1e-3, (r * f).sum()], [(r * f).sum(), r.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        slope, shift = slope + float(np.clip(step[0], -2, 2)), shift + float(np.clip(step[1], -2, 2))
    return Model(landmarks, weights, offset, slope, shift)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", most: int = MOST_LABELLED,
        landmarks: int = LANDMARKS) -> Model:
    """Train on rows (key, text, label 0/1), of which there are at most ``most``."""
    rows = stored(labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("y")).where("y is not null"), "labelled")
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < pos < n:
        return train([], [], np.full(1, pos / n if n else 0.0))
    words = rows.select("y", F.explode(F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, F.lit(MARKS))))).alias("w"))
    seen = words.where(F.length("w") >= P).groupBy("w").agg(F.sum("y").cast("double").alias("a"), F.count("*").cast("double").alias("c")).where("a >= 3")
    # log-likelihood ratio of the word's share in both classes
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    a, c, share = F.col("a"), F.col("c"), pos / n
    ratio = part(a, c * share) + part(c - a, c * (1 - share)) + part(pos - a, (n - c) * share) + part(n - pos - c + a, (n - c) * (1 - share))
    best = [r.w for r in seen.where(a > c * share).select("w", ratio.alias("g")).orderBy(F.desc("g"), "w").limit(8 * landmarks).collect()]
    chosen: list[str] = []
    for w in best:
        if len(chosen) < landmarks and (not chosen or similarity([w] * len(chosen), chosen).max() < 0.85):
            chosen.append(w)

    def work(texts, before):
        matcher = _matcher(chosen)
        return [[packed(found) for found in matcher.sentences(texts)], before[0]]

    back = map_texts(rows, "text", [], "s binary, label int", lambda: work, before=["y"]).collect()
    return train(chosen, [bytes(r.s) for r in back], np.array([r.label for r in back], float))


_MATCHERS: dict = {}


def _matcher(landmarks: list[str]) -> Matcher:
    """One matcher per worker and set of landmarks."""
    key = tuple(landmarks)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(landmarks)
    return _MATCHERS[key]


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, carried: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    keep = [c for c in (docs.columns if carried is None else carried) if c not in ("score", "predicted")]

    def work(texts):
        s = model.scores(_matcher(model.landmarks).sentences(texts))
        return [s, [int(x >= threshold) for x in s]]

    return map_texts(docs, text, keep, "score double, predicted int", lambda: work)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents outside the held-out fold, those of the least hash."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most ``most`` rows of two numbers are broadcast; repeated documents could be more than one row each
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def op2_toxicity_string_kernel(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(sampled(docs, table(spark, sf_dir, "labels")))
    return score(docs, model, carried=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


ORACLE: dict[str, str] = {}
QUERIES = {"op2_toxicity_string_kernel": op2_toxicity_string_kernel}
