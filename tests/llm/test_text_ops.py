"""Quality rules, line dedup, decontamination, BPE, chat and toxicity."""

import collections
import itertools
import random
import tracemalloc

import fixtures as X
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontam, line_dedup, quality, toxicity


@pytest.mark.parametrize("module, name", [(quality, "op6_quality_rules"), (line_dedup, "op5_line_dedup"),
                                          (decontam, "op9_decontamination"), (chat, "op1_chat_prefix_targets")])
def test_equals_sql(spark, module, name):
    got, want = X.against_sql(spark, module.QUERIES[name], module.ORACLE[name])
    assert got == want and got


def test_quality_edges(spark):
    out = quality.evaluate(X.documents(spark, ["kept", "n_words", "h"]))
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == 14 and out.count() == len(X.ROWS)
    assert rows[1].n_words == rows[2].n_words == rows[3].n_words == 0 and not rows[2].kept
    assert rows[5].n_words == 30_000 and rows[5].base_failed and rows[1].h == "mine"
    assert rows[7].word_chars == 9_000 and "too_short" in rows[7].failed_rules
    assert quality.evaluate(X.empty(spark)).count() == 0
    # a filter on the verdict does not repeat the counting
    plan = out.where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") <= 2 * quality.WINDOW and "ArrowEvalPython" not in plan


def test_repeated_words_brute_force(spark):
    random.seed(5)
    docs = [" ".join(random.choice("ab") for _ in range(random.randint(0, 25))) for _ in range(60)]
    got = quality.evaluate(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    for r in got:
        w = r.text.split()
        seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        hit = {i + j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(5)}
        assert r.n_repeat_words == len(hit)


def test_lines_edges(spark):
    out = line_dedup.remove_repeated_windows(X.documents(spark, ["kept_text", "h", "a"]))
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(X.ROWS) and rows[1].kept_text is None and rows[2].kept_text == "" and rows[1].h == "mine"
    assert rows[11].n_removed_lines == 0
    # both later windows merge; white space at a line's ends does not count
    assert rows[12].kept_text == "x" and rows[12].n_removed_lines == 4
    assert line_dedup.remove_repeated_windows(X.empty(spark)).count() == 0


def test_lines_of_very_long_texts(spark):
    """Tens of thousands of repeated lines with blank and single ones between: equal to plain code (they took time with their square)."""
    once = [f"line {i}" if i % 8 else f"  only {i}" for i in range(20_000)]
    texts = [(1, "\n".join([*once, "", *[x.replace("only", "other") for x in once]])), (2, "\n\n".join(once)), (3, "\n".join(["same"] * 20_000)),
             (4, "\n".join(["new", *["same"] * 5, " ", "end"]))]
    out = line_dedup.remove_repeated_windows(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: (r.kept_text, r.n_removed_lines) for r in out.collect()} == X.plain_kept_lines(texts)


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, X.PASSAGE), (1, X.PASSAGE), (2, "One, TWO"), (3, None), (4, "..."), (None, "endoftext")], "item_id long, text string")
    for size in (1 << 20, 64):
        out = decontam.decontaminate(X.documents(spark, ["spans", "items", "_spans"]), items, block_bytes=size)
        rows = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(X.ROWS) and rows[1].n_words == 0 and rows[1].kept_text is None
        assert rows[4].spans == [[0, 2]] and rows[4]["items"] == ["2"] and rows[4].dropped
        assert rows[8].n_hit == 70 and rows[8].kept_text == "alpha beta gamma" and rows[8]["items"] == ["1"]
        assert rows[10].n_hit == 1 and rows[10]["items"] == [] and rows[5].n_hit == 0
    assert decontam.decontaminate(X.documents(spark), items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(X.empty(spark), items).count() == 0


def test_decontamination_blocks_and_long_text(spark):
    """Many blocks, some with a written table between them, give what one block gives, on a text of 200,000 words that holds every item five times."""
    words = [f"t{i % 211}x{i % 199}" for i in range(200_000)]
    items = spark.createDataFrame([(i, " ".join(words[i * 40:i * 40 + 12 + i % 3])) for i in range(30)] + [(30, "t1x1 nowhere")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words), "a"), (2, " ".join(words[70:95]), "b"), (3, "t1x1", "c")], "doc_id long, text string, items string")
    total = items.selectExpr("sum(length(text) + 16)").first()[0]
    got = []
    for size in (total, total // 5):
        out = decontam.decontaminate(docs, items, block_bytes=size, carried=["doc_id"])
        got.append(sorted((r.doc_id, r.n_words, r.n_hit, r.spans, sorted(r["items"]), r.kept_text) for r in out.collect()))
    assert got[0] == got[1] and [len(r[4]) for r in got[0]] == [30, 1, 0] and got[0][0][2] == 5 * sum(12 + i % 3 for i in range(30))


def test_automaton_memory():
    """Flat arrays: under 100 bytes for a byte of random words, which is the worst case."""
    draw = random.Random(1)
    items = [(str(i), [b"%x" % draw.randrange(1 << 20) for _ in range(60)]) for i in range(1000)]
    tracemalloc.start()
    machine = decontam.SuffixAutomaton(items)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 100 * sum(len(w) + 1 for _, seq in items for w in seq) and len(machine.length) > 60_000


def test_automaton_brute_force():
    random.seed(2)
    for _ in range(150):
        items = [(str(i), [random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(0, 9))]) for i in range(4)]
        doc = [random.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        spans, found = decontam.SuffixAutomaton(items, 4).hits(doc)
        hit, who = set(), set()
        for i, w in items:
            m = min(4, len(w))
            for k in range(len(w) - m + 1 if m else 0):
                for p in range(len(doc) - m + 1):
                    if doc[p:p + m] == w[k:k + m]:
                        hit |= set(range(p, p + m))
                        who.add(i)
        assert {p for a, b in spans for p in range(a, b)} == hit and found == who
        assert all(x[1] < y[0] for x, y in itertools.pairwise(spans))


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    lib = Tokenizer.from_file(path)
    out = bpe.encode_decode(X.documents(spark, ["ids", "decoded"]), path)
    assert out.count() == len(X.ROWS)
    for r in out.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(X.empty(spark), path).count() == 0
    random.seed(4)
    odd = ["a", "b", "the", "he", "t", "'s", "'", "É", "Σ", "İ", "1", "²", "!", "<|endoftext|>", "<|", "\x1c", "\x85", "\xa0", " ", "\n", "中", "👍🏽", "ﬁ", "ing"]
    texts = ["".join(random.choice(odd) for _ in range(random.randint(0, 30))) for _ in range(3000)] + ["ababab" * 300, "!" * 2000]
    enc = bpe.Encoder(path, most=50)  # a full table changes nothing
    for i in range(0, len(texts), 500):
        assert enc.encode(texts[i:i + 500]) == [lib.encode(t, add_special_tokens=False).ids for t in texts[i:i + 500]]


def test_bpe_query(spark):
    import hashlib

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    text = dict(X.texts(spark))
    for r in bpe.op4_bpe_round_trip(spark, X.SF001).collect():
        ids = lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_chat_edges(spark):
    random.seed(1)
    odd = ["\\", "<|", "<", "|", "n", "\n", "<\\|", "im_end|>", "é👍", "\\n"]
    texts = [("".join(random.choice(odd) for _ in range(random.randint(0, 8))),) for _ in range(300)]
    df = spark.createDataFrame(texts, "t string")
    for line in (False, True):
        e = chat.escaped(F.col("t"), line)
        assert df.where(chat.unescaped(e, line) != F.col("t")).count() == 0 and df.where(e.contains("<|")).count() == 0
    rows = [(1, 0, "user", "q", 1), (1, 1, "assistant", None, 1), (1, 2, "user", "more", 1), (2, 0, None, "x", 1), (None, 0, "assistant", "y", 1),
            (3, 0, "assistant", "same", 1), (3, 0, "assistant", "same", 1)]
    got = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.conv_id or 0, r.place)):
        by[r.conv_id].append((r.target_turn, r.text, r.loss_start, r.loss_end))
    assert by[1][0][0] == 1 and by[1][0][1].endswith("<|im_start|>assistant\n<|im_end|>\n") and by[1][0][2] == by[1][0][3]
    assert by[1][1][0] is None and "more" in by[1][1][1] and len(by[3]) == 2 and len(by[None]) == 1 and by[2][0][2] is None
    t, text, a, b = by[3][1]
    assert text[a:b] == "same" and text.count("same") == 2
    assert chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_kernel_brute_force():
    def plain(s, t, p, decay):
        return sum(decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1) for i in itertools.combinations(range(len(s)), p)
                   for j in itertools.combinations(range(len(t)), p) if [s[x] for x in i] == [t[x] for x in j])

    random.seed(1)
    a, b = (["".join(random.choice("abc") for _ in range(random.randint(1, 7))) for _ in range(60)] for _ in "xy")
    assert np.allclose(toxicity.kernel(a, b), [plain(x, y, 3, 0.7) for x, y in zip(a, b, strict=True)])
    near = toxicity.similarity(["idiot", "iddiot", "id-iot", "edition"], ["idiot"] * 4)
    assert near[0] > near[1] > near[2] > toxicity.FLOOR > near[3]
    assert toxicity.spelled("you i d i o t here")[-1] == "idiot"


def plain_score(texts, matcher=None):
    model = toxicity.Model(["idiot", "moron"], np.ones(2), -0.5, 4.0, 0.0)
    return model.scores((matcher or toxicity.Matcher(model.landmarks)).sentences(texts))


@pytest.mark.parametrize("mark", [".", "!", "?", "...", "?!", ". ", ".\n"])
@pytest.mark.parametrize("word", ["idiot", "id-iot", "iddiot", "mmoron", "i d i o t"])
def test_toxicity_final_mark(word, mark):
    bare, ended = f"you are an {word}", f"you are an {word}{mark}"
    want = plain_score([bare])[0]
    assert want > plain_score(["you are an engineer"])[0]
    assert plain_score([ended])[0] == pytest.approx(want)
    # other rows of the slice and what the worker met before change nothing
    matcher = toxicity.Matcher(["idiot", "moron"])
    for others in ([], [bare], ["a kind moron. yes", None, ""]):
        assert plain_score([*others, ended, f"good day. {ended}"], matcher)[-2:] == pytest.approx([want, want])


@pytest.mark.parametrize("form", ["i.d.i.o.t", "idi!ot", "id?iot", "id.iot", "i . d . i . o . t", "i ! d ! i ! o ! t", "i..d..i..o..t", "i\nd\ni\no\nt",
                                  "i d i o t .", "ridiculously.idiot", "idiot.ridiculously", "f i n e . i d i o t", "f i n e\ni d i o t"])
def test_toxicity_marks_inside(form):
    """Sentence marks inside a word neither hide it nor the words on both sides."""
    clean = plain_score(["you are an engineer"])[0]
    for text in (form, f"you are an {form} today", f"good day. you {form}! bye"):
        assert plain_score([text])[0] > clean + 0.2
    # the sentence still ends at a mark before white space, quoted or not
    matcher = toxicity.Matcher(["idiot", "moron"])
    assert [len(x) for x in matcher.sentences(["an idiot. a moron", "an idiot a moron", 'an "idiot!" a moron', "an idiot\na moron", f"{form}. a moron"])] == [2, 1, 2, 2, 2]


def test_toxicity_edges_and_held_out(spark):
    rows = [(i, f"plain words here number{i}. " + (f"you {['stupid', 'moron'][i % 2]}" if i % 3 == 0 else "you kind person"), int(i % 3 == 0)) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    out = toxicity.score(X.documents(spark, ["score", "predicted"]).unionByName(spark.createDataFrame(
        [(20, "a mmoron and more", "en", "s", 1), (21, "m o r o n", "en", "s", 1), (22, "a kind person", "en", "s", 1)], X.SCHEMA), allowMissingColumns=True), model)
    got = {r.doc_id: r for r in out.collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 17
    assert got[20].predicted == got[21].predicted == 1 and got[22].predicted == got[1].predicted == got[2].predicted == 0
    assert toxicity.score(X.empty(spark), model).count() == 0
    flat = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert toxicity.score(X.documents(spark), flat).where("predicted = 1").count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.op2_toxicity_string_kernel(spark, sf)
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = scored.join(marks, "doc_id").where("held_out").select("toxic", "predicted").collect()
    both = sum(r.toxic and r.predicted for r in rows)
    assert both >= 0.75 * sum(r.toxic for r in rows) and both >= 0.75 * sum(r.predicted for r in rows)


def test_marks_share_forms_and_runs_are_ruled_out(monkeypatch):
    """Tokens that differ in marks only are compared once; a text without a possible run is not searched for runs."""
    import random

    from tessera.llm import toxicity as X

    seen = []
    plain = X.pairs_of
    monkeypatch.setattr(X, "pairs_of", lambda words: seen.append(list(words)) or plain(words))
    m = X.Matcher(["stupid"])
    m.learn({"stupidd", "stupidd,", "(stupidd", "other", "other."})
    assert sorted(seen[-1]) == ["other", "stupidd"]
    assert m.known.keys() == {"stupidd", "stupidd,", "(stupidd"} and len({repr(v) for v in m.known.values()}) == 1
    random.seed(2)
    hits = 0
    for _ in range(20_000):
        text = "".join(random.choice("ab.\"  \n\t ") for _ in range(random.randrange(14)))
        runs = X.SPELT.findall(text)
        hits += bool(runs)
        assert not runs or X.MAYBE_SPELT.search(text)
    assert hits > 100


def test_sentences_are_cut_fast():
    """The cuts of two plain look-behinds, in well under their time."""
    import random
    import re
    import time

    plain = re.compile(r"(?:(?<=[.!?])|(?<=[.!?][\"')\]»”]))\s+|\n+")
    r = random.Random(1)
    for _ in range(20_000):
        x = "".join(r.choice(" \n\t.!?\"')]»”ab") for _ in range(r.randrange(14)))
        assert toxicity.SENTENCE.split(x) == plain.split(x)
    text = "some words of a sentence that goes on, and on. " * 4000

    def seconds(pattern):
        took = []
        for _ in range(5):
            t = time.process_time()
            pattern.split(text)
            took.append(time.process_time() - t)
        return min(took)

    assert seconds(toxicity.SENTENCE) < 0.75 * seconds(plain)
