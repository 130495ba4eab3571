"""Corpus metadata: both shapes, strict numbers, CSV and JSON files."""

import json

import pytest

from tessera.operators import curate
from tessera.sources import files as FS

COMMENTS = [("  more than a few words here  ", "news", 5, 1, 1), ('a "quoted"\nline, and more', "news", -3, 0, 2)]
JOKES = [("Why?  ", "  Because\nof \"that\".", 9, "jokes", True, 1_577_836_800, 1), ("Only a title that is long", None, 0, "clean", None, 0, 2)]


def landed(spark, path, comments=COMMENTS, jokes=JOKES):
    FS.write_table(spark.createDataFrame(comments, "body string, subreddit string, score long, controversiality int, doc_id long"), f"{path}/c", "csv")
    FS.write_table(spark.createDataFrame(jokes, "title string, selftext string, score long, `subreddit.name` string, `subreddit.nsfw` boolean, "
                                                "created_utc long, doc_id long"), f"{path}/j", "csv")
    return FS.read_comments_csv(spark, f"{path}/c", "doc_id"), FS.read_jokes_csv(spark, f"{path}/j", "doc_id")


def test_csv_keeps_white_space_and_lines(spark, tmp_path):
    c, j = landed(spark, str(tmp_path))
    assert sorted(tuple(r) for r in c.collect()) == sorted(COMMENTS)
    assert sorted((r.doc_id, r.title, r.selftext, r.nsfw, r.created_utc) for r in j.collect()) == [
        (1, "Why?  ", "  Because\nof \"that\".", True, 1_577_836_800), (2, "Only a title that is long", None, None, 0)]


def test_fields_by_source_survive_json(spark, tmp_path):
    c, j = landed(spark, str(tmp_path))
    meta = curate.corpus_metadata(curate.curate_comments(c), curate.curate_jokes(j))
    FS.write_metadata(meta, f"{tmp_path}/m")
    back = FS.read_metadata(spark, f"{tmp_path}/m")
    assert back.schema == FS.METADATA_SCHEMA
    rows = {r.doc_id: r.asDict() for r in back.collect()}
    big = 1 << 48
    assert set(rows) == {1, 2, big | 1, big | 2}
    assert rows[2] == {"doc_id": 2, "text": 'a "quoted"\nline, and more', "source": "reddit_comment", "subreddit": "news", "score": -3,
                       "controversiality": 0, "nsfw": None, "created_utc": None}
    assert rows[big | 1] == {"doc_id": big | 1, "text": "Why?  \n  Because\nof \"that\".", "source": "reddit_joke", "subreddit": "jokes", "score": 9,
                             "controversiality": None, "nsfw": True, "created_utc": 1_577_836_800}
    assert rows[big | 2]["nsfw"] is None and rows[big | 2]["created_utc"] == 0


def test_numbers_must_be_given(spark, tmp_path):
    c, j = landed(spark, str(tmp_path), comments=[("a long enough body", "news", 1, None, 1)])
    with pytest.raises(Exception, match="controversiality is null"):
        curate.corpus_metadata(c, curate.curate_jokes(j)).collect()
    loose = curate.corpus_metadata(c, curate.curate_jokes(j), strict=False)
    assert [r.controversiality for r in loose.where("source = 'reddit_comment'").collect()] == [None]
    assert "Exchange" not in curate.corpus_metadata(c, curate.compose_joke_text(j))._jdf.queryExecution().executedPlan().toString()


def test_array_file_and_bad_lines(spark, tmp_path):
    entries = [{"text": "x\ny", "source": "reddit_comment", "subreddit": "s", "score": 1, "controversiality": 0},
               {"text": "é", "source": "reddit_joke", "subreddit": "t", "score": 2, "nsfw": False, "created_utc": 3}]
    (tmp_path / "a.json").write_text(json.dumps(entries, ensure_ascii=False), encoding="utf-8")
    got = sorted(FS.read_metadata(spark, str(tmp_path / "a.json"), array=True).collect(), key=lambda r: r.score)
    assert [{k: v for k, v in r.asDict().items() if v is not None} for r in got] == entries
    (tmp_path / "b.json").write_text(json.dumps(entries[0]) + "\nnot json\n")
    assert sorted((r.text or "") for r in FS.read_metadata(spark, str(tmp_path / "b.json")).collect()) == ["", "x\ny"]
    (tmp_path / "c").mkdir()
    FS.write_metadata(FS.read_metadata(spark, str(tmp_path / "a.json"), array=True).limit(0), f"{tmp_path}/none")
    assert FS.read_metadata(spark, f"{tmp_path}/none").count() == 0
