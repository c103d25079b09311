"""The third format as a caller's plug-in: layouts, precedence, names of directories, files opened only when they changed."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_collect import BLOCK, FUTURE, PAST, TALK, home  # noqa: F401

from turnloom.plans import block_log, chat_store
from turnloom.plans import collect as pl
from turnloom.sources import files as fl
from turnloom.sources import tables

DOC, LINES, PART = ".gemini/tmp/p/chats/session-a.json", ".gemini/tmp/p/chats/session-a.jsonl", ".gemini/tmp/p/chats/u/x.jsonl"


def message(kind, content, second=0, **more):
    return {"type": kind, "content": content, "timestamp": f"2026-03-01T10:00:{second:02d}Z", **more}


TALK_3 = [
    message("info", "Request cancelled."), message("user", [{"text": "fi"}, {"text": "rst"}], 1), message("gemini", "a", 2, model="m1"), message("gemini", "b", 3, model="m2"),
    message("user", "/clear", 4), message("user", "  ", 5), message("user", "second", 6), message(None, "x"), message("gemini", "done", 7),
]


def document(messages, **head):
    return json.dumps({"sessionId": "s"} | head | {"messages": messages}, indent=1)


def journal(messages, **head):
    rows = [{"sessionId": "s"} | head, {"$set": {"lastUpdated": "x", "type": "user"}}, *messages]
    return "".join(json.dumps(r) + "\n" for r in rows)


@pytest.fixture
def put(tmp_path):
    def one(name, text, at=None):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        if at is not None:
            os.utime(path, (at, at))

    return one


@pytest.fixture
def read(spark, tmp_path):
    """Settled turns and errors of all files, or of some of them that say what they know of the others."""

    def run(now=PAST, only="%", known=()):
        files = fl.list_files(spark, [f"{tmp_path}/.gemini/{g}" for g in chat_store.FILE_GLOBS]).filter(F.col("path").like(only))
        known = spark.createDataFrame([(f"file:{tmp_path}/{p}", i) for p, i in known], "path string, session_id string")
        rows = chat_store.read_files(files, known, now).collect()
        turns = sorted((r.prompt_text, r.response_text, r.model, r.project_context) for r in rows if r.row_kind == "turn")
        return turns, {os.path.basename(r.path) for r in rows if r.row_kind == "error"}

    return run


def test_layouts_say_the_same(put, read):
    texts = {DOC: document, LINES: journal, PART: journal, PART.replace("jsonl", "json"): document}
    for k, (name, made) in enumerate(texts.items()):
        put(name.replace("/p/", f"/p{k}/"), made(TALK_3, sessionId=f"s{k}"))
    assert read() == ([("first", "ab", "m1", f"p{k}") for k in range(4)], set())
    assert read(FUTURE)[0] == [*(("first", "ab", "m1", f"p{k}") for k in range(4)), *(("second", "done", None, f"p{k}") for k in range(4))]


def test_richest_layout_speaks_also_when_it_is_not_read(put, read):
    put(PART, journal(TALK_3, directories=["/work/x", "/y"]))
    put(DOC, document([message("user", "other text", 1), message("user", "and more", 2)]))
    put(LINES, journal([message("user", "third text", 1), message("user", "and more", 2)]))
    assert read() == ([("first", "ab", "m1", "/work/x")], set())
    assert read(only="%.json") == ([("other text", None, None, "p")], set())
    assert read(only="%.json", known=[(PART, "s"), (LINES, "s")]) == ([], set())


def test_names_are_used_if_one_directory_has_them(put, read):
    put(".gemini/projects.json", json.dumps({"projects": {"/real/p": "p", "/a/q": "q", "/b/q": "q"}}, indent=2))
    for k, name in enumerate("pqr"):
        put(f".gemini/tmp/{name}/chats/session-{k}.json", document([message("user", name, k), message("user", "open")], sessionId=name))
    assert read() == ([("p", None, None, "/real/p"), ("q", None, None, "q"), ("r", None, None, "r")], set())


def test_broken_files_are_errors_and_do_no_harm(put, read):
    put(DOC, document(TALK_3)[:-5])
    put(LINES.replace("-a", "-b"), "no json\n")
    put(LINES.replace("-a", "-c"), journal(TALK_3, sessionId="c")[:-10])  # the last line is not ended
    put(DOC.replace("-a", "-e"), "")
    assert read(FUTURE) == ([("first", "ab", "m1", "p")], {"session-a.json", "session-e.json"})


def test_texts_are_decoded_once_for_the_turns(spark, put, tmp_path, monkeypatch):
    put(DOC, document(TALK_3))
    put(LINES.replace("session-a", "session-b"), journal(TALK_3, sessionId="t"))
    listing = fl.list_files(spark, [f"{tmp_path}/.gemini/{g}" for g in chat_store.FILE_GLOBS]).select("path", "file_size", "file_mtime")
    files = spark.createDataFrame(listing.collect(), listing.schema)
    known = spark.createDataFrame([], "path string, session_id string")
    rows = chat_store.read_files(files, known, FUTURE)
    # Documents, journals and the projects file.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 3
    monkeypatch.setattr(chat_store, "CHUNK_BYTES", 600)  # the journal reaches over two chunks, the document lies beyond one
    apart = chat_store.read_files(files, known, FUTURE)
    monkeypatch.setattr(chat_store, "CHUNK_BYTES", min(r.file_size for r in files.collect()))  # one of each
    mixed = chat_store.read_files(files, known, FUTURE)
    told = lambda df: sorted(map(str, df.collect()))
    assert told(rows) == told(apart) == told(mixed) and len(told(rows)) == 6


def test_job_collects_what_is_new_in_rewritten_documents(spark, home, put):  # noqa: F811
    """Beside a built-in format; a document is opened when its size or its change time is another, and its old turns are not repeated."""
    globs = {**home.job.globs, "GEMINI": [f"{home.root}/.gemini/{g}" for g in chat_store.FILE_GLOBS]}
    job = pl.Job(globs, home.job.state, "9.9", 128, identity_buckets=2, formats=(block_log, chat_store))
    held = spark.createDataFrame([("device-token", "t")], "token_key string, token string")

    def run(number, now=PAST):
        pl.run_once(spark, job, home.entries(spark, (".claude", "device-token")), held, now, number)
        opened = spark.read.parquet(f"{job.table('stage')}/pass_id={number}/format=GEMINI/opened").count()
        rows = tables.spooled_events(spark, job.table("spool")).filter(F.col("pass_id") == number).collect()
        return opened, sorted((r.source_tool[0], r.prompt_text) for r in rows)

    home.put(BLOCK, TALK)
    put(DOC, document(TALK_3), 1_700_000_000)
    put(LINES.replace("-a", "-b"), "no json\n")
    assert run("1") == (2, [("C", "use «REDACTED»"), ("G", "first")])
    assert {(os.path.basename(r.path), r.reason) for r in pl.errors_of(spark, job, "1").collect()} == {("session-b.jsonl", "no session header")}
    # Same size, other change time; then another size, same change time. The broken file is tried again each time.
    put(DOC, document(TALK_3).replace('"fi"', '"FI"'), 1_700_000_001)
    assert run("2") == (2, [("G", "FIrst")])
    put(DOC, document([*TALK_3, message("user", "third", 8)]), 1_700_000_001)
    assert run("3") == (2, [("G", "second")])
    with pytest.raises(ValueError):
        pl.run_once(spark, pl.Job({}, f"{home.root}/other", "1", formats=(chat_store,)), home.entries(spark), held, PAST, "1")


def test_files_are_opened_when_listing_or_rest_changes(spark):
    schema = "path string, file_size bigint, file_mtime timestamp"
    seen = spark.sql(f"select path, file_size, file_mtime, timestamp'2026-01-01 01:00:00' seen_at, '' session_id from values ('same', 5L, timestamp'2026-01-01 00:00:00'), ('size', 5L, timestamp'2026-01-01 00:00:00'), ('time', 5L, timestamp'2026-01-01 00:00:00'), ('rests', 5L, timestamp'2026-01-01 00:55:00') t(path, file_size, file_mtime)")
    listing = spark.sql("select * from values ('same', 5L, timestamp'2026-01-01 00:00:00'), ('size', 6L, timestamp'2026-01-01 00:00:00'), ('time', 5L, timestamp'2026-01-01 00:00:01'), ('rests', 5L, timestamp'2026-01-01 00:55:00'), ('new', 0L, timestamp'2026-01-01 00:00:00') t(path, file_size, file_mtime)")
    assert sorted(r.path for r in fl.changed(listing, seen, "2026-01-01 02:00:00").collect()) == ["new", "rests", "size", "time"]
    assert sorted(r.path for r in fl.changed(listing, seen, "2026-01-01 01:01:00").collect()) == ["new", "size", "time"]
    assert fl.changed(spark.createDataFrame([], schema), seen, "2026-01-01 02:00:00").count() == 0
