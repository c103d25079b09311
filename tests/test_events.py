import json

import pytest
from pyspark.sql import functions as F

from turnloom.functions.paths import DEFAULT_TOKEN_KEY
from turnloom.operators import cursors as cur
from turnloom.operators import events as ev
from turnloom.operators import registry as reg
from turnloom.operators import reports

DEFAULT = "/h/.claude"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def dups(spark):
    data = [("e", "T", "h1", "p", i, "b0" if i < 50 else "b1") for i in range(90)]
    data += [("e", "T", "h2", "p", 95, "b1"), ("f", "T", "h1", "p", 96, "b1")]
    return spark.createDataFrame(
        data, "employee_id string, source_tool string, content_hash string, path string, prompt_offset bigint, batch string"
    ).repartition(4)


def test_first_writer_wins(spark):
    kept = ev.dedup_events(dups(spark)).select("employee_id", "content_hash", "prompt_offset")
    assert rows(kept) == [("e", "h1", 0), ("e", "h2", 95), ("f", "h1", 96)]
    stored = spark.createDataFrame([("e", "T", "h1")], "employee_id string, source_tool string, content_hash string")
    assert rows(ev.dedup_events(dups(spark), stored).select("prompt_offset")) == [(95,), (96,)]


def test_ingest_counts(spark):
    assert rows(ev.ingest_counts(dups(spark), "batch", ["path", "prompt_offset"])) == [("b0", 1, 49), ("b1", 2, 40)]


def wire_rows(spark, n):
    return spark.range(n).selectExpr(
        "'q' as queue_slug", "'f' as spool_file", "'T' as source_tool", "'cli' as surface", "cast(null as string) as session_id",
        "concat('p', id) as prompt_text", "'' as response_text", "timestamp'2026-01-01' as prompt_ts", "cast(null as bigint) as token_count",
        "'' as project_context", "'1' as client_version", "cast(null as string) as model", "'x' as path", "id as prompt_offset",
    )


def test_three_events_in_batches_of_two(spark):
    unit = ["queue_slug", "spool_file"]
    batched = ev.assign_batches(wire_rows(spark, 3).repartition(3), unit, ["path", "prompt_offset"], 2)
    bodies = ev.build_envelopes(batched, unit).orderBy("batch").collect()
    assert [b.n_events for b in bodies] == [2, 1]
    assert [[e["promptText"] for e in json.loads(b.payload)["events"]] for b in bodies] == [["p0", "p1"], ["p2"]]
    assert "responseText" not in bodies[0].payload


def test_delivery_stops_at_first_failing_file(spark):
    outcomes = spark.createDataFrame(
        [("a", "1", 0, True), ("a", "2", 0, True), ("a", "2", 1, False), ("a", "3", 0, True), ("b", "9", 0, True)],
        "queue_slug string, spool_file string, batch bigint, ok boolean",
    )
    done = ev.delivered_files(outcomes)
    assert rows(done) == [("a", "1"), ("b", "9")]
    left = ev.pending(outcomes, done, ["queue_slug", "spool_file"]).select("spool_file").distinct()
    assert rows(left) == [("2",), ("3",)]


@pytest.fixture
def registry(spark):
    return spark.createDataFrame([("/h/.claude-a", "device-token-claude-a"), ("/h/.claude-b/", "old")], "config_dir string, token_key string")


def dirs(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "config_dir string")


def test_default_entry_is_always_there(spark, registry):
    full = reg.with_default(registry, F.lit(DEFAULT))
    assert ("/h/.claude", DEFAULT_TOKEN_KEY) in rows(full)
    again = reg.with_default(full, F.lit(DEFAULT + "/"))
    assert again.count() == 3


def test_upsert(spark, registry):
    asked = dirs(spark, "/h/.claude-a", "/h/.claude-b", "/h/.claude-c", "/x/claude-a", "/y/.Claude-C")
    out = {r.config_dir: (r.token_key, r.status) for r in reg.upsert(registry, asked, F.lit(DEFAULT)).collect()}
    assert out == {
        "/h/.claude-a": ("device-token-claude-a", "updated"),
        "/h/.claude-b": ("device-token-claude-b", "updated"),
        "/h/.claude-c": ("device-token-claude-c", "added"),
        "/x/claude-a": ("device-token-claude-a", "collision"),
        "/y/.Claude-C": ("device-token-claude-c", "collision"),
    }
    assert rows(reg.collisions(asked, F.lit(DEFAULT))) == [("device-token-claude-a", 2), ("device-token-claude-c", 2)]


def test_remove(spark, registry):
    full = reg.with_default(registry, F.lit(DEFAULT))
    unwanted = dirs(spark, "/h/.claude-b", DEFAULT, "/none")
    assert rows(reg.remove(full, unwanted, F.lit(DEFAULT)).select("config_dir")) == [("/h/.claude",), ("/h/.claude-a",)]
    report = reg.removal_report(full, unwanted, F.lit(DEFAULT)).select("config_dir", "outcome")
    assert rows(report) == [("/h/.claude", "refused"), ("/h/.claude-b", "removed"), ("/none", "not found")]


def test_status_and_primary(spark, registry):
    full = reg.with_default(registry, F.lit(DEFAULT))
    tokens = spark.createDataFrame([("old", "t"), (DEFAULT_TOKEN_KEY, "")], "token_key string, token string")
    status = reg.enrollment_status(full, tokens).select("token_key", "status")
    assert rows(status) == [("device-token", "no token"), ("device-token-claude-a", "no token"), ("old", "enrolled")]
    assert reg.primary_only(full, tokens, F.lit(DEFAULT)).count() == 0
    assert reg.primary_only(full, tokens.withColumn("token", F.lit("t")), F.lit(DEFAULT)).count() == 1


def test_only_enrolled_directories_are_attributed(spark, registry):
    events = spark.createDataFrame([("/h/.claude-a/projects/p/s.jsonl",), ("/h/.claude-z/projects/p/s.jsonl",)], "path string")
    from turnloom.functions.paths import owner_dir

    owned = reg.attribute_events(events, registry, owner_dir(F.col("path")))
    assert rows(owned.select("token_key", "queue_slug")) == [("device-token-claude-a", "claude-a")]


def test_reports_and_cursor_merge(spark):
    failures = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b")], "source string, dir string")
    summary = reports.failure_summary(failures).withColumn("message", reports.failure_message())
    assert rows(summary) == [("x", 2, "a, b", "2개 폴더 수집 실패: a, b")]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, cursor bigint")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "path string, cursor bigint")
    assert rows(cur.merge_cursors(old, new)) == [("a", 1), ("b", 3), ("c", 4)]
