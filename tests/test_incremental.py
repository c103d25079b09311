"""What grows from pass to pass: stored identities, the spool as a stream, listings as versions, turns held in state."""

import json
import os
import resource
import time

import pytest
from helpers import reply, user
from pyspark.sql import functions as F
from test_collect import BLOCK, FUTURE, PAST, TALK, TOKEN, home, tokens  # noqa: F401

from turnloom.functions.wire import to_wire
from turnloom.plans import collect as pl
from turnloom.sources import files as fl
from turnloom.sources import tables
from turnloom.sources.identities import IdentityStore, identity
from turnloom.streaming import delivery, growth, jobs

# --- identities --------------------------------------------------------------------------------------------------


def events(spark, rows):
    return spark.createDataFrame(rows, "queue_slug string, content_hash string, at bigint").withColumn("identity", identity())


def emit(store, rows, number, folder):
    store.fresh(rows, ["at"], number).write.mode("overwrite").parquet(f"{folder}/{number}")
    out = rows.sparkSession.read.parquet(f"{folder}/{number}")
    store.record(out, number)
    return sorted((r.queue_slug, r.content_hash, r.at) for r in out.collect())


def test_passes_emit_what_is_new(spark, tmp_path):
    store, out = IdentityStore(f"{tmp_path}/store", 3), f"{tmp_path}/out"
    store.fresh(events(spark, [("q", "a", 2), ("q", "a", 1), ("r", "a", 5), (None, None, 7)]), ["at"], "1").write.parquet(f"{out}/1")
    store.record(spark.read.parquet(f"{out}/1"), "1")
    first = {(r.queue_slug, r.content_hash, r.at) for r in spark.read.parquet(f"{out}/1").collect()}
    assert first == {("q", "a", 1), ("r", "a", 5), (None, None, 7)}
    assert emit(store, events(spark, [("q", "a", 0), ("q", "b", 3)] + [("q", "hot", k) for k in range(500)]), "2", out) == [("q", "b", 3), ("q", "hot", 0)]
    # Redone, with other rows than the first time: the earlier try leaves nothing behind.
    assert emit(store, events(spark, [("q", "c", 3), ("q", "a", 0)]), "2", out) == [("q", "c", 3)]
    assert emit(store, events(spark, [("q", "b", 9), ("q", "c", 9)]), "3", out) == [("q", "b", 9)]
    assert emit(store, events(spark, []), "4", out) == []
    store.rebuild(spark, "3", 5)
    assert store.passes(spark) == ["2", "3", "4"] and store.table(spark)[1] == 5
    again = IdentityStore(f"{tmp_path}/store", 64)  # an existing store keeps its number of buckets
    assert again.table(spark)[1] == 5 and emit(again, events(spark, [("q", "b", 9), ("q", "d", 1)]), "5", out) == [("q", "d", 1)]


def test_probe_reads_identities_only_and_does_not_shuffle_the_store(spark, tmp_path):
    store = IdentityStore(f"{tmp_path}/store", 4)
    emit(store, events(spark, [("q", str(k), k) for k in range(50)]), "1", f"{tmp_path}/out")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = store.fresh(events(spark, [("q", "1", 1)]), ["at"], "2")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scans = [part for part in plan.split("\n\n") if "Scan parquet" in part and "identities_" in part and "ReadSchema" in part]
    assert len(scans) == 1 and "ReadSchema: struct<identity:binary>" in scans[0] and "Bucketed: true" in scans[0]


def test_run_once_spools_no_event_twice(spark, home, tokens):  # noqa: F811
    job = pl.Job(home.job.globs, home.job.state, "9.9", 128, identity_buckets=2)
    registry = home.entries(spark, (".claude", "device-token"))
    spooled = lambda: sorted(r.prompt_text for r in tables.spooled_events(spark, job.table("spool")).collect())
    home.put(BLOCK, TALK)
    pl.run_once(spark, job, registry, tokens, FUTURE, "1")
    assert spooled() == ["second", "use «REDACTED»"]
    # The same talk under another name, and a pass that ended before it could store its identities or cursors.
    home.put(BLOCK.replace("s1", "s2"), TALK)
    tables.remove(spark, [f"{job.table('cursors')}/pass_id=1", f"{job.table('identities')}/v1-2/pass_id=1"])
    pl.run_once(spark, job, registry, tokens, FUTURE, "2")
    assert spooled() == ["second", "use «REDACTED»"]
    home.put(BLOCK, [*TALK, user("third"), reply("m3", "x")])
    for _ in range(2):
        pl.run_once(spark, job, registry, tokens, FUTURE, "3")
    assert spooled() == ["second", "third", "use «REDACTED»"]


# --- delivery as a stream ----------------------------------------------------------------------------------------


def spool(spark, job, number, rows):
    made = spark.createDataFrame(rows, "queue_slug string, prompt_offset bigint, prompt_text string").selectExpr(
        "*", "'f' as path", "'CODEX' as source_tool", "'cli' as surface", "'' as session_id", "'' as response_text", "timestamp'2026-01-01' as prompt_ts",
        "0L as token_count", "'' as project_context", "'1' as client_version", "'' as model", "'h' as content_hash",
    )
    tables.write_spool(to_wire(made).select("event_json", "path", "prompt_offset", "content_hash", "queue_slug"), job.table("spool"), number)


def test_failed_queue_is_held_in_order_and_taken_up(spark, tmp_path):
    job = pl.Job({}, f"{tmp_path}/state", "1.0")
    log = f"{tmp_path}/got"

    def send(broken):
        def one(queue, file, batch, body):
            if queue == "bad" and broken:
                raise OSError("no")
            with open(log, "a") as f:
                f.write(f"{queue} {[e['promptText'] for e in json.loads(body)['events']]}\n")
            return True

        return one

    def run(broken):
        delivery.deliver_stream(spark, job, send(broken), trigger={"availableNow": True}, files_per_trigger=1).awaitTermination()
        got = open(log).read().split("\n")[:-1] if os.path.exists(log) else []
        open(log, "w").close()
        return got

    spool(spark, job, "1", [("bad", 1, "a"), ("good", 1, "b")])
    spool(spark, job, "2", [("bad", 2, "c")])
    assert run(True) == ["good ['b']"]
    spool(spark, job, "3", [("bad", 3, "d"), ("good", 3, "e")])
    broken = spark.createDataFrame([("{", "f", 1, "h", "good")], "event_json string, path string, prompt_offset bigint, content_hash string, queue_slug string")
    tables.write_spool(broken, job.table("spool"), "4")
    assert run(True) == ["good ['e']"]
    assert run(False) == ["bad ['a']", "bad ['c']", "bad ['d']"]
    assert run(False) == []
    done = tables.read_delivered(spark, job.table("delivered")).select("queue_slug", F.col("spool_file").substr(1, 1).alias("p")).distinct().collect()
    assert sorted(map(tuple, done)) == [("bad", "1"), ("bad", "2"), ("bad", "3"), ("good", "1"), ("good", "3"), ("good", "4")]
    assert spark.read.parquet(job.table("quarantine")).count() == 1


def test_replayed_micro_batch_sends_nothing_again(spark, tmp_path):
    job = pl.Job({}, f"{tmp_path}/state", "1.0")
    spool(spark, job, "1", [("q", 1, "a")])
    rows = tables.read_spool(spark, job.table("spool"))
    delivery.hand_over(spark, job, "s", rows, 0, lambda *_: True)

    def never(*_):
        raise AssertionError

    delivery.hand_over(spark, job, "s", rows, 0, never)
    assert spark.read.parquet(job.table("outcomes")).count() == 1 and spark.read.schema(delivery.BODIES).parquet(job.table("held")).count() == 0


def test_closed_queue_keeps_each_body_once_and_is_tried_at_one_place(spark, tmp_path):
    job, sent = pl.Job({}, f"{tmp_path}/state", "1.0"), f"{tmp_path}/sent"

    def give(number, accept, rows=None):
        def one(queue, file, batch, body):
            texts = "".join(e["promptText"][0] for e in json.loads(body)["events"][:1])
            with open(sent, "a") as f:
                f.write(f"{queue}{texts} ")
            return queue == "good" or texts in accept

        spool(spark, job, f"{number}", rows or [("bad", k, f"{'abcdef'[number]}{k}") for k in range(150)] + [("good", 1, "x")])
        new = tables.read_spool(spark, job.table("spool")).filter(F.col("pass_id") == str(number))
        delivery.hand_over(spark, job, "s", new, number, one)
        delivery.hand_over(spark, job, "s", new, number, lambda *_: 1 / 0)  # a replay
        out = open(sent).read().split()
        open(sent, "w").close()
        held = spark.read.schema(delivery.BODIES).parquet(f"{job.table('held')}/run_id=s-{number:012d}").count()
        return sorted(x for x in out if x[0] == "g"), [x for x in out if x[0] == "b"], held

    for number in range(4):
        assert give(number, "") == (["goodx"], ["bada"], 1)
    kept = spark.read.parquet(job.table("outcomes")).filter("kept AND arrival = taken_in").groupBy("arrival").count()
    assert {r.arrival: r["count"] for r in kept.collect() if r.arrival} == {1: 2, 2: 2, 3: 2}
    # It opens, and closes again inside what was kept; then for good.
    assert give(4, "ab") == (["goodx"], ["bada", "bada", "badb", "badb", "badc"], 1)
    assert give(5, "abcdef") == (["goodx"], ["badc", "badc", "badd", "badd", "bade", "bade", "badf", "badf"], 0)
    assert not [f for f, _, _ in os.walk(job.table("outcomes")) if f.endswith("kept=true") and "-first" not in f and "000005" not in f]
    done = tables.read_delivered(spark, job.table("delivered")).groupBy("queue_slug", "spool_file").count().collect()
    assert len(done) == 12 and {r["count"] for r in done} == {1}


# --- growing files -----------------------------------------------------------------------------------------------


def read_stream(spark, state, out):
    query = growth.stream_grown_lines(spark, state, tasks=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return sorted((os.path.basename(r.path), r.byte_offset, r.line, r.error and r.error.split(":")[0]) for r in spark.read.schema(growth.SCHEMA).parquet(out).collect())


def test_lines_of_growing_files_come_once(spark, tmp_path):
    logs, state, out = tmp_path / "logs", f"{tmp_path}/state", f"{tmp_path}/out"
    logs.mkdir()
    (logs / "a").write_bytes("é1\nhalf".encode())
    (logs / "empty").write_bytes(b"")
    (logs / "gone").write_bytes(b"x\n")
    take = lambda: growth.take_listing(spark, [f"{logs}/*"], state, 4)
    assert take() == 1
    os.remove(logs / "gone")
    first = read_stream(spark, state, out)
    assert first == [("a", 0, "é1", None), ("gone", 0, None, "FileNotFoundError")]
    (logs / "a").write_bytes("é1\nhalf a line\n\nlast".encode())
    assert take() == 2 and take() == 3
    second = read_stream(spark, state, out)
    assert second == [("a", 0, "é1", None), ("a", 4, "half a line", None), ("a", 16, "", None), ("gone", 0, None, "FileNotFoundError")]
    (logs / "a").write_bytes(b"new\n")  # shorter: replaced
    tables.remove(spark, [f"{state}/ranges/{growth._version(3)}"])  # a run that ended between listing and ranges
    assert take() == 4
    assert [r for r in read_stream(spark, state, out) if r not in second] == [("a", 0, "new", None)]
    assert len(tables.subfolders(spark, f"{state}/listings")) == 2


def test_line_beyond_the_limit_is_an_error_before_it_is_held(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fl, "MAX_LINE_BYTES", 1 << 20)
    (tmp_path / "a").write_bytes(b"ok\n" + b"x" * (40 << 20) + b"\nlast\n")
    read = fl.read_range(f"{tmp_path}/a", 0, 0, 50 << 20, os.path.getsize(tmp_path / "a"))
    with pytest.raises(fl.LineTooLong):
        list(read)


def test_listing_of_many_files_takes_no_driver_memory(spark, tmp_path):
    """100,000 files: the driver's own process grows by less than 100 bytes a file."""
    for d in range(100):
        (tmp_path / "logs" / str(d)).mkdir(parents=True)
        for k in range(1000):
            with open(tmp_path / "logs" / str(d) / f"{k}.log", "wb") as f:
                f.write(b"line\n")
    growth.take_listing(spark, [f"{tmp_path}/none/*/*.log"], f"{tmp_path}/warm")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert growth.take_listing(spark, [f"{tmp_path}/logs/*/*.log"], f"{tmp_path}/state") == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 10_000  # KB
    assert spark.read.parquet(f"{tmp_path}/state/ranges").count() == 100_000


# --- turns in state ----------------------------------------------------------------------------------------------


def test_state_holds_open_turns_and_timers_release_them(spark, home):  # noqa: F811
    state, seen = f"{home.root}/grown", []
    globs = home.job.globs["CLAUDE_CODE"]

    def run(until, idle_ms):
        lines = growth.stream_grown_lines(spark, state, tasks=2)
        query = jobs.settled_lines(lines, idle_ms).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect()))
        query = query.option("checkpointLocation", f"{home.root}/checkpoint").trigger(processingTime="0 seconds").start()
        end = time.monotonic() + 120
        while not until(query) and time.monotonic() < end:
            assert query.exception() is None
            time.sleep(0.2)
        query.stop()

    def read(query):
        """All new rows were read, and a trigger without rows came behind them."""
        rows = [p["numInputRows"] for p in query.recentProgress]
        return any(rows) and rows[-1] == 0

    long, short = 3_600_000, 1
    home.put(BLOCK, TALK[:2])
    growth.take_listing(spark, globs, state)
    run(read, long)
    assert not seen  # answered, but the file does not rest yet
    home.put(BLOCK, TALK[:3])
    growth.take_listing(spark, globs, state)
    run(read, long)
    assert [json.loads(r.line)["type"] for r in seen] == ["user", "assistant"]
    home.put(BLOCK, [*TALK, user("third"), user("fourth")])
    home.put(BLOCK.replace("s1", "s2"), [user("alone"), reply("m9", "yes")])
    growth.take_listing(spark, globs, state)
    run(lambda _: len({(r.path, r.byte_offset) for r in seen}) >= 7, short)
    released = spark.createDataFrame(seen, jobs.RELEASED)
    turns = jobs.turns_of_released(released).collect()
    assert {(t.prompt_text, t.response_text) for t in turns} == {(f"use {TOKEN}", "token = abc"), ("second", "done"), ("third", None), ("alone", "yes")}
    assert len(seen) == 7  # the unanswered prompt stays in state
    assert PAST < FUTURE
