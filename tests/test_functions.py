import pytest
from pyspark.sql import functions as F

from turnloom.functions import paths as ph
from turnloom.functions import text as tx
from turnloom.functions.timestamps import format_wire_ts, parse_rfc3339
from turnloom.functions.wire import content_hash, from_wire, to_wire
from turnloom.sources.files import start_offset


def apply(spark, values, fn, ddl="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + ddl)
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


RUN = "Zz0" * 8
SECRETS = [
    (f"first sk-{RUN} then sk-{RUN}", "first «REDACTED» then «REDACTED»"),
    (f"short sk-{RUN[:19]}", f"short sk-{RUN[:19]}"),
    (f"-----BEGIN KEY-----{RUN}\n-----END KEY----- ok -----BEGIN A KEY-----", "«REDACTED» ok -----BEGIN A KEY-----"),
    *((f"gh{c}_{RUN}.", "«REDACTED»." if c in "pousr" else f"gh{c}_{RUN}.") for c in "opqrsux"),
    (f"AKIA{'Q7' * 8}q", "«REDACTED»q"),
    (f"akia{'Q7' * 8}", f"akia{'Q7' * 8}"),
    ("(ya29.x_Y-0)", "(«REDACTED»)"),
    ("1//_ and 2//_", "«REDACTED» and 2//_"),
    ("BEARER  q.r-s_t, next", "«REDACTED», next"),
    ("the bearer: nobody", "the bearer: nobody"),
    ("Secret=\tsauce is garlic", "«REDACTED» is garlic"),
    ("api_key =k; APIKEY= k", "«REDACTED» «REDACTED»"),
    ("passwords are = hard", "passwords are = hard"),
    (f"token=gho_{RUN} left", "«REDACTED» left"),
    ("a broken token\v= stays", "a broken token\v= stays"),
    ("seven harbours, no keys", "seven harbours, no keys"),
    ("speed=9 knots", "speed=9 knots"),
    ("", ""),
]


def test_scrub(spark):
    once = apply(spark, [s for s, _ in SECRETS], tx.scrub)
    assert once == [e for _, e in SECRETS]
    assert apply(spark, once, tx.scrub) == once


def test_surface(spark):
    allowed = ["cli", "sdk-cli"]
    given = [*allowed, *(x.upper() for x in allowed), "cli ", "web", "", None]
    assert apply(spark, given, tx.normalize_surface) == [*allowed, *["unknown"] * 6]


def test_slug_and_token_key(spark):
    """A slug is what a plain reading of its rule gives: last part, no leading dots, lower case, one dash for all else."""
    import re

    parts = ["tools", ".tools", "..Sea_Map-", "Ÿ", "--", "a.b..c", "NORTH west", ".claude-ferry.9", "日本x"]
    given = [f"/srv/{i}/{p}{'/' * (i % 3)}" for i, p in enumerate(parts)]
    want = [re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", p.lstrip(".").lower())) or "claude" for p in parts]
    assert apply(spark, given, ph.slug) == want
    keys = apply(spark, [*given, "/srv/x/../0/tools//"], lambda v: ph.token_key(v, F.lit("/srv/./0/tools/")))
    assert keys == ["device-token", *(f"device-token-{w}" for w in want[1:]), "device-token"]


@pytest.mark.parametrize(
    "raw, clean",
    [("/a//b/./c/", "/a/b/c"), ("/../a/..", "/"), ("a/../../b", "../b"), ("", "."), ("a/..", "."), ("../..", "../.."), ("/", "/")],
)
def test_clean_dir(spark, raw, clean):
    assert apply(spark, [raw], ph.clean_dir) == [clean]


def test_owner_dirs(spark):
    given = ["file:/h/.claude/projects/p/s.jsonl", "/h/.claude/projects/p/q/s.jsonl", "/h/.claude/projects/p/s.txt"]
    assert apply(spark, given, ph.owner_dir) == ["/h/.claude", None, None]
    assert apply(spark, ["/h/.codex/sessions/2026/01/02/rollout-1.jsonl", "/h/x"], ph.home_default_dir) == ["/h/.claude", None]


def test_timestamps(spark):
    given = {
        "2026-06-24T09:00:00Z": "2026-06-24T09:00:00",
        "2026-06-24T09:00:00.999999999Z": "2026-06-24T09:00:00",
        "2026-06-24T09:00:00,5+09:00": "2026-06-24T00:00:00",
        "2026-06-24T23:30:00-23:59": "2026-06-25T23:29:00",
        "2026-06-24 09:00:00Z": "0001-01-01T00:00:00",
        "2026-06-24": "0001-01-01T00:00:00",
        "2026-02-30T09:00:00Z": "0001-01-01T00:00:00",
        "2026-06-24T09:00:00": "0001-01-01T00:00:00",
        "": "0001-01-01T00:00:00",
        "2026-06-24T09:00:00+25:00": "0001-01-01T00:00:00",
    }
    assert apply(spark, list(given), lambda v: format_wire_ts(parse_rfc3339(v))) == list(given.values())


def test_start_offset(spark):
    cases = [("10", 5, 100, 10), (None, 50, 100, 50), ("", 50, 100, 50), ("x", 50, 100, 0), ("101", None, 100, 0), ("100", None, 100, 100), (None, None, 9, 0)]
    df = spark.createDataFrame([c[:3] for c in cases], "c string, l bigint, s bigint")
    assert [r[0] for r in df.select(start_offset(F.col("c"), F.col("l"), F.col("s"))).collect()] == [c[3] for c in cases]


EVENT = (
    "source_tool string, surface string, session_id string, prompt_text string, response_text string, prompt_ts timestamp, "
    "token_count bigint, project_context string, client_version string, model string"
)


def test_wire_round_trip_and_hash(spark):
    rows = spark.sql(
        """select 'T' source_tool, 'cli' surface, cast(null as string) session_id, 'hi "x"' prompt_text, '' response_text,
           timestamp'2026-06-24 09:00:00.7' prompt_ts, 0L token_count, '' project_context, '1' client_version, 'm' model"""
    )
    encoded = to_wire(rows)
    (text,) = [r.event_json for r in encoded.collect()]
    assert text == (
        '{"sourceTool":"T","surface":"cli","promptText":"hi \\"x\\"","promptTs":"2026-06-24T09:00:00",'
        '"tokenCount":0,"clientVersion":"1","model":"m"}'
    )
    back = from_wire(encoded.select("event_json")).first()
    assert (back.token_count, back.response_text, str(back.prompt_ts)) == (0, None, "2026-06-24 09:00:00")
    import hashlib

    expected = hashlib.sha256(b'T||hi "x"|2026-06-24T09:00:00').hexdigest()
    assert rows.select(content_hash()).first()[0] == expected
