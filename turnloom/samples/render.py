"""Render the ``conversations`` table as raw session-log lines, so that whole passes can be run
and checked on it. Every choice is a plain function of the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import BLOCK_PREFIXES, ROLLOUT_PREFIXES
from turnloom.functions.wire import format_wire_ts
from turnloom.operators.ordered import with_line_positions

ROOT = "/logs"
BLOCK_ROOT = f"{ROOT}/.claude"
ROLLOUT_ROOT = f"{ROOT}/.codex"
SEQ_PER_TURN = 4
SEQ_CHUNK = 4096

# Models named in rendered answers and announcements.
MODELS = ["model-a", "model-b", "<synthetic>"]

#: Rows whose (conv_id + turn) leaves one of these behind get one more line, which opens no turn and answers none.
BLOCK_NOISE, ROLLOUT_NOISE = 9, 7


def _mod(value: str, n: int) -> Column:
    return F.expr(value) % n


def _model() -> Column:
    pick = _mod("conv_id + turn", len(MODELS))
    out = F.lit(MODELS[-1])
    for i, name in enumerate(MODELS[:-1]):
        out = F.when(pick == i, name).otherwise(out)
    return out


def _ts() -> Column:
    """One second per turn, one day per conversation, from 2026-01-01."""
    return F.concat(
        format_wire_ts(F.timestamp_seconds(F.lit(1767225600) + F.col("conv_id") * 86400 + F.col("turn"))),
        F.lit(".250Z"),
    )


def _text_block(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"))


def block_log_lines(conversations: DataFrame) -> DataFrame:
    """(path, seq, line): user rows as prompts, assistant rows as answers (some logged twice, as split
    messages are), system rows as injected user lines, and lines that no turn takes up."""
    session = F.concat(F.lit("s"), F.col("conv_id"))
    base = conversations.select(
        F.concat(F.lit(f"{BLOCK_ROOT}/projects/p"), _mod("conv_id", 7), F.lit("/"), session, F.lit(".jsonl")).alias("path"),
        "conv_id",
        "turn",
        "role",
        "text",
        _ts().alias("timestamp"),
        session.alias("sessionId"),
        F.concat(F.lit("/work/p"), _mod("conv_id", 7)).alias("cwd"),
        F.when(_mod("conv_id", 3) == 0, F.lit("main")).otherwise(F.lit("")).alias("gitBranch"),
        F.when(_mod("conv_id", 4) == 0, "cli").when(_mod("conv_id", 4) == 1, "sdk-cli").when(_mod("conv_id", 4) == 2, "claude-desktop").alias("entrypoint"),
    )
    head = [F.lit(False).alias("isSidechain"), "sessionId", "cwd", "gitBranch", "entrypoint", "timestamp"]

    def user(content: Column) -> Column:
        return F.to_json(F.struct(F.lit("user").alias("type"), *head, F.struct(F.lit("user").alias("role"), content.alias("content")).alias("message")))

    answer = F.to_json(
        F.struct(
            F.lit("assistant").alias("type"),
            *head,
            F.struct(
                F.when(_mod("conv_id + turn", 6) < 5, F.concat(F.lit("m"), F.col("turn"))).alias("id"),
                F.lit("assistant").alias("role"),
                _model().alias("model"),
                F.array(_text_block(F.col("text"))).alias("content"),
                F.struct(F.length("text").alias("output_tokens")).alias("usage"),
                F.when(_mod("conv_id", 10) == 4, "max_tokens").when(_mod("turn", 3) == 0, "stop_sequence").otherwise("end_turn").alias("stop_reason"),
            ).alias("message"),
        )
    )
    line = (
        F.when(F.col("role") == "assistant", answer)
        .when(F.col("role") == "system", user(F.concat(F.lit("<system-reminder>"), F.col("text"))))
        .when(_mod("conv_id", 2) == 0, user(F.col("text")))
        .otherwise(user(F.array(_text_block(F.col("text")))))
    )
    copies = F.when((F.col("role") == "assistant") & (_mod("turn", 4) == 1), F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    pick = _mod("conv_id + turn", BLOCK_NOISE)
    noise = F.lit(None).cast("string")
    for i, prefix in enumerate(BLOCK_PREFIXES):
        noise = F.when(pick == i, user(F.concat(F.lit(f" \n{prefix} "), F.col("text")))).otherwise(noise)
    n = len(BLOCK_PREFIXES)
    tool = F.array(F.struct(F.lit("tool_result").alias("type"), F.col("text").alias("content")))
    side = F.to_json(F.struct(F.lit("user").alias("type"), F.lit(True).alias("isSidechain"), F.struct(F.col("text").alias("content")).alias("message")))
    noise = F.when(pick == n, user(tool)).when(pick == n + 1, F.concat(F.lit('{"type":"user",'), "text")).when(pick == n + 2, side).otherwise(noise)
    lines = F.concat(F.transform(copies, lambda k: F.struct(k.alias("k"), line.alias("line"))), F.array(F.struct(F.lit(SEQ_PER_TURN - 1).alias("k"), noise.alias("line"))))
    return base.select("path", "conv_id", "turn", F.inline(F.filter(lines, lambda x: x.line.isNotNull()))).select(
        "path", "conv_id", (F.col("turn") * SEQ_PER_TURN + F.col("k")).alias("seq"), "line"
    )


def rollout_log_lines(conversations: DataFrame) -> DataFrame:
    """(path, seq, line): a header, a model announcement before some prompts, messages; some answers
    are left out so that prompts follow prompts; records that are no messages of a talk."""
    path = F.concat(F.lit(f"{ROLLOUT_ROOT}/sessions/2026/01/0"), _mod("conv_id", 9) + 1, F.lit("/rollout-"), F.col("conv_id"), F.lit(".jsonl"))
    base = conversations.select("conv_id", "turn", "role", "text", path.alias("path"), _ts().alias("timestamp"))

    def record(kind: str, payload: Column) -> Column:
        return F.to_json(F.struct("timestamp", F.lit(kind).alias("type"), payload.alias("payload")))

    header = record(
        "session_meta",
        F.struct(
            F.concat(F.lit("r"), F.col("conv_id")).alias("id"),
            F.concat(F.lit("/work/r"), _mod("conv_id", 5)).alias("cwd"),
            F.lit("codex-tui").alias("originator"),
            F.when(_mod("conv_id", 11) == 0, "exec").otherwise("cli").alias("source"),
        ),
    )
    context = record("turn_context", F.struct(_model().alias("model"), F.lit("/work").alias("cwd")))
    role = F.when(F.col("role") == "system", "developer").otherwise(F.col("role"))
    kind = F.when(F.col("role") == "assistant", "output_text").otherwise("input_text").alias("type")
    fragment = lambda text: F.struct(kind, text.alias("text"))
    whole, half = F.array(fragment(F.col("text"))), F.length("text") / 2
    halves = F.array(fragment(F.substring("text", F.lit(1), half.cast("int"))), fragment(F.substring("text", half.cast("int") + 1, F.length("text"))))
    message = record(
        "response_item",
        F.struct(F.lit("message").alias("type"), role.alias("role"), F.when(_mod("conv_id", 3) == 1, halves).otherwise(whole).alias("content")),
    )
    injected = F.array(F.struct(F.lit("input_text").alias("type"), F.concat(F.lit(ROLLOUT_PREFIXES[0]), "text").alias("text")))
    pick = _mod("conv_id + turn", ROLLOUT_NOISE)
    noise = (
        F.when(pick == 0, record("response_item", F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), injected.alias("content"))))
        .when(pick == 1, record("compacted", F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("replacement_history"))))
        .when(pick == 2, record("response_item", F.struct(F.lit("reasoning").alias("type"), F.lit("user").alias("role"), whole.alias("content"))))
        .when(pick == 3, F.concat(F.lit('{"type":"response_item",'), "text"))
    )
    dropped = (F.col("role") == "assistant") & (_mod("conv_id", 5) == 0) & (_mod("turn", 4) == 1)
    lines = F.filter(
        F.array(
            F.struct(F.lit(0).alias("k"), F.when(F.col("turn") == 0, header).alias("line")),
            F.struct(F.lit(1).alias("k"), F.when((F.col("role") == "user") & (_mod("turn", 4) == 2), context).alias("line")),
            F.struct(F.lit(2).alias("k"), F.when(~dropped, message).alias("line")),
            F.struct(F.lit(3).alias("k"), noise.alias("line")),
        ),
        lambda x: x.line.isNotNull(),
    )
    return base.select("path", "conv_id", "turn", F.inline(lines)).select(
        "path", "conv_id", (F.col("turn") * SEQ_PER_TURN + F.col("k")).alias("seq"), "line"
    )


def as_file_lines(rendered: DataFrame, idle: Column, start: Column | None = None) -> DataFrame:
    """Give rendered lines their byte offsets and file facts, as if they had been read from files."""
    placed = with_line_positions(rendered, ["path"], ["seq"], F.expr(f"seq div {SEQ_CHUNK}"), "line")
    return placed.select(
        "path",
        "file_size",
        (F.lit(0) if start is None else start).cast("bigint").alias("start_offset"),
        "byte_offset",
        "line",
        F.lit(True).alias("terminated"),
        idle.alias("file_idle"),
        "conv_id",
        "seq",
    )


STORE_ROOT = f"{ROOT}/.gemini"


def chat_store_files(conversations: DataFrame, layouts: Column) -> DataFrame:
    """(path, conv_id, seq, line): sessions as files of a chat store, one for each of ``layouts`` (array of 'nested', 'whole', 'journal').

    A document is written over many lines. Prompts are arrays of two parts or strings; notices, patches, rows of type null, slash prompts and
    empty ones stand between the messages. Texts of a layout that a richer one of the same session outdoes end with its name.
    """
    session = F.concat(F.lit("g"), F.col("conv_id"))
    placed = conversations.withColumn("layouts", layouts).select("*", F.explode("layouts").alias("layout"))
    folder = F.concat(F.lit(f"{STORE_ROOT}/tmp/p"), _mod("conv_id", 4), F.lit("/chats/"))
    path = (
        F.when(F.col("layout") == "nested", F.concat(folder, session, F.lit("/part.jsonl")))
        .when(F.col("layout") == "whole", F.concat(folder, F.lit("session-"), session, F.lit(".json")))
        .otherwise(F.concat(folder, F.lit("session-"), session, F.lit(".jsonl")))
    )
    outdone = ((F.col("layout") == "journal") & (F.size("layouts") > 1)) | ((F.col("layout") == "whole") & F.array_contains("layouts", "nested"))
    text = F.when(outdone, F.concat("text", F.lit(" "), "layout")).otherwise(F.col("text"))
    base = placed.select(path.alias("path"), "conv_id", "turn", "role", "layout", session.alias("sessionId"), text.alias("text"), _ts().alias("timestamp"))
    half = F.floor(F.length("text") / 2).cast("int")
    part = lambda t: F.struct(t.alias("text"))
    parts = F.array(part(F.substring("text", F.lit(1), half)), part(F.substring("text", half + 1, F.length("text"))))
    typed = lambda kind, content, *more: F.to_json(F.struct(F.lit(kind).alias("type"), content.alias("content"), "timestamp", *more))
    message = (
        F.when(F.col("role") == "assistant", typed("gemini", F.col("text"), _model().alias("model")))
        .when(F.col("role") == "system", typed("info", F.col("text")))
        .when(_mod("turn", 4) == 0, typed("user", parts)).otherwise(typed("user", F.col("text")))
    )
    pick = _mod("conv_id + turn", 5)
    noise = (
        F.when(pick == 0, F.when(F.col("layout") != "whole", F.lit('{"$set":{"lastUpdated":"2026-01-01T00:00:00Z","type":"user"}}')))
        .when(pick == 1, F.lit('{"type":null,"content":"nothing"}')).when(pick == 2, typed("user", F.concat(F.lit("/help "), F.col("text")))).when(pick == 3, typed("user", F.lit(" ")))
    )
    in_document = F.col("layout") == "whole"
    directories = F.when(F.col("layout") == "nested", F.array(F.concat(F.lit("/work/g"), _mod("conv_id", 5))))
    head = F.to_json(F.struct("sessionId", directories.alias("directories")))
    opening = F.when(in_document, F.concat(F.lit('{"messages":[\n'), F.lit('{"type":"info"}'))).otherwise(head)
    comma = lambda line: F.when(in_document, F.concat(F.lit(","), line)).otherwise(line)
    lines = F.array(
        F.struct(F.lit(0).alias("k"), F.when(F.col("turn") == 0, opening).alias("line")), F.struct(F.lit(1).alias("k"), comma(message).alias("line")), F.struct(F.lit(2).alias("k"), comma(noise).alias("line"))
    )
    rows = base.select("path", "conv_id", "turn", F.inline(F.filter(lines, lambda x: x.line.isNotNull())))
    ends = base.filter(in_document).groupBy("path", "conv_id", "sessionId").agg(F.max("turn").alias("turn")).select("path", "conv_id", "turn", F.lit(3).alias("k"), F.concat(F.lit('],"sessionId":"'), "sessionId", F.lit('"}')).alias("line"))
    return rows.unionByName(ends).select("path", "conv_id", (F.col("turn") * SEQ_PER_TURN + F.col("k")).alias("seq"), "line")
