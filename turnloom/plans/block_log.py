"""Turns of the block log: one JSON object per line, prompts and answers as text blocks.

A turn opens at a human prompt and runs to the next one. Files that fit one chunk need a single
exchange, on their path; everything after the window (three folding steps) keeps that partitioning.
Larger files are cut into chunks of ``chunk_bytes``, so no task ever sorts a whole file, and the
folding steps spread a long turn over its messages before the last, partially aggregated one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import jsonline as js
from turnloom.functions import paths as ph
from turnloom.functions import text as tx
from turnloom.functions.timestamps import parse_rfc3339
from turnloom.plans.chunks import CHUNK_BYTES, aside, chunk_of, exchange_chunks, spans_chunks, summarize_chunks, unpack_rows

# Fixed values of the format.
SOURCE_TOOL = "CLAUDE_CODE"
SYNTHETIC_MODEL = "<synthetic>"
TERMINAL_STOPS = ["end_turn", "stop_sequence"]
FILE_GLOB = "projects/*/*.jsonl"
READS_FROM_START = False
NEEDS_HEADER = False

_LINE_FIELDS = ["type", "isSidechain", "sessionId", "cwd", "gitBranch", "entrypoint", "timestamp", "message"]
_LINE_TEXT = ["type", "sessionId", "cwd", "gitBranch", "entrypoint", "timestamp"]
_MESSAGE_FIELDS = ["id", "role", "model", "content", "usage", "stop_reason"]
_MESSAGE_TEXT = ["id", "role", "model", "stop_reason"]


def owner_dir(path: Column) -> Column:
    """The enrolled directory a file belongs to."""
    return ph.owner_dir(path)


def parse(lines: DataFrame) -> DataFrame:
    """Decode raw lines. ``valid`` marks lines that fit the format; fields of others are unset."""
    files = [c for c in lines.columns if c != "line"]
    checks = [
        "_.o is not null",
        *[js.is_text_or_absent("_.o." + f) for f in _LINE_TEXT],
        *[js.is_text_or_absent("_.m." + f) for f in _MESSAGE_TEXT],
        js.of_type("_.o.isSidechain", "BOOLEAN", "VOID"),
        js.absent("_.o.message") + " or _.m is not null",
        js.absent("_.m.usage") + " or _.u is not null",
        js.of_type("_.u.output_tokens", "BIGINT", "VOID"),
    ]
    speaker = f"""if({" and ".join(f"({c})" for c in checks)},
        if(coalesce(try_variant_get(_.o.isSidechain, '$', 'boolean'), false), 'side', {js.text_of("_.o.type")}), null)"""
    decoded = js.compute_once(
        lines,
        *js.strict_steps("line"),
        {"o": js.fields_of("_.doc", *_LINE_FIELDS)},
        {"o": "_.o", "m": js.fields_of("_.o.message", *_MESSAGE_FIELDS)},
        {"o": "_.o", "m": "_.m", "u": js.fields_of("_.m.usage", "output_tokens")},
        {
            "speaker": speaker,
            **{f: f"_.o.{f}" for f in ["sessionId", "cwd", "gitBranch", "entrypoint", "timestamp"]},
            **{"m_" + f: f"_.m.{f}" for f in ["id", "model", "content", "stop_reason"]},
            "has_usage": "_.u is not null",
            "output_tokens": "_.u.output_tokens",
        },
    ).drop("line")
    named = "try_variant_get(x.b.type, '$', 'string')"
    blocks = f"""if(speaker in ('user', 'assistant'),
        transform(try_variant_get(m_content, '$', 'array<variant>'),
                  (e, i) -> named_struct('pos', i, 'nil', is_variant_null(e), 'b', {js.fields_of("e", "type", "text")})),
        null)"""
    pieces = f"""if(exists(_.blocks, x -> not x.nil and x.b is null), null,
        filter(transform(filter(_.blocks, x -> {named} = 'text'),
                         x -> named_struct('pos', x.pos, 'text', {js.text_if_string("x.b.text")})),
               p -> p.text != ''))"""
    # A plain string, a null (an empty prompt), or text blocks without any tool output among them.
    user_text = f"""case when coalesce(speaker, '') != 'user' then null
        when _.blocks is not null then if(exists(_.blocks, x -> {named} = 'tool_result'), null,
                                          nullif(array_join(_.pieces.text, ''), ''))
        when {js.json_type("m_content")} = 'STRING' then try_variant_get(m_content, '$', 'string')
        when {js.json_type("m_content")} = 'VOID' then '' end"""
    read = js.compute_once(
        decoded,
        {"blocks": blocks},
        {"blocks": "_.blocks", "pieces": pieces},
        {"user_text": user_text, "pieces": "if(speaker = 'assistant', _.pieces, null)"},
    )

    def reply(sql: str) -> str:
        return f"if(speaker = 'assistant', {sql}, null)"

    head = ", ".join(f"'{f}', {js.text_of(f)}" for f in ["sessionId", "cwd", "gitBranch", "timestamp"])
    return read.selectExpr(
        *files,
        "speaker is not null as valid",
        "speaker",
        "user_text",
        f"if(speaker is not null, nullif({js.text_of('entrypoint')}, ''), null) as entrypoint",
        f"if(user_text is not null, named_struct({head}), null) as head",
        reply(f"coalesce(nullif({js.text_of('m_id')}, ''), concat('line:', {js.text_of('timestamp')}))") + " as msg_id",
        reply("if(has_usage, coalesce(try_variant_get(output_tokens, '$', 'bigint'), 0), null)") + " as tokens",
        reply(f"nullif(nullif({js.text_of('m_model')}, ''), '{SYNTHETIC_MODEL}')") + " as model",
        reply(js.text_of("m_stop_reason")) + " as stop_reason",
        "pieces",
    )


def drop_reason(parsed: DataFrame) -> DataFrame:
    """Why a line opens no turn: ``kept`` for human prompts, otherwise the first rule that failed."""
    text = F.col("user_text")
    return parsed.withColumn(
        "reason",
        F.when(~F.col("valid"), "invalid")
        .when(F.col("speaker") != "user", "not_user")
        .when(text.isNull(), "no_text")
        .when(tx.has_block_marker(text), "marker")
        .when(tx.is_block_synthetic(text), "prefix")
        .otherwise("kept"),
    )


def prompt_marks(parsed: DataFrame) -> DataFrame:
    """Add ``is_prompt``: the line is a person's prompt and opens a turn."""
    synthetic = F.coalesce(tx.is_block_synthetic(F.col("user_text")), F.lit(True))
    return parsed.withColumn("is_prompt", ~synthetic)


def _events(parsed: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows that matter for turns, narrowed before any exchange."""
    marked = parsed.select("*", F.inline(F.array(F.struct(tx.is_block_synthetic(F.col("user_text")).alias("synthetic")))))
    return marked.selectExpr(
        "path",
        "byte_offset",
        f"{chunk_of(chunk_bytes)} as chunk",
        f"{spans_chunks(chunk_bytes)} as spans",
        "file_idle",
        "if(not synthetic, byte_offset, null) as prompt_offset",
        "if(not synthetic, struct(head, user_text as text), null) as prompt",
        "entrypoint",
        "coalesce(speaker = 'assistant', false) as is_reply",
        "msg_id",
        "tokens",
        "model",
        "stop_reason",
        "pieces",
        f"{aside(parsed)} as aside",
    ).filter("prompt_offset is not null or is_reply or entrypoint is not null or aside is not null")


def _scan_whole(rows: DataFrame) -> DataFrame:
    """Turn of every row, for files inside one chunk: one exchange on the path."""
    order = Window.partitionBy("path").orderBy("byte_offset")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(
        "*",
        F.last("prompt_offset", ignorenulls=True).over(so_far).alias("turn"),
        F.max("prompt_offset").over(whole).alias("last_prompt"),
        F.first("entrypoint", ignorenulls=True).over(whole).alias("entry"),
    )


def _scan_chunked(rows: DataFrame) -> DataFrame:
    """Turn of every row, for files of any size: exchange on (path, chunk), summaries per chunk."""
    carried = ["file_idle", "prompt", "is_reply", "msg_id", "tokens", "model", "stop_reason", "pieces", "aside"]
    together = exchange_chunks(rows, ["prompt_offset", "entrypoint"], carried)
    sums = summarize_chunks(
        together,
        F.max("prompt_offset").alias("chunk_prompt"),
        F.min(F.when(F.col("entrypoint").isNotNull(), F.struct("byte_offset", "entrypoint"))).alias("chunk_entry"),
    )
    by_path = Window.partitionBy("path")
    carry = sums.select(
        "path",
        "chunk",
        F.max("chunk_prompt").over(by_path.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.max("chunk_prompt").over(by_path).alias("last_prompt"),
        F.min("chunk_entry").over(by_path)["entrypoint"].alias("entry"),
    )
    so_far = (
        Window.partitionBy("path", "chunk")
        .orderBy("byte_offset")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = unpack_rows(together.withColumn("turn", F.last("prompt_offset", ignorenulls=True).over(so_far)))
    return local.join(carry, ["path", "chunk"], "left").select(
        "path",
        "byte_offset",
        "prompt_offset",
        *carried,
        F.coalesce("turn", "carried").alias("turn"),
        "last_prompt",
        F.coalesce("entry", "entrypoint").alias("entry"),
    )


def _fold(rows: DataFrame) -> DataFrame:
    """One row per turn. Repeats of a (message, text) pair count once, tokens once per message."""
    # Unfinished last lines and read errors travel along as groups of their own.
    piece = rows.filter(
        "aside is not null or (turn is not null and (prompt_offset is not null or is_reply))"
    ).selectExpr("*", "if(aside is null, turn, byte_offset) as at_prompt", "explode_outer(pieces) as piece")
    shared = [
        F.expr(f"{how}({c}) as {c}")
        for how, c in [("max", "prompt"), ("min", "entry"), ("max", "last_prompt"), ("max", "file_idle"), ("max", "aside")]
    ]
    carried = [F.expr("min(answered_by) as answered_by"), F.expr("max(stopped) as stopped"), *shared]
    texts = piece.groupBy("path", "at_prompt", "msg_id", F.col("piece.text").alias("text")).agg(
        F.expr("min(struct(byte_offset, piece.pos)) as at"),
        F.expr("min(if(tokens is null, null, struct(byte_offset, tokens))) as usage"),
        F.expr("min(if(model is null, null, struct(byte_offset, model))) as answered_by"),
        F.expr("max(if(is_reply, struct(byte_offset, stop_reason), null)) as stopped"),
        *shared,
    )
    messages = texts.groupBy("path", "at_prompt", "msg_id").agg(
        F.expr("min(usage).tokens as tokens"),
        F.expr("collect_list(if(text is null, null, struct(at, text))) as pieces"),
        *carried,
    )
    return messages.groupBy("path", "at_prompt").agg(
        F.expr("sum(tokens) as token_count"), F.expr("flatten(collect_list(pieces)) as pieces"), *carried
    )


def _pass_rows(turns: DataFrame) -> DataFrame:
    stops = ", ".join(f"'{s}'" for s in TERMINAL_STOPS)
    judged = turns.selectExpr(
        "*",
        f"""case when aside is not null then aside
                 when at_prompt < last_prompt then 'turn'
                 when file_idle and stopped.stop_reason in ({stops}) then 'turn'
                 else 'held' end as row_kind""",
    )
    is_turn = F.col("row_kind") == "turn"
    return judged.select(
        "row_kind",
        "path",
        F.col("at_prompt").alias("prompt_offset"),
        F.lit(SOURCE_TOOL).alias("source_tool"),
        F.when(is_turn, tx.normalize_surface(F.col("entry"))).alias("surface"),
        F.expr("if(row_kind = 'turn', nullif(prompt.head.sessionId, ''), null) as session_id"),
        F.expr("if(row_kind = 'turn', prompt.text, null) as prompt_text"),
        F.expr(
            "if(row_kind = 'turn', nullif(array_join(transform(array_sort(pieces), p -> p.text), ''), ''), null) as response_text"
        ),
        F.when(is_turn, parse_rfc3339(F.col("prompt.head.timestamp"))).alias("prompt_ts"),
        F.expr("if(row_kind = 'turn', token_count, null) as token_count"),
        F.when(is_turn, tx.project_context(F.col("prompt.head.cwd"), F.col("prompt.head.gitBranch"))).alias("project_context"),
        F.expr("if(row_kind = 'turn', answered_by.model, null) as model"),
    )


def late_replies(lines: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per file, answers read in this pass that belong to no prompt of it.

    They were appended after their turn had been emitted from an idle file, and are dropped.
    """
    rows = _events(parse(lines), chunk_bytes)
    placed = [
        scan.select("path", "is_reply", "turn")
        for scan in (_scan_whole(rows.filter("not spans")), _scan_chunked(rows.filter("spans")))
    ]
    dropped = placed[0].unionByName(placed[1]).filter("is_reply and turn is null")
    return dropped.groupBy("path").agg(F.count(F.lit(1)).alias("n_late"))


def scan_whole_files(lines: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pass rows of files no larger than one chunk."""
    return _pass_rows(_fold(_scan_whole(_events(parse(lines), chunk_bytes))))


def scan_chunked_files(lines: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pass rows of files of any size."""
    return _pass_rows(_fold(_scan_chunked(_events(parse(lines), chunk_bytes))))


def scan_complete_turns(lines: DataFrame) -> DataFrame:
    """Pass rows of lines that were held until their turns settled: every turn is emitted."""
    rows = _scan_whole(_events(parse(lines), CHUNK_BYTES))
    return _pass_rows(_fold(rows.withColumn("last_prompt", F.lit(2**63 - 1))))


def scan(lines: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pass rows of any mix of files, each by the cheaper way that fits it.

    ``lines`` has the raw-line columns plus ``file_idle``. The size test is pushed below the decoding,
    so every file is decoded on one side only.
    """
    rows = _events(parse(lines), chunk_bytes)
    both = [_fold(_scan_whole(rows.filter("not spans"))), _fold(_scan_chunked(rows.filter("spans")))]
    return _pass_rows(both[0].unionByName(both[1]))
