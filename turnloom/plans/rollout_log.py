"""Turns of the rollout log: a header record, then typed envelopes.

A prompt U directly followed by an answer A is a turn; U followed by U loses the first one; A without
a waiting U is ignored. The model is the latest one announced before the prompt. Small files take
one exchange on their path. Large files are scanned per ``(path, chunk)``; the last prompt of a chunk
meets the first answer of a later one through their shared answer offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import jsonline as js
from turnloom.functions import paths as ph
from turnloom.functions import text as tx
from turnloom.functions.timestamps import parse_rfc3339
from turnloom.plans.chunks import CHUNK_BYTES, aside, chunk_of, exchange_chunks, spans_chunks, summarize_chunks, unpack_rows

# Fixed values of the format.
SOURCE_TOOL = "CODEX"
SURFACE = "cli"
EXEC_ORIGINATOR = "codex_exec"
EXEC_SOURCE = "exec"
FILE_GLOB = "sessions/*/*/*/rollout-*.jsonl"
READS_FROM_START = True
NEEDS_HEADER = True

_HEADER = ["id", "cwd", "originator", "source"]


def owner_dir(path: Column) -> Column:
    """Machine-wide logs belong to the default directory of the same home."""
    return ph.home_default_dir(path)


def parse(lines: DataFrame) -> DataFrame:
    """Decode raw lines into one ``kind`` each.

    H header, M model announcement, U prompt, A answer, I injected user text, E emitted by the
    developer role, C compacted history, O anything else that is valid; NULL when the line does not
    fit the format.
    """
    files = [c for c in lines.columns if c != "line"]
    record = f"""if(_.o is not null and {js.is_text_or_absent('_.o.timestamp')} and {js.is_text_or_absent('_.o.type')},
        {js.text_of('_.o.type')}, null)"""
    payload = "if(_.record in ('session_meta', 'turn_context', 'response_item'), _.payload, null)"
    # One unpacking for all three payload kinds.
    members = [*_HEADER, "model", "type", "role", "content"]
    decoded = js.compute_once(
        lines,
        *js.strict_steps("line"),
        {"o": js.fields_of("_.doc", "timestamp", "type", "payload")},
        {"record": record, "timestamp": "_.o.timestamp", "payload": "_.o.payload"},
        {"record": "_.record", "timestamp": "_.timestamp", "p": js.fields_of(payload, *members)},
        {
            "record": "_.record",
            "l_timestamp": "_.timestamp",
            "has_body": "_.p is not null",
            **{"p_" + n: f"_.p.{n}" for n in members},
        },
    ).drop("line")
    fragments = f"""if(record = 'response_item',
        transform(try_variant_get(p_content, '$', 'array<variant>'),
                  e -> named_struct('nil', is_variant_null(e), 'f', {js.fields_of("e", "type", "text")})), null)"""
    bad = f"""exists(_.fragments, x -> not x.nil and (x.f is null or not {js.is_text_or_absent("x.f.type")}
                                    or not {js.is_text_or_absent("x.f.text")}))"""
    role = f"""if(record = 'response_item' and has_body and {js.is_text_or_absent("p_type")}
        and {js.is_text_or_absent("p_role")} and {js.text_of("p_type")} = 'message'
        and if(_.fragments is null, {js.absent("p_content")}, not {bad}), {js.text_of("p_role")}, null)"""
    wanted = "case _.role when 'user' then 'input_text' when 'assistant' then 'output_text' end"
    text = f"""if(_.role in ('user', 'assistant'), coalesce(array_join(transform(
        filter(_.fragments, x -> not x.nil and {js.text_of("x.f.type")} = {wanted}),
        x -> {js.text_of("x.f.text")}), ''), ''), null)"""
    joined = js.compute_once(
        decoded, {"fragments": fragments}, {"fragments": "_.fragments", "role": role}, {"role": "_.role", "text": text}
    ).select("*", F.inline(F.array(F.struct(tx.is_rollout_synthetic(F.col("text")).alias("synthetic")))))
    announced = f"""has_body and {js.is_text_or_absent("p_model")} and {js.is_text_or_absent("p_cwd")}
        and {js.text_of("p_model")} != ''"""
    kind = f"""case when record is null then null
        when record = 'session_meta' then 'H'
        when record = 'compacted' then 'C'
        when record = 'turn_context' then if({announced}, 'M', 'O')
        when role = 'developer' then 'E'
        when text = '' then 'O'
        when role = 'user' then if(synthetic, 'I', 'U')
        when role = 'assistant' then 'A'
        else 'O' end"""
    # Header members are read one by one: a mistyped one is empty, the others stay.
    header = ", ".join(f"'{n}', coalesce({js.text_if_string('p_' + n)}, '')" for n in _HEADER)
    return js.compute_once(joined, {"kind": kind}).selectExpr(
        *files,
        "kind",
        "record is not null as valid",
        f"if(kind = 'U', {js.text_of('l_timestamp')}, null) as ts",
        "if(kind in ('U', 'A', 'I'), text, null) as text",
        f"if(kind = 'M', {js.text_of('p_model')}, null) as model",
        f"if(kind = 'H', named_struct('byte_offset', byte_offset, {header}), null) as header",
    )


def _events(parsed: DataFrame, chunk_bytes: int) -> DataFrame:
    """Headers, models, prompts and answers only, narrowed before any exchange."""
    marked = js.compute_once(
        parsed.withColumnRenamed("kind", "line_kind"),
        {"kind": f"coalesce(case {aside(parsed)} when 'tail' then 'T' when 'error' then 'X' end, line_kind)"},
    )
    return marked.selectExpr(
        "path",
        "byte_offset",
        f"{chunk_of(chunk_bytes)} as chunk",
        f"{spans_chunks(chunk_bytes, '0L')} as spans",
        "file_idle",
        "start_offset",
        "kind",
        "ts",
        "text",
        "model",
        "header",
    ).filter("kind in ('H', 'M', 'U', 'A', 'T', 'X')")


_SPEECH = "if(kind in ('U', 'A'), struct(kind, byte_offset, if(kind = 'A', text, null) as text), null)"
_EDGE = "if(kind in ('U', 'A'), struct(byte_offset, kind), null)"


def _scan_whole(rows: DataFrame) -> DataFrame:
    """What follows each prompt, for files inside one chunk: one exchange on the path."""
    order = "OVER (PARTITION BY path ORDER BY byte_offset"
    return rows.selectExpr("*", f"{_SPEECH} as speech").selectExpr(
        "path",
        "byte_offset",
        "kind",
        "file_idle",
        "start_offset",
        "ts",
        "text",
        f"last(model) IGNORE NULLS {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) as model_now",
        f"first(header) IGNORE NULLS {order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) as meta",
        f"lead(speech) IGNORE NULLS {order}) as next",
    ).selectExpr("*", "next.kind as next_kind", "next.text as reply").drop("next")


def _scan_chunked(rows: DataFrame) -> DataFrame:
    """The same for files of any size: exchange on (path, chunk), summaries per chunk."""
    together = exchange_chunks(rows, ["kind", "model", "header"], ["file_idle", "start_offset", "ts", "text"])
    sums = summarize_chunks(
        together,
        F.expr("max(if(kind = 'M', struct(byte_offset, model), null)) as last_model"),
        F.expr("min(header) as header"),
        F.expr(f"min({_EDGE}) as head"),
        F.expr(f"max({_EDGE}) as tail"),
    )
    before = "OVER (PARTITION BY path ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = "OVER (PARTITION BY path ORDER BY chunk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = sums.selectExpr(
        "path",
        "chunk",
        f"(last(last_model) IGNORE NULLS {before}).model as model_before",
        f"(last(tail) IGNORE NULLS {before}).kind as kind_before",
        f"last(head) IGNORE NULLS {after} as head_after",
        "min(header) OVER (PARTITION BY path) as meta",
    )
    order = "OVER (PARTITION BY path, chunk ORDER BY byte_offset"
    scanned = (
        unpack_rows(together)
        .selectExpr("*", f"{_SPEECH} as speech")
        .selectExpr(
            "*",
            f"last(model) IGNORE NULLS {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) as model_here",
            f"lead(speech) IGNORE NULLS {order}) as next",
            f"lag(speech.kind) IGNORE NULLS {order}) as prev_here",
        )
        .join(carry, ["path", "chunk"], "left")
    )
    # An answer that opens its chunk belongs to a prompt of an earlier chunk, if that one waits.
    opens_chunk = "kind = 'A' and prev_here is null and kind_before = 'U'"
    crosses = "kind = 'U' and next is null and head_after.kind = 'A'"
    sides = scanned.selectExpr(
        "path",
        f"if({crosses}, head_after.byte_offset, byte_offset) as pair",
        f"if({opens_chunk}, 'R', kind) as side",
        "struct(byte_offset, kind, file_idle, start_offset, ts, text, coalesce(model_here, model_before) as model_now, "
        "coalesce(meta, header) as meta, coalesce(next.kind, head_after.kind) as next_kind) as row",
        f"if({opens_chunk}, text, next.text) as reply",
    ).filter("side in ('U', 'R', 'T', 'X', 'H')")
    paired = sides.groupBy("path", "pair").agg(
        F.expr("max(if(side != 'R', row, null)) as row"), F.expr("max(reply) as reply")
    )
    return paired.filter("row is not null").select("path", "row.*", "reply")


def _outcomes(rows: DataFrame) -> DataFrame:
    """Decide what each prompt became; headers and unfinished lines pass through."""
    judged = js.compute_once(
        rows,
        {"row_kind": f"""case when kind = 'T' then 'tail'
            when kind = 'X' then 'error'
            when kind = 'H' then if(byte_offset = meta.byte_offset, 'header', null)
            when kind != 'U' or meta is null then null
            when meta.originator = '{EXEC_ORIGINATOR}' or meta.source = '{EXEC_SOURCE}' then null
            when next_kind = 'U' then 'lost'
            when next_kind is null and not file_idle then 'held'
            -- Emitted by an earlier pass: the gate stands after pairing, never before it.
            when byte_offset >= start_offset then 'turn' end"""},
    ).filter("row_kind is not null")
    return judged.select(
        "row_kind",
        "path",
        F.col("byte_offset").alias("prompt_offset"),
        F.lit(SOURCE_TOOL).alias("source_tool"),
        F.expr(f"if(row_kind = 'turn', '{SURFACE}', null) as surface"),
        F.expr("if(row_kind = 'turn', nullif(meta.id, ''), null) as session_id"),
        F.expr("if(row_kind = 'turn', text, null) as prompt_text"),
        F.expr("if(row_kind = 'turn', reply, null) as response_text"),
        F.when(F.col("row_kind") == "turn", parse_rfc3339(F.col("ts"))).alias("prompt_ts"),
        F.lit(None).cast("bigint").alias("token_count"),
        F.expr("if(row_kind = 'turn', nullif(meta.cwd, ''), null) as project_context"),
        F.expr("if(row_kind = 'turn', model_now, null) as model"),
    )


def scan_whole_files(lines: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pass rows of files no larger than one chunk."""
    return _outcomes(_scan_whole(_events(parse(lines), chunk_bytes)))


def scan_chunked_files(lines: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pass rows of files of any size."""
    return _outcomes(_scan_chunked(_events(parse(lines), chunk_bytes)))


def scan(lines: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pass rows of any mix of files. Lines must start at byte 0: the cursor in ``start_offset`` only
    gates what is emitted, because the header stands on the first line."""
    rows = _events(parse(lines), chunk_bytes)
    return _outcomes(_scan_whole(rows.filter("not spans")).unionByName(_scan_chunked(rows.filter("spans"))))
