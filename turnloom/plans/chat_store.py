"""Turns of a chat store: sessions saved as whole JSON documents, as journals, or nested in a folder of their own.

Not among the default formats: a caller adds the module to ``Job.formats``. A document is one JSON value of many lines that each save
rewrites, so files are read whole and what is new is told by content, not by offset (``Job.identity_buckets`` must be set). The
same session may lie in several layouts; only the richest of them speaks for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions import paths as ph
from turnloom.functions import text as tx
from turnloom.functions.timestamps import parse_rfc3339
from turnloom.operators import ordered
from turnloom.plans.chunks import CHUNK_BYTES
from turnloom.schemas import PASS_COLUMNS
from turnloom.session import checkpointed
from turnloom.sources import files as fl

# Fixed values of the format.
SOURCE_TOOL = "GEMINI"
SURFACE = "cli"
PROMPT, REPLY = "user", "gemini"
FILE_GLOBS = ["tmp/*/chats/session-*.json", "tmp/*/chats/session-*.jsonl", "tmp/*/chats/*/*.jsonl", "tmp/*/chats/*/*.json"]
FILE_GLOB = "tmp/*/chats/{session-*.json,session-*.jsonl,*/*.jsonl,*/*.json}"
PROJECTS_FILE = "projects.json"
NESTED, WHOLE, JOURNAL = 1, 2, 3  # the first one a session has speaks for it

READS_FROM_START = True
NEEDS_HEADER = True
WHOLE_FILES = True

_MESSAGE = "type string, content variant, timestamp string, model string"
_HEAD = "sessionId string, directories array<string>"
_ROW = ["seq", "type", "content", "timestamp", "model", "session_id", "directory"]


def _home(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(path, "^file:/+", "/"), r"^(.*)/\.gemini/", 1), F.lit(""))


def owner_dir(path: Column) -> Column:
    """Default config directory of the home a session lies in."""
    return F.concat(_home(path), F.lit("/" + ph.DEFAULT_DIR_NAME))


def layout(path: Column) -> Column:
    """NESTED, WHOLE or JOURNAL; NULL for another shape of path."""
    return (
        F.when(path.rlike(r"/chats/[^/]+/[^/]+\.jsonl?$"), NESTED).when(path.rlike(r"/chats/session-[^/]*\.json$"), WHOLE).when(path.rlike(r"/chats/session-[^/]*\.jsonl$"), JOURNAL)
    )


def _content(value: str) -> Column:
    """Text of a message: a string as it is, an array of parts put together, anything else nothing."""
    parts = f"array_join(transform(try_variant_get({value}, '$', 'array<variant>'), p -> coalesce(try_variant_get(p, '$.text', 'string'), '')), '')"
    return F.expr(f"case when schema_of_variant({value}) = 'STRING' then variant_get({value}, '$', 'string') when schema_of_variant({value}) like 'ARRAY%' then {parts} end")


def messages(files: DataFrame) -> DataFrame:
    """(path, file_size, file_mtime, seq, type, text, timestamp, model, session_id, directory, error) of files in any layout.

    Rows with a type are messages; those without name the session or its directory, or are an ``error``: a file that cannot be read
    or is no JSON. A document's messages are numbered, a journal's stand at their bytes. Journal lines that are no JSON,
    or not ended yet, say nothing. Each file is decoded once, by a projection that ends in a generator.
    """
    facts = ["path", "file_size", "file_mtime"]
    whole = fl.read_whole(files.filter("path LIKE '%.json'"))
    parsed = whole.withColumn("doc", F.from_json("text", f"{_HEAD}, messages array<struct<{_MESSAGE}>>"))
    head = "struct(-1L as seq, string(null) as type, cast(null as variant) as content, string(null) as timestamp, string(null) as model, doc.sessionId as session_id, get(doc.directories, 0) as directory)"
    each = "transform(doc.messages, (m, i) -> struct(bigint(i) as seq, m.type as type, m.content as content, m.timestamp as timestamp, m.model as model, string(null) as session_id, string(null) as directory))"
    broken = "coalesce(error, if(doc.sessionId is null and doc.messages is null, 'no session', null))"
    docs = parsed.selectExpr(*facts, f"{broken} as error", f"inline(concat(array({head}), coalesce({each}, array())))")
    sized = files.filter("path LIKE '%.jsonl'").select(*facts, F.lit(0).cast("bigint").alias("start_offset"))
    lines = fl.read_lines(sized, from_start=True).filter("terminated OR error IS NOT NULL")
    row = lines.select(*facts, "byte_offset", "error", F.inline(F.array(F.from_json("line", f"{_HEAD}, {_MESSAGE}"))))
    journal = row.filter("type IS NOT NULL OR sessionId IS NOT NULL OR error IS NOT NULL").select(
        *facts, "error", F.col("byte_offset").alias("seq"), "type", "content", "timestamp", "model", F.col("sessionId").alias("session_id"), F.get("directories", F.lit(0)).alias("directory")
    )
    both = docs.unionByName(journal)
    return both.select(*facts, *(c if c != "content" else _content("content").alias("text") for c in _ROW), "error")


def file_facts(found: DataFrame) -> DataFrame:
    """(path, session_id, directory, error) of each file: the first session and directory it names."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return found.groupBy("path").agg(first("session_id"), first("directory"), F.max("error").alias("error"))


def authoritative(sessions: DataFrame) -> DataFrame:
    """Of files (path, session_id) those whose layout is the first that their session has. Files are compared, not their messages."""
    placed = sessions.select("path", "session_id").distinct().withColumn("_layout", layout(F.col("path"))).filter("session_id IS NOT NULL AND _layout IS NOT NULL")
    best = placed.groupBy("session_id").agg(F.min("_layout").alias("_layout"))
    return placed.join(best, ["session_id", "_layout"], "left_semi").select("path", "session_id")


def working_dirs(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """(path, cwd) of files (path, directory): the directory they name, else the one that alone has their folder's name, else that name."""
    name = F.regexp_extract("path", r"/tmp/([^/]+)/chats/", 1)
    asked = sessions.select("path", F.nullif("directory", F.lit("")).alias("own"), _home(F.col("path")).alias("home"), name.alias("name")).distinct()
    found = asked.join(known.withColumnRenamed("directory", "found"), ["home", "name"], "left")
    return found.select("path", F.coalesce("own", "found", "name").alias("cwd"))


def _numbered(talk: DataFrame, opens: Column, chunked: bool) -> DataFrame:
    """talk with the number of its ``turn`` and of the ``last`` one of the file. Files inside one chunk take one exchange, on the path."""
    one = opens.cast("bigint")
    if chunked:
        counted = ordered.running_total(talk.withColumn("_opens", one), ["path"], ["seq"], F.expr(f"seq div {CHUNK_BYTES}"), F.col("_opens"), "_seen", "last")
        return counted.withColumn("turn", F.col("_seen") + F.col("_opens")).drop("_seen", "_opens")
    whole = Window.partitionBy("path").orderBy("seq")
    ever = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return talk.withColumn("turn", F.sum(one).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("last", F.sum(one).over(ever))


def turns(found: DataFrame, facts: DataFrame, speaking: DataFrame, dirs: DataFrame, now, chunked: bool = True) -> DataFrame:
    """Pass rows of messages: settled turns of the files that speak for their session, and held prompts.

    A turn opens at a prompt and runs to the next one. Prompts that are empty or begin with a slash, notices and rows
    without a type are passed over. The last turn settles when it is answered and the file rests. Files beyond one chunk must be ``chunked``.
    """
    is_prompt = F.col("type") == PROMPT
    passed = is_prompt & ((F.trim(F.coalesce("text", F.lit(""))) == "") | F.col("text").startswith("/"))
    talk = found.filter(F.col("type").isin(PROMPT, REPLY) & ~passed).join(speaking.select("path"), "path", "left_semi")
    cut = _numbered(talk, is_prompt, chunked).filter("turn > 0")
    reply = F.when(~is_prompt, F.struct("seq", "text", "model"))
    folded = cut.groupBy("path", "turn").agg(
        F.max("file_mtime").alias("file_mtime"), F.max(F.when(is_prompt, F.struct("seq", "text", "timestamp"))).alias("prompt"),
        F.sort_array(F.collect_list(reply)).alias("replies"), F.max("last").alias("last"),
    )
    settled = (F.col("turn") < F.col("last")) | ((F.size("replies") > 0) & fl.is_idle(now))
    rows = folded.join(facts.select("path", "session_id"), "path").join(dirs, "path", "left").select(
        F.when(settled, "turn").otherwise("held").alias("row_kind"), "path", F.col("prompt.seq").alias("prompt_offset"), F.lit(SOURCE_TOOL).alias("source_tool"), F.lit(SURFACE).alias("surface"),
        "session_id", F.col("prompt.text").alias("prompt_text"), tx.empty_to_null(F.array_join("replies.text", "")).alias("response_text"), parse_rfc3339(F.col("prompt.timestamp")).alias("prompt_ts"),
        F.lit(None).cast("bigint").alias("token_count"), tx.project_context(F.col("cwd"), F.lit("")).alias("project_context"), F.get("replies", F.lit(0))["model"].alias("model"),
    )
    return rows.select(PASS_COLUMNS)


def read_files(files: DataFrame, known: DataFrame, now) -> DataFrame:
    """Pass rows of the files of a pass. ``known`` has (path, session_id) of the files that are not read now but may speak for a session."""
    # Files inside one chunk and larger ones are read apart; nearly always there is one plan only.
    large = F.expr(f"coalesce(file_size > {CHUNK_BYTES}, false)")
    sizes = sorted(r[0] for r in files.select(large).distinct().collect()) or [False]  # at most two rows
    parts = [(chunked, messages(files.filter(large == F.lit(chunked)) if len(sizes) > 1 else files)) for chunked in sizes]
    # One row a file and no text, so it may be kept; texts are decoded once for it and once for the turns.
    facts = checkpointed(file_facts(reduce(DataFrame.unionByName, (found for _, found in parts))))
    others = known.select("path", "session_id").join(files.select("path"), "path", "left_anti")
    speaking = authoritative(facts.select("path", "session_id").unionByName(others))
    homes = files.select(_home(F.col("path")).alias("home")).filter("home IS NOT NULL").distinct()
    dirs = working_dirs(facts, projects_of(homes))
    kinds = facts.select(F.when(F.col("error").isNotNull(), "error").when(F.col("session_id").isNotNull(), "header").alias("row_kind"), "path", "session_id").filter("row_kind IS NOT NULL")
    rows = [turns(found, facts, speaking, dirs, now, chunked) for chunked, found in parts]
    return reduce(DataFrame.unionByName, rows).unionByName(kinds, allowMissingColumns=True)


def projects_of(homes: DataFrame) -> DataFrame:
    """(home, name, directory): of the projects files of homes, names that exactly one directory of a home has. A home may have no file."""
    listed = homes.select(F.concat("home", F.lit(f"/.gemini/{PROJECTS_FILE}")).alias("path"), F.lit(0).cast("bigint").alias("file_size"), F.lit(None).cast("timestamp").alias("file_mtime"))
    read = fl.read_whole(listed).filter("error IS NULL")
    known = read.select(_home(F.col("path")).alias("home"), F.explode(F.from_json("text", "projects map<string, string>")["projects"]).alias("directory", "name"))
    return known.groupBy("home", "name").agg(F.min("directory").alias("directory"), F.max("directory").alias("_last")).filter("directory = _last").drop("_last")
