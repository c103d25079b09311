"""Table schemas, wire names and shared column lists."""

from __future__ import annotations

# Raw lines of a session log, positioned by the byte at which each line starts.
RAW_LINES = (
    "path string, file_size bigint, file_mtime timestamp, start_offset bigint, "
    "byte_offset bigint, line string, terminated boolean"
)

EVENT_COLUMNS = [
    "source_tool",
    "surface",
    "session_id",
    "prompt_text",
    "response_text",
    "prompt_ts",
    "token_count",
    "project_context",
    "client_version",
    "model",
]

# What one pass over a set of files yields. `row_kind` is one of
#   turn    a settled turn, all event columns filled
#   held    an unsettled prompt; the cursor must stay before `prompt_offset`
#   lost    a prompt overwritten by the next prompt before any answer (diagnostic only)
#   header  the file has a session header (rollout format only)
#   error   a byte range of the file could not be read; the file is left for the next pass
#   tail    an unfinished last line; the cursor must stay before `prompt_offset`
PASS_COLUMNS = ["row_kind", "path", "prompt_offset", *[c for c in EVENT_COLUMNS if c != "client_version"]]

# Wire name of every event column, and whether it is left out when empty.
WIRE_FIELDS = [
    ("source_tool", "sourceTool", False),
    ("surface", "surface", False),
    ("session_id", "sessionId", True),
    ("prompt_text", "promptText", False),
    ("response_text", "responseText", True),
    ("prompt_ts", "promptTs", False),
    ("token_count", "tokenCount", True),
    ("project_context", "projectContext", True),
    ("client_version", "clientVersion", False),
    ("model", "model", True),
]

WIRE_DDL = (
    "sourceTool string, surface string, sessionId string, promptText string, responseText string, "
    "promptTs string, tokenCount bigint, projectContext string, clientVersion string, model string"
)

CURSORS = "path string, cursor string, legacy_offset bigint, updated_at timestamp"
REGISTRY = "configDir string, tokenKey string"
FILE_ERRORS = "path string, adapter string, reason string"
SEEN = "path string, file_size bigint, file_mtime timestamp, seen_at timestamp, session_id string"
