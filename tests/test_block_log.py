"""Block log: random files against plain Python, for several chunk sizes, and the edges of a file."""

import json
import random

import plain_logs
import pytest
from helpers import reply, user

from turnloom.operators.reports import quarantined
from turnloom.plans import block_log

_RNG = random.Random(11)
FILES = {f"f{i}": plain_logs.block_file(_RNG, size) for i, size in enumerate([1, 2, 3, 5, 8, 13, 21, 34, 55, 55, 80, 120])}
IDLE = tuple(p for i, p in enumerate(FILES) if i % 2)
LATER = user("is the ferry late?", "2026-07-01T07:00:00Z")


@pytest.mark.parametrize("chunk_bytes", [1 << 26, 900, 60])
def test_random_files(as_lines, chunk_bytes):
    rows = block_log.scan(as_lines({p: [x[0] for x in f] for p, f in FILES.items()}, IDLE), chunk_bytes).collect()
    for path, lines in FILES.items():
        turns, held = plain_logs.block_turns(lines, path in IDLE)
        mine = sorted((r for r in rows if r.path == path and r.row_kind == "turn"), key=lambda r: r.prompt_offset)
        assert [(r.prompt_offset, r.prompt_text, r.response_text, r.token_count, r.model, r.session_id, r.project_context, r.surface) for r in mine] == turns
        assert [r.prompt_offset for r in rows if r.path == path and r.row_kind == "held"] == ([] if held is None else [held])


def test_random_files_hold_every_case():
    kinds = [kind for f in FILES.values() for _, kind, _ in f]
    assert {"prompt", "answer", "other", "broken"} == set(kinds) and kinds.count("prompt") > 100


def test_answers_before_any_prompt_are_nobodys(as_lines):
    rows = block_log.scan(as_lines({"f": [reply("r", "echo", tokens=3), LATER]}, ("f",))).collect()
    assert [(r.row_kind, r.response_text) for r in rows] == [("held", None)]


def test_answer_as_plain_string_counts_tokens_only(as_lines):
    line = json.dumps({"type": "assistant", "message": {"id": "r", "content": "not blocks", "usage": {}}})
    rows = block_log.scan(as_lines({"f": [user("tide table"), line, LATER]})).collect()
    assert [(r.response_text, r.token_count) for r in rows if r.row_kind == "turn"] == [(None, 0)]


def test_unfinished_line_is_kept_for_later(as_lines):
    lines = [user("tide table"), reply("r", "high at six"), LATER, '{"type":"assi']
    rows = block_log.scan(as_lines({"f": lines}, unfinished=("f",))).collect()
    at = [sum(len(x.encode()) + 1 for x in lines[:n]) for n in range(4)]
    assert {r.row_kind: r.prompt_offset for r in rows} == {"turn": 0, "held": at[2], "tail": at[3]}


def test_complete_line_without_newline_counts(as_lines):
    rows = block_log.scan(as_lines({"f": [user("tide table"), LATER]}, unfinished=("f",))).collect()
    assert sorted(r.row_kind for r in rows) == ["held", "turn"]


@pytest.mark.parametrize("chunk_bytes", [1 << 26, 30])
def test_surface_is_that_of_the_first_line_that_names_one(as_lines, chunk_bytes):
    lines = [json.dumps({"type": "summary"}), json.dumps({"entrypoint": "sdk-cli"}), user("tide table", entrypoint="cli"), LATER]
    rows = block_log.scan(as_lines({"f": lines}), chunk_bytes).collect()
    assert [r.surface for r in rows if r.row_kind == "turn"] == ["sdk-cli"]


def test_quarantine_names_places_only(as_lines):
    rows = quarantined(block_log.parse(as_lines({p: [x[0] for x in f] for p, f in FILES.items()}))).collect()
    want = set()
    for path, lines in FILES.items():
        offset = 0
        for line, kind, _ in lines:
            want |= {(path, offset)} if kind == "broken" else set()
            offset += len(line.encode()) + 1
    assert {(r.path, r.byte_offset) for r in rows} >= want and rows[0].asDict().keys() == {"path", "byte_offset"}
