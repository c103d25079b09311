"""Rollout log: random files against plain Python, for several chunk sizes; headers, errors, cursors."""

import random

import plain_logs
import pytest
from helpers import context, header, record, said

from turnloom.operators.cursors import file_errors, new_cursors
from turnloom.plans import rollout_log

_RNG = random.Random(23)
FILES = {f"r{i}": plain_logs.rollout_file(_RNG, size) for i, size in enumerate([1, 2, 3, 5, 8, 13, 21, 34, 34, 55, 55, 55, 90, 120])}
IDLE = tuple(p for i, p in enumerate(FILES) if i % 2)
RAW = {p: [x[0] for x in f] for p, f in FILES.items()}


def size_of(lines):
    return sum(len(x.encode()) + 1 for x in lines)


@pytest.mark.parametrize("chunk_bytes", [1 << 26, 700, 40])
def test_random_files(as_lines, chunk_bytes):
    rows = rollout_log.scan(as_lines(RAW, IDLE), chunk_bytes).collect()
    for path, lines in FILES.items():
        turns, held, lost = plain_logs.rollout_turns(lines, path in IDLE)
        of = lambda kind: sorted((r for r in rows if r.path == path and r.row_kind == kind), key=lambda r: r.prompt_offset)
        assert [(r.prompt_offset, r.prompt_text, r.response_text, r.model) for r in of("turn")] == turns
        assert [r.prompt_offset for r in of("held")] == ([] if held is None else [held])
        assert [r.prompt_offset for r in of("lost")] == lost
        assert [r.prompt_offset for r in of("header")] == [0]
        assert {(r.session_id, r.project_context, r.surface, r.token_count) for r in of("turn")} <= {("walk", "/coast", "cli", None)}


def test_random_files_hold_every_case():
    found = [plain_logs.rollout_turns(f, p in IDLE) for p, f in FILES.items()]
    assert any(t for t, _, _ in found) and any(h is not None for _, h, _ in found) and any(x for _, _, x in found)
    assert {f[0][2]["silent"] for f in FILES.values()} == {True, False}


def test_members_of_the_wrong_type_are_empty(as_lines):
    lines = [record("session_meta", {"id": ["x"], "cwd": "/dunes", "originator": 4}), said("user", "which path?"), said("assistant", "left")]
    (turn,) = [r for r in rollout_log.scan(as_lines({"f": lines})).collect() if r.row_kind == "turn"]
    assert (turn.session_id, turn.project_context, turn.response_text) == (None, "/dunes", "left")
    assert str(turn.prompt_ts) == "2026-03-01 10:00:00"


def test_errors_and_cursors(as_lines):
    files = {**RAW, "headless": [said("user", "which path?"), said("assistant", "left")]}
    lines = as_lines(files, IDLE)
    listed = lines.groupBy("path").agg({"file_size": "max"}).withColumnRenamed("max(file_size)", "file_size")
    rows = rollout_log.scan(lines)
    errors = file_errors(listed, rows, rollout_log.SOURCE_TOOL, True)
    assert [(r.path, r.reason) for r in errors.collect()] == [("headless", "no session header")]
    want = {}
    for path, f in FILES.items():
        held = plain_logs.rollout_turns(f, path in IDLE)[1]
        want[path] = size_of(RAW[path]) if held is None else held
    assert {r.path: r.cursor for r in new_cursors(listed, rows, errors).collect()} == want


def test_a_turn_is_emitted_by_one_pass_only(as_lines):
    begun = [header(), context("boots"), said("user", "which path?")]
    (held,) = [r.prompt_offset for r in rollout_log.scan(as_lines({"f": begun})).collect() if r.row_kind == "held"]
    grown = {"f": [*begun, said("assistant", "left")]}
    emitted = lambda start: [(r.prompt_text, r.response_text, r.model) for r in rollout_log.scan(as_lines(grown, start={"f": start})).collect() if r.row_kind == "turn"]
    assert emitted(held) == [("which path?", "left", "boots")] and emitted(held + 1) == []
