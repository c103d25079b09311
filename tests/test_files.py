import os
import random

import pytest
from pyspark.sql import functions as F

from turnloom.sources import files as fl
from turnloom.streaming.growth import LISTING, ended_lines, grown


def random_file(path, seed, final_newline=True):
    rng = random.Random(seed)
    lines = [os.urandom(rng.choice([0, 1, 3, 17, 200])).replace(b"\n", b"x") for _ in range(rng.randrange(1, 40))]
    data = b"\n".join(lines) + (b"\n" if final_newline else b"")
    path.write_bytes(data)
    return data


def expected(data, start=0):
    out, at = [], start
    for line in data[start:].split(b"\n"):
        out.append((at, line))
        at += len(line) + 1
    if out[-1][1] == b"":
        out.pop()
    return out


@pytest.mark.parametrize("seed", range(12))
def test_ranges_cover_every_line_once(tmp_path, seed, monkeypatch):
    monkeypatch.setattr(fl, "_BLOCK", random.Random(seed).choice([1, 5, 64, 1 << 20]))
    data = random_file(tmp_path / "f", seed, seed % 3 > 0)
    want = expected(data)
    lower = random.Random(seed).choice(want)[0]
    for chunk in (1, 7, 50, 1 << 20):
        got, at = [], lower
        while at < len(data):
            end = min(len(data), (at // chunk + 1) * chunk)
            for offsets, lines in fl.read_range(str(tmp_path / "f"), lower, at, end, len(data)):
                got += [(int(o), x.removesuffix(b"\n")) for o, x in zip(offsets, lines)]
            at = end
        assert got == [w for w in want if w[0] >= lower]


@pytest.mark.parametrize("seed", range(8))
def test_lines_belong_to_the_batch_of_their_newline(tmp_path, seed):
    data = random_file(tmp_path / "f", seed)
    cuts = sorted({0, len(data), *random.Random(seed).choices(range(len(data) + 1), k=4)})
    got = []
    for a, b in zip(cuts, cuts[1:]):
        for offsets, lines in ended_lines(str(tmp_path / "f"), a, b):
            got += list(zip(offsets, lines))
    assert got == expected(data)


def test_growth_is_cut_into_ranges(spark):
    old = spark.createDataFrame([("b", 2, None), ("c", 9, None), ("d", 5, None), ("gone", 1, None)], LISTING)
    new = spark.createDataFrame([("a", 100, None), ("b", 85, None), ("c", 5, None), ("d", 5, None), ("empty", 0, None)], LISTING)
    got = sorted((r.path, r.start, r.end) for r in grown(old, new, 40).collect())
    assert got == [("a", 0, 40), ("a", 40, 80), ("a", 80, 100), ("b", 2, 40), ("b", 40, 80), ("b", 80, 85), ("c", 0, 5)]


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes("ä\r\nb\n\nlast".encode())
    (tmp_path / "empty.jsonl").write_bytes(b"")
    files = fl.list_files(spark, f"{tmp_path}/*.jsonl")
    assert {os.path.basename(r.path): r.file_size for r in files.collect()} == {"a.jsonl": 11, "empty.jsonl": 0}
    cursors = spark.createDataFrame([], "path string, cursor string, legacy_offset bigint")
    lines = fl.read_lines(fl.with_cursors(files, cursors), 3).orderBy("byte_offset").collect()
    assert [(r.byte_offset, r.line, r.terminated) for r in lines] == [
        (0, "ä\r\n", True), (4, "b\n", True), (6, "\n", True), (7, "last", False),
    ]
    resumed = fl.read_lines(files.withColumn("start_offset", F.lit(6).cast("bigint")), 3).orderBy("byte_offset").collect()
    assert [r.byte_offset for r in resumed] == [6, 7]


def test_unreadable_file_becomes_an_error_row(spark, tmp_path):
    gone = spark.sql(f"select '{tmp_path}/gone' path, 10L file_size, timestamp'2026-01-01' file_mtime, 0L start_offset")
    (row,) = fl.read_lines(gone).collect()
    assert row.line is None and "FileNotFoundError" in row.error
