import json
import random

import pytest
from pyspark.sql import functions as F

from turnloom.operators import ordered
from turnloom.operators.events import write_in_scan_order


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    # One key holds most rows, some keys a single one.
    keys = ["hot"] * 400 + [f"k{rng.randrange(30)}" for _ in range(120)]
    rows = [(k, i, rng.choice([None, 1, 2, 3]), rng.randrange(50)) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, o bigint, v bigint, n bigint").repartition(5)


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [1, 7, 100000])
def test_scans_match_a_plain_loop(data, width):
    rows, df = data
    chunk = F.expr(f"o div {width}")
    total = {r.o: (r.base, r.total) for r in ordered.running_total(df, ["k"], ["o"], chunk, F.col("n"), "base", "total").collect()}
    carried = {r.o: r.last for r in ordered.carry_forward(df, ["k"], ["o"], chunk, F.col("v"), "last").collect()}
    nexts = {r.o: (r.nxt.o if r.nxt else None) for r in ordered.next_in_sequence(df, ["k"], ["o"], chunk, ["o"], "nxt").collect()}
    segs = {r.o: r.seg for r in ordered.segment(df, ["k"], ["o"], chunk, F.col("v") == 1, "seg").collect()}
    assert len(total) == len(carried) == len(nexts) == len(segs) == len(rows)
    for members in groups(rows).values():
        run, last, seg = 0, None, 0
        whole = sum(r[3] for r in members)
        for i, (_, o, v, n) in enumerate(members):
            last = v if v is not None else last
            seg += v == 1
            assert total[o] == (run, whole)
            assert carried[o] == last
            assert nexts[o] == (members[i + 1][1] if i + 1 < len(members) else None)
            assert segs[o] == seg
            run += n


@pytest.mark.parametrize("rows_a_chunk,chunks", [(1, 1), (7, 3), (1000, 100)])
def test_scans_in_chunks_of_rows(data, rows_a_chunk, chunks):
    """The same scans where chunks are cut by number and summaries go up two levels: a hot key has many blocks."""
    rows, df = data
    placed = ordered.in_chunks(df, ["k"], ["o"], rows_a_chunk, chunks)
    sizes = [r["count"] for r in placed.groupBy("chunk").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= rows_a_chunk
    if rows_a_chunk * chunks < 50:
        assert placed.filter("k = 'hot'").select("block").distinct().count() > 5
    at = dict(chunk=F.col("chunk"), block=F.col("block"))
    out = ordered.running_total(placed, ["k"], ["o"], value=F.col("n"), out="base", total="total", **at)
    out = ordered.carry_forward(out, ["k"], ["o"], value=F.col("v"), out="last", **at)
    out = ordered.next_in_sequence(out, ["k"], ["o"], payload=["o"], out="nxt", **at)
    out = ordered.segment(out, ["k"], ["o"], opens=F.col("v") == 1, out="seg", **at)
    got = {r.o: (r.base, r.total, r.last, r.nxt.o if r.nxt else None, r.seg) for r in out.collect()}
    want = {}
    for members in groups(rows).values():
        run, last, seg, whole = 0, None, 0, sum(r[3] for r in members)
        for i, (_, o, v, n) in enumerate(members):
            last, seg = v if v is not None else last, seg + (v == 1)
            want[o] = (run, whole, last, members[i + 1][1] if i + 1 < len(members) else None, seg)
            run += n
    assert got == want


def test_ranges_follow_the_rows_not_the_chunks(data, monkeypatch):
    rows, df = data
    assert ordered.in_chunks(df, ["k"], ["o"], 2, 2).select(F.spark_partition_id()).distinct().count() == 1
    monkeypatch.setattr(ordered, "RANGE_ROWS", 40)
    placed = ordered.in_chunks(df, ["k"], ["o"], 3, 4)
    assert 1 < placed.select(F.spark_partition_id()).distinct().count() <= 1 + len(rows) // 40
    sizes = placed.groupBy("chunk").agg(F.count("*").alias("n"), F.countDistinct("block").alias("b")).agg(F.max("n"), F.max("b")).first()
    blocks = placed.groupBy("block").count().agg(F.max("count")).first()
    assert tuple(sizes) == (3, 1) and blocks[0] <= 12
    out = ordered.running_total(placed, ["k"], ["o"], F.col("chunk"), F.lit(1), "before", "all", F.col("block"))
    want = {o: i for members in groups(rows).values() for i, (_, o, _, _) in enumerate(members)}
    assert {r.o: r.before for r in out.collect()} == want


def test_row_numbers(data):
    rows, df = data
    got = ordered.row_numbers(df, ["n", "o"], "place", 50).collect()
    assert [r.o for r in sorted(got, key=lambda r: r.place)] == [r[1] for r in sorted(rows, key=lambda r: (r[3], r[1]))]
    assert sorted(r.place for r in got) == list(range(1, len(rows) + 1))
    assert ordered.row_numbers(df.limit(0), ["o"]).count() == 0


def test_files_in_scan_order(spark, tmp_path):
    rows = [("B", f"p{i % 3}", i, i) for i in range(40)] + [("A", "z", 1, 100), ("other", "a", 1, 101)]
    events = spark.createDataFrame(rows, "source_tool string, path string, prompt_offset bigint, id bigint").repartition(4)
    write_in_scan_order(events, ["A", "B"], f"{tmp_path}/out", 10)
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.suffix == ".json")
    got = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert len(files) > 3 and [g["position"] for g in got] == list(range(1, 43))
    assert [g["id"] for g in got] == [100, *(r[3] for r in sorted(rows[:40], key=lambda r: (r[1], r[2]))), 101]
