import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from turnloom import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


LINES = (
    "path string, file_size bigint, start_offset bigint, byte_offset bigint, line string, "
    "terminated boolean, file_idle boolean"
)


@pytest.fixture(scope="session")
def as_lines(spark):
    """Files given as {path: [line, ...]} to positioned raw lines, in no particular order."""

    def build(files, idle=(), start=None, unfinished=()):
        rows = []
        for path, lines in files.items():
            raw = [line.encode() for line in lines]
            size = sum(len(r) + 1 for r in raw) - (1 if path in unfinished else 0)
            offset = 0
            for i, r in enumerate(raw):
                done = not (path in unfinished and i == len(raw) - 1)
                rows.append((path, size, (start or {}).get(path, 0), offset, r.decode(), done, path in idle))
                offset += len(r) + 1
        return spark.createDataFrame(rows[::-1], LINES).repartition(3)

    return build
