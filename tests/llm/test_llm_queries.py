"""Registered queries against their SQL on the smallest tables; those without SQL against the contracts in plain Python."""

import re
from pathlib import Path

import duckdb
import plain
import pytest

import __spark_entry__ as entry
from turnloom.llm import html_text, oracles, queries
from test_packing import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("select doc_id, text from documents").fetchall())


def got(spark, name):
    return queries.all_queries()[name](spark, SF).collect()


def test_one_query_for_each_operator_and_the_pipeline():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.all_queries()) == list(range(1, 14))
    assert set(queries.all_queries()) | {"pipeline"} <= set(entry.queries()) and set(oracles.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(oracles.SQL))
def test_sql(spark, db, name):
    rows = got(spark, name)
    result = db.execute(oracles.SQL[name])
    names = [d[0] for d in result.description]
    assert set(names) == set(rows[0].asDict())
    assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(result.fetchall())


def test_html(spark, db):
    pages = dict(db.execute("select page_id, html from pages").fetchall())
    rows = got(spark, "op1_html_extraction")
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == html_text.render(html_text.parse(pages[r["page_id"]]))
        # Words between tags outside scripts and styles, in order, are the words of the text, but for list marks.
        body = re.sub(r"(?s)<head>.*?</head>|<head>.*?(?=<body|<nav)|<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->", " ", pages[r["page_id"]])
        import html as std

        want = re.findall(r"[^\W_]+", std.unescape(re.sub(r"<[^>]*>?", " ", body)))
        assert "".join(re.findall(r"[^\W_]+", r["text"])) == "".join(want)


def test_packing(spark, texts):
    check(texts, got(spark, "op3_packing"), 1024)


def test_span_dedup(spark, texts):
    want = plain.span_dedup(texts)
    assert {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["kept_sha256"]) for r in got(spark, "op6_substring_dedup")} == {
        d: (n, len(gone), plain.sha(text)) for d, (n, gone, text) in want.items()
    }


def test_suffix_dedup(spark, texts):
    want = plain.suffix_dedup(texts)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got(spark, "op8_suffix_array_dedup")} == {
        d: (*r[:3], plain.sha(r[3])) for d, r in want.items()
    }


@pytest.mark.parametrize("name,least", [("op9_quality_classifier", 0.3), ("op10_toxicity", 0.5)])
def test_scores(spark, texts, name, least):
    rows = got(spark, name)
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in rows)
    assert any(r["held_out"] for r in rows) and not all(r["held_out"] for r in rows)
