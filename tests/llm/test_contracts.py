"""Operators against plain Python, on a corpus of copies, shared passages, junk, nulls and empty texts."""

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from turnloom.llm import components, decontaminate, jaccard_join, line_dedup, line_quality, span_dedup, suffix_dedup

ITEMS = "item_id long, text string"


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}


def test_jaccard_classes(as_docs, corpus):
    assert rows(jaccard_join.jaccard_classes(as_docs(corpus)), "n_shingles", "component_id") == plain.jaccard_classes(corpus)


def test_jaccard_chain_links_without_hub(as_docs):
    """Each text is like the next, far ones are not: the smallest id of a group does not reach all, trees must."""
    words = [f"w{i}" for i in range(400)]
    docs = {10 * k: " ".join(words[12 * k : 12 * k + 200]) for k in range(16)}
    want = plain.jaccard_classes(docs)
    assert len({c for _, c in want.values()}) == 1
    assert rows(jaccard_join.jaccard_classes(as_docs(docs)), "n_shingles", "component_id") == want


def test_spanning_pairs_join_what_all_pairs_join():
    """In a tree of random sets, some of them near copies: fewer pairs than texts, the same components."""
    rng = np.random.default_rng(4)
    for n in (2, 17, 150, 400):
        base = [rng.choice(3000, 60, replace=False) for _ in range(6)]
        sets = [np.unique(np.where(rng.random(60) < 0.04, rng.integers(0, 3000, 60), base[rng.integers(0, 6)])).astype(np.uint64) for _ in range(n)]
        bits = [np.frombuffer(jaccard_join.bitmap(s), np.uint8) for s in sets]
        to = min(map(len, bits))
        tree = jaccard_join.Tree(np.arange(n), np.array([len(s) for s in sets]), np.arange(n), bits, to)

        def joined(pairs):
            label, count = np.arange(n), 0
            for x, y in pairs:
                count += len(x)
                for a, b in zip(x, y):
                    label[label == label[b]] = label[a]
            return {tuple(np.flatnonzero(label == k)) for k in set(label.tolist())}, count

        (all_, _), (some, count) = joined(tree.pairs()), joined(tree.spanning())
        assert all_ == some and count == n - len(some)


def test_jaccard_large_groups_are_cut_into_cells(as_docs, corpus):
    assert rows(jaccard_join.jaccard_classes(as_docs(corpus), common=4, block=3), "n_shingles", "component_id") == plain.jaccard_classes(corpus)


@pytest.mark.parametrize("limits", [{}, {"common": 4, "block": 3}])
def test_jaccard_links_are_all_links(as_docs, corpus, limits):
    """Also those between texts that meet through a hub, each once, and those of equal sets."""
    base = [f"q{i}" for i in range(200)]
    docs = corpus | {1000 + k: " ".join(base[: 7 * k] + [f"r{k}"] + base[7 * k + 1 :]) for k in range(8)}
    sets = {d: plain.shingles(t) for d, t in docs.items() if plain.shingles(t)}
    want = {(a, b) for a in sets for b in sets if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b])}
    links, members = jaccard_join.jaccard_links(as_docs(docs), **limits)
    of = {}
    for r in members.collect():
        of.setdefault(r["rep"], []).append(r["doc_id"])
    got = [(min(x, y), max(x, y)) for r in links.collect() for x in of[r["a"]] for y in of[r["b"]] if x < y or r["a"] != r["b"]]
    assert sorted(got) == sorted(want) and sum(r["n_links"] for r in links.collect()) == len(want)
    assert {(a, b) for a in range(1000, 1008) for b in range(a + 1, 1008)} <= want
    assert sorted(d for ds in of.values() for d in ds) == sorted(sets)


def test_jaccard_links_of_odd_tables(as_docs):
    links, members = jaccard_join.jaccard_links(as_docs({1: None, 2: " ", 3: "one"}))
    assert links.count() == 0 and [tuple(r) for r in members.collect()] == [(3, 3)]
    assert all(x.count() == 0 for x in jaccard_join.jaccard_links(as_docs({1: "x"}).limit(0)))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (303, 302), (302, 301), (301, 303)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 301: 301, 302: 301, 303: 301}


@pytest.mark.parametrize("min_docs", [2, 5])
def test_line_dedup(as_docs, corpus, min_docs):
    assert rows(line_dedup.line_dedup(as_docs(corpus), min_docs=min_docs), "n_lines", "n_dropped", "text") == plain.line_dedup(corpus, min_docs)


def test_decontamination(spark, as_docs, corpus):
    items = {0: corpus[141][200:700], 1: "two words", 2: None, 3: "?!", 4: corpus[110][10:400], 10: corpus[110][10:400], 5: "w1 w2"}
    docs = {**corpus, 500: "W1, w2! w1... w2", 501: "Éw1 w2"}
    found = decontaminate.decontaminate(as_docs(docs), spark.createDataFrame(list(items.items()), ITEMS))
    want = plain.contamination(docs, items)
    assert rows(found, "n_words", "n_hit", "item_ids", "contaminated") == want
    for r in found.collect():  # offsets hold the window's words in the original text
        for h in r["hits"]:
            piece = docs[r["doc_id"]][h["first_char"] : h["end_char"]]
            assert plain.alnum_words(piece) == plain.alnum_words(docs[r["doc_id"]])[h["first_word"] : h["first_word"] + h["n_window"]]


def test_decontamination_in_blocks(spark, as_docs, corpus):
    items = spark.createDataFrame([(k, corpus[k]) for k in range(5)], ITEMS)
    docs = as_docs({d: corpus[d] for d in range(70)}).select("doc_id", "text")
    once, often = (decontaminate.scan(docs, items, "f", block_bytes=b) for b in (1 << 20, 12_000))
    columns = ["doc_id", "f.n_words", decontaminate.covered(F.col("f.hits")).alias("n_hit")]
    assert sorted(once.select(*columns).collect()) == sorted(often.select(*columns).collect())


@pytest.mark.parametrize("span,gram", [(100, 20), (30, 8)])
def test_suffix_dedup(as_docs, corpus, span, gram):
    got = rows(suffix_dedup.suffix_dedup(as_docs(corpus), span, gram), "n_bytes", "n_removed", "n_spans", "kept")
    assert {d: (*r[:3], bytes(r[3])) for d, r in got.items()} == plain.suffix_dedup(corpus, span)


def test_suffix_dedup_spreads_large_anchors(as_docs, corpus):
    got = rows(suffix_dedup.suffix_dedup(as_docs(corpus), 30, 8, large=2), "n_bytes", "n_removed", "n_spans", "kept")
    assert {d: (*r[:3], bytes(r[3])) for d, r in got.items()} == plain.suffix_dedup(corpus, 30)


def test_line_quality(as_docs, corpus):
    hosts = {d: "ab"[d % 3 == 0] for d in corpus} | {5: None}
    docs = corpus | {d: f"{plain.sha(str(d))} some words of its own here\n" + "\n".join(corpus[110].split("\n")[:8]) for d in range(300, 340)}
    hosts |= {d: "b" for d in range(300, 340)}
    got = rows(
        line_quality.line_quality(as_docs(docs, hosts)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines"
    )
    want = plain.quality(docs, hosts)
    assert got == want
    assert any(r[7] for r in want.values()) and len({r[6] for r in want.values() if not r[5]}) == 2


def test_line_quality_counts_copies(as_docs):
    """A line that only copies of one text hold is frequent: copies are documents."""
    own = lambda d: " ".join(f"w{d}x{i}" for i in range(40))
    docs = {d: "A line that only copies hold, forty of them.\n" + own(0) for d in range(40)} | {d: own(d) for d in range(100, 160)}
    hosts = {d: "h" for d in docs}
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines")
    got = rows(line_quality.line_quality(as_docs(docs, hosts)), *columns)
    assert got == plain.quality(docs, hosts) and got[3][7] == 2
    twice = as_docs(docs, hosts).unionByName(as_docs({d: docs[d] for d in range(5)}, hosts))
    assert rows(line_quality.line_quality(twice), *columns) == got


def test_span_dedup(as_docs, corpus):
    got = rows(span_dedup.span_dedup(as_docs(corpus)), "n_sentences", "removed", "text")
    assert got == plain.span_dedup(corpus)
    assert sum(len(r[1]) for r in got.values()) > 50


PASSAGE = [f"p{i}" for i in range(51)]
PASSAGES = {
    "two sentences": " ".join(PASSAGE[:20]) + ". " + " ".join(PASSAGE[20:]) + ".",
    "one sentence": " ".join(PASSAGE) + "!",
    "a short sentence last": " ".join(PASSAGE[:48]) + ". " + " ".join(PASSAGE[48:]) + "?",
    "a short sentence first": " ".join(PASSAGE[:3]) + ". " + " ".join(PASSAGE[3:]) + ".",
    "quoted": '"' + " ".join(PASSAGE[:25]) + '." (' + " ".join(PASSAGE[25:40]) + "!) \u00ab" + " ".join(PASSAGE[40:]) + ".\u00bb",
    "a list": "\n".join(" ".join(PASSAGE[i : i + 17]) for i in (0, 17, 34)),
}


@pytest.mark.parametrize("name", list(PASSAGES))
def test_span_dedup_removes_planted_passages_whole(as_docs, name):
    first = f"Begin here one.\n{PASSAGES[name]}\nEnd one."
    later = f'He said "two." Other words.\n{PASSAGES[name]}\nThen two ends.'
    got = rows(span_dedup.span_dedup(as_docs({1: first, 2: later}), min_words=12, ends=".!?", whole=True), "text")
    assert got == {1: (first,), 2: ('He said "two." Other words.\nThen two ends.',)}


@pytest.mark.parametrize("name", list(PASSAGES))
def test_span_dedup_catches_planted_passages(as_docs, name):
    """Also where the passage is cut off inside a sentence: most of its words go, and only they."""
    clauses = ", ".join(" ".join(PASSAGE[i : i + 9]) for i in range(0, 51, 9))
    for passage in (PASSAGES[name].replace("p9 ", "p9, ").replace("p25 ", "p25; ").replace("p40 ", "p40: "), clauses):
        first, later = f"Something of its own before {passage} and behind.", f"This one goes on {passage} quite another way."
        ((_,), (kept,)) = rows(span_dedup.span_dedup(as_docs({1: first, 2: later})), "text").values()
        assert len([x for x in kept.split() if x.strip(",;:.!?()\"\u00ab\u00bb") in PASSAGE]) <= 25
        assert kept.startswith("This one goes on ") and kept.endswith(" quite another way.")


def test_span_dedup_tells_swapped_letters_apart(as_docs):
    """Long words that a hash modulo a power of two takes for equal, whatever its base."""
    a, b = swapped_letters()
    same = "One two three four five six seven, eight nine ten eleven twelve, thirteen fourteen fifteen sixteen."
    docs = {1: f"{same} In {a}, a b c d e f g h, i j k l m n o p.", 2: f"{same} In {b}, a b c d e f g h, i j k l m n o p."}
    got = rows(span_dedup.span_dedup(as_docs(docs), min_words=12), "text")
    assert got == {d: (r[2],) for d, r in plain.span_dedup(docs, min_words=12).items()} and b in got[2][0]


def test_jaccard_tells_swapped_letters_apart(as_docs):
    a, b = swapped_letters()
    docs = {1: a, 2: b, 3: a, 4: f"x {a} y z", 5: f"x {b} y z"}
    assert rows(jaccard_join.jaccard_classes(as_docs(docs)), "n_shingles", "component_id") == plain.jaccard_classes(docs)


def swapped_letters():
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_span_dedup_removes_copies_of_short_texts_whole(as_docs):
    docs = {1: "Only few words.", 2: "only  FEW words.", 3: "Only few words. More.", 4: "a " * 40, 5: "a " * 40, 6: " ", 7: None}
    assert rows(span_dedup.span_dedup(as_docs(docs), min_words=12, ends=".!?", whole=True), "n_removed") == {1: (0,), 2: (1,), 3: (0,), 4: (0,), 5: (1,), 6: (0,), 7: (0,)}


def test_clashing_columns_null_ids_and_repeated_rows(spark, as_docs, corpus):
    """Extra columns named like results, rows without id, rows that come twice: defined results, no crash."""
    docs = {d: corpus[d] for d in (1, 2, 3, 60, 61, 100, 101, 110, 130, 131, 136)}
    df = as_docs(docs).drop("lang").withColumn("n_lines", F.lit("x")).withColumn("component_id", F.lit(1.5)).withColumn("found", F.lit(True)).withColumn("h1", F.lit(0))
    extra = df.filter("doc_id in (1, 110)").withColumn("doc_id", F.lit(None).cast("long"))
    twice = df.unionByName(extra).unionByName(df.filter("doc_id in (2, 110)"))
    n = twice.count()
    items = spark.createDataFrame([(None, corpus[1]), (2, None)], ITEMS)
    for result in (
        line_dedup.line_dedup(twice), jaccard_join.jaccard_classes(twice), decontaminate.decontaminate(twice, items),
        suffix_dedup.suffix_dedup(twice), line_quality.line_quality(twice), span_dedup.span_dedup(twice),
    ):
        got = result.collect()
        assert len(got) == n and sum(r["doc_id"] is None for r in got) == 2
        assert len({str(r) for r in got if r["doc_id"] == 110}) == 1
    # A row repeated under its id loses nothing to itself; rows without id come last.
    kept = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(twice).collect() if r["doc_id"] in (None, 2)}
    alone = plain.suffix_dedup(docs)
    assert (2, alone[2][1]) in kept and any(d is None and removed > 0 for d, removed in kept)


def test_empty_tables(spark, as_docs):
    docs, items = as_docs({1: "x"}).limit(0), spark.createDataFrame([], ITEMS)
    for result in (
        line_dedup.line_dedup(docs), jaccard_join.jaccard_classes(docs), decontaminate.decontaminate(docs, items),
        suffix_dedup.suffix_dedup(docs), line_quality.line_quality(docs), span_dedup.span_dedup(docs),
    ):
        assert result.count() == 0
    assert [r["n_hit"] for r in decontaminate.decontaminate(as_docs({1: "a b", 2: None}), items).collect()] == [0, 0]
