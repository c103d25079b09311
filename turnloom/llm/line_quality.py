"""Quality rules by cross-document line frequency, in DataFrame functions only.

Normalised lines are hashed and counted by distinct documents per host; lines above the limit are removed, and documents
that lose most of their text by that are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.line_dedup import SPACE, line_key
from turnloom.llm.scratch import id_or_null, identified

WINDOW = 8


def _words(text: Column) -> Column:
    """`[^\\x20\\x09-\\x0D]+`"""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, host, text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and `lines`.

    Each step is a projection of its own, and every array that a lambda looks into is a column: Catalyst would compute it
    anew for each element otherwise.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", "variant", "host", "text", _words(text).alias("words"), F.split(text, "\n", -1).alias("lines"))
    worded = F.filter("lines", lambda line: F.btrim(line, F.lit(SPACE)) != "")
    counted = split.select(
        "doc_id", "variant", "host", "text", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        worded.alias("worded"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    n_runs = F.size("hashes") - WINDOW + 1
    runs = F.when(n_runs > 0, F.transform(F.sequence(F.lit(1), n_runs), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))))
    windows = counted.select("*", runs.alias("runs"), (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"))
    # Most texts repeat no window; only the others sort theirs.
    repeats = F.size(F.array_distinct("runs")) < F.size("runs")
    pairs = windows.select("*", F.when(repeats, F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("pairs"))
    equal = lambda k, x: F.coalesce(F.get("pairs", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("pairs", lambda x, k: equal(k - 1, x) | equal(k + 1, x))
    found = pairs.select("*", F.array_sort(F.transform(twice, lambda x: x["i"])).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    # Words that repeated windows cover: each adds what lies behind the end of the one before.
    add = lambda acc, p: F.struct((acc["n"] + (p + WINDOW - F.greatest(p, acc["upto"]))).alias("n"), (p + WINDOW).alias("upto"))
    covered = F.coalesce(F.aggregate("at", start, add, lambda acc: acc["n"]), F.lit(0))
    return found.select("doc_id", "variant", "host", "text", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def frequent_lines(docs: DataFrame, min_chars: int, min_docs: int, share: float) -> DataFrame:
    """(host, h1, h2): hashes of the lines in more than `min_docs` distinct documents of a host, and in more than `share` of its documents.

    Where every id stands once, which one aggregate tells, a row is a document and is counted as it comes; else rows of one id
    are counted once.
    """
    lines = docs.select("host", "doc_id", F.explode(F.array_distinct(_line_hashes(min_chars))).alias("line")).select("host", "doc_id", "line.*")
    ids = docs.select("host", "doc_id")
    if docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        lines, ids = lines.groupBy("host", "h1", "h2", "doc_id").agg(F.lit(1).alias("one")), ids.distinct()
    voters = lines.groupBy("host", "h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    sizes = ids.groupBy("host").agg(F.count("*").alias("documents"))
    return voters.join(sizes, "host").filter(F.col("n") > share * F.col("documents")).select("host", "h1", "h2")


def _line_hash(key: Column) -> Column:
    """Two hashes make 128 bits, so different lines stay apart at any corpus size."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _line_hashes(min_chars: int, text: str = "text") -> Column:
    """Hash of each line's key, of those with at least `min_chars` code points."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line_key)
    return F.transform(F.filter(keys, lambda k: F.char_length(k) >= min_chars), _line_hash)


def line_quality(
    docs: DataFrame, host: str = "source", min_chars: int = 10, min_docs: int = 10, share: float = 0.01, least_kept: float = 0.3,
    min_words: int = 20, most_repeated: int = 30,
) -> DataFrame:
    """One row per row of docs: doc_id, the base measures, base_failed, n_removed_lines, kept_chars, kept, text.

    Base: words `[^\\x20\\x09-\\x0D]+`; base_failed with under `min_words` words or over `most_repeated` percent of the words in
    repeated 8-word windows. A line (stripped, A-Z lower-cased, at least `min_chars` code points) is removed if more than `min_docs`
    distinct documents of its host hold it, and more than `share` of the host's documents. `kept` is false if base_failed, or
    if the lines that stay hold less than `least_kept` of the lines' characters. Null text: no words, failed. A null
    host is a host of its own; rows that share a doc_id are one document, those that share its text too
    are judged alike; all rows without id are one document, whose id comes back null. `text` is the
    text without removed lines (null if it was null); it costs a shuffle of texts only where it is used.
    """
    own = identified(docs, host=F.coalesce(F.col(host).cast("string"), F.lit("\x00")))
    key = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)
    numbered = own.select("doc_id", "variant", "host", F.posexplode(key).alias("pos", "key")).filter(F.char_length("key") >= min_chars)
    hashed = numbered.select("doc_id", "variant", "host", "pos", _line_hash(F.col("key")).alias("line"), F.char_length("key").alias("chars")).select("*", "line.h1", "line.h2")
    gone = hashed.join(frequent_lines(own, min_chars, min_docs, share), ["host", "h1", "h2"]).groupBy(F.col("doc_id").alias("_doc"), F.col("variant").alias("_variant")).agg(
        F.collect_set(F.struct("pos", "chars")).alias("gone")
    )
    base = measured(own).withColumn("line_chars", F.aggregate(F.transform("lines", lambda x: F.char_length(F.btrim(x, F.lit(SPACE)))), F.lit(0), lambda a, x: a + x).cast("long"))
    joined = base.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("variant") == F.col("_variant")), "left")
    removed = F.coalesce(F.aggregate(F.transform("gone", lambda x: x["chars"]), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    kept_chars = F.col("line_chars") - removed
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("gone", lambda x: x["pos"]))
    left = F.when(F.col("gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        id_or_null(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (kept_chars >= least_kept * F.col("line_chars"))).alias("kept"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"), kept_chars.alias("kept_chars"), left.alias("text"),
    )
