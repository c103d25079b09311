"""Line dedup: explode normalised lines, hash, count documents per hash, drop repeated lines, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.scratch import identified, write

#: `[\x20\x09-\x0D]`
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. For ASCII texts `lower` does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc_id, variant, positions): the 0-based lines to drop. docs is identified, see `scratch`.

    A line goes if its key has at least `min_chars` code points, stands in at least `min_docs` documents, and this is not
    the smallest doc_id that holds it. Rows with equal doc_id are one document here; all without id are one too, the last.
    """
    lines = docs.select("doc_id", "variant", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = lines.select("doc_id", "variant", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
    # Two hashes make 128 bits, so different lines stay apart at any corpus size; texts don't enter the shuffle.
    hashed = lines.select("doc_id", "variant", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    if min_docs <= 2:  # two documents: the smallest and the largest id differ, which needs no distinct count
        seen = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).filter("keeper <> last")
    else:
        each = hashed.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        seen = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    # Written, so that the join has a plain exchange on either side: then a line that a third of all documents hold is split.
    seen, _ = write(seen.select("h1", "h2", "keeper"), "repeated-lines")
    drops = hashed.join(seen, ["h1", "h2"]).filter("doc_id <> keeper")
    return drops.groupBy("doc_id", "variant").agg(F.collect_set("pos").alias("positions"))


def without_repeats(docs: DataFrame, into: str = "line_dedup", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with one more column: n_lines, n_dropped, and text (the lines that stay, joined by a line feed)."""
    own = identified(docs, row=F.struct(*docs.columns))
    drops = repeated_lines(own.drop("row"), min_chars, min_docs).select(F.col("doc_id").alias("_doc"), F.col("variant").alias("_variant"), "positions")
    joined = own.drop("text").join(drops, (F.col("doc_id") == F.col("_doc")) & (F.col("variant") == F.col("_variant")), "left")
    lines = F.split(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "\n", -1)
    # array_except hashes, so a document of many lines costs no more a line than a short one.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("positions"))
    kept = F.when(F.col("positions").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))
    found = F.struct(
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("text"),
    )
    return joined.select("row", "positions", lines.alias("lines")).select("row", found.alias(into)).select("row.*", into)


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, text (the lines that stay, joined by a line feed).

    A null or empty text is one empty line. Rows that share a doc_id are one document, which keeps its lines
    in all of them; a null doc_id stays null; an empty table gives no rows. Other columns of docs, whatever their names, are not looked at.
    """
    return without_repeats(docs.select("doc_id", "text"), "found", min_chars, min_docs).select("doc_id", "found.*")
