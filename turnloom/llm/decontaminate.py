"""Benchmark decontamination: one Aho-Corasick automaton over normalised items scans every text once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from turnloom.llm import flat
from turnloom.llm.scratch import bounded, write

#: Every byte that is in no word becomes a space, A-Z become a-z.
NORMAL = bytes(int(flat.LOWER[b]) if flat.ALNUM[flat.LOWER[b]] else 0x20 for b in range(256))

_HIT = pa.struct([("first_word", pa.int64()), ("n_window", pa.int64()), ("items", pa.list_(pa.string())), ("first_char", pa.int64()), ("end_char", pa.int64())])
FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(_HIT))])
FOUND = from_arrow_type(FOUND_ARROW)


def normalised(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return [w for w in (text or "").encode().translate(NORMAL).split(b" ") if w]


def windows(items: DataFrame, width: int = 13) -> DataFrame:
    """Each distinct window of the items' words with the ids of its items: (window, items).

    An item of fewer words is one window, an item without words (or null) none. A null item_id is the string "null".
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for i, text in zip(ids, batch.column(1).to_pylist()):
                w = normalised(text)
                out += {(i, b" ".join(w[k : k + width]).decode()) for k in range(max(1, len(w) - width + 1))} if w else ()
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["item", "window"])

    flat_items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    return flat_items.mapInArrow(cut, "item string, window string").groupBy("window").agg(F.collect_set("item").alias("items"))


def automaton(rows: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton:
    """Windows stand between spaces, so that they match whole words only. One byte is one character here."""
    a = ahocorasick.Automaton()
    for k, (window, items) in enumerate(rows):
        a.add_word(f" {window.decode('latin-1')} ", (k, window.count(b" ") + 1, items))
    a.make_automaton()
    return a


def _found(text: str | None, machine: ahocorasick.Automaton | None) -> tuple[int, list[dict]]:
    """Number of words, and every occurrence of a window with its place in the original text."""
    if not text:
        return 0, []
    if machine is None:
        return len(normalised(text)), []
    raw = text.encode()
    split = [w for w in raw.translate(NORMAL).split(b" ") if w]
    plain = b" " + b" ".join(split) + b" "
    found = list(machine.iter(plain.decode("latin-1")))
    if not found:
        return len(split), []
    # Words ended so far at each byte of the normalised text; first and last byte of each word in the original.
    ended = np.cumsum(np.frombuffer(plain, np.uint8) == 0x20) - 1
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = flat.ALNUM[flat.LOWER[data]]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out = []
    for at, (_, size, items) in found:
        first = int(ended[at]) - size
        out.append(
            {
                "first_word": first, "n_window": size, "items": items,
                "first_char": int(chars[starts[first]]), "end_char": int(chars[ends[first + size - 1]]),
            }
        )
    return len(split), out


def scan(docs: DataFrame, items: DataFrame, into: str = "contamination", width: int = 13, block_bytes: int = 64 << 20) -> DataFrame:
    """docs with one more column: the number of words and every occurrence of a window. Nothing is shuffled.

    Offsets are code points of the text as it was: first_char:end_char is the occurrence. The automaton is broadcast, and
    its size is checked first: items of more than `block_bytes` of windows are spread over several automata. Rows pass them
    one after the other, written in between so that a worker holds one at a time; no broadcast grows with the benchmark.
    """
    spark = docs.sparkSession
    bounded(spark)
    cut = windows(items, width)
    size = cut.agg(F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    at, out, names = docs.columns.index("text"), docs, [*docs.columns, into]
    for k in range(n):
        block = cut if n == 1 else cut.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k)
        shared = spark.sparkContext.broadcast([(r["window"].encode(), sorted(r["items"])) for r in block.toLocalIterator()])

        def step(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value) if shared.value else None
            for batch in batches:
                found = [_found(t, machine) for t in batch.column(at).to_pylist()]
                so_far = [[] for _ in found] if first else [x["hits"] for x in batch.column(batch.num_columns - 1).to_pylist()]
                column = pa.array([{"n_words": m, "hits": old + new} for (m, new), old in zip(found, so_far)], FOUND_ARROW)
                kept = batch.columns if first else batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, column], names)

        schema = T.StructType([*docs.schema.fields, T.StructField(into, FOUND)])
        out = (write(out, "scanned")[0] if k else out).mapInArrow(step, schema)
    return out


def covered(hits: Column) -> Column:
    """Number of words inside any of the hits."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(acc, s):
        end = s["first_word"] + s["n_window"]
        fresh = F.greatest(end - F.greatest(acc["upto"], s["first_word"]), F.lit(0).cast("long"))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(F.array_sort(hits), empty, add, lambda acc: acc["n"])


def is_contaminated(found: Column, share_inverse: int = 20) -> Column:
    """At least one word in `share_inverse` stands in an occurrence of a window."""
    n_hit = covered(found["hits"])
    return (n_hit > 0) & (share_inverse * n_hit >= found["n_words"])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, share_inverse: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated, hits.

    A document without words (null, empty) has no hit; rows that share a doc_id are judged each on its own; a null doc_id
    stays null; without items nothing is hit. Other columns of docs, whatever their names, are not looked at.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = scan(own, items, "found", width).select("doc_id", "found", is_contaminated(F.col("found"), share_inverse).alias("contaminated"))
    item_ids = F.array_sort(F.array_distinct(F.flatten(F.col("found.hits.items"))))
    return found.select(
        "doc_id", "found.n_words", covered(F.col("found.hits")).alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"),
        item_ids.alias("item_ids"), "contaminated", "found.hits",
    )
