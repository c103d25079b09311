"""Packing: shortest-pack-first over the histogram of piece lengths, then patterns joined back to pieces by rank."""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnloom.llm import flat
from turnloom.llm.scratch import id_or_null, identified, write

# How the byte-level tokenizer cuts a text before it merges bytes.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


class Encoder:
    """Ids of a byte-level BPE file as little-endian unsigned 32-bit numbers, as the file's own tokenizer gives them: a special
    token's string in a text is that token.

    Where the file's merges are in order of their ids, an id is a rank, and a rank merger gives the ids of the file's own
    tokenizer several times as fast. Any other file is read by its tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = self._ranked(json.loads(self.tokenizer.to_str()))
        if self.ranked:
            self.tokenizer = None  # a worker holds one copy of the vocabulary

    @staticmethod
    def _ranked(file: dict) -> tiktoken.Encoding | None:
        model, cut = file["model"], file["pre_tokenizer"] or {}
        if model["type"] != "BPE" or file["normalizer"] or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            return None
        vocabulary = model["vocab"]
        joined = (m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"])
        if any(vocabulary[w] != 256 + i for i, w in enumerate(joined)):
            return None
        # Printable bytes stand for themselves in the file, the others for the characters from 256 on.
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or b >= 0xA1 and b != 0xAD]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {a["content"]: a["id"] for a in file["added_tokens"]}
        if any(a[f] for a in file["added_tokens"] for f in ("lstrip", "rstrip", "single_word", "normalized")) or any(a != b and a in b for a in special for b in special):
            return None
        ranks = {bytes(byte[c] for c in w): i for w, i in vocabulary.items() if w not in special}
        return tiktoken.Encoding("from file", pat_str=CUTS, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        ids = self.ranked.encode(text, allowed_special="all") if self.ranked else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """Every document's ids with `end_id` behind them, cut at multiples of `size`: (doc_id, start, length, doc_tokens, ids).

    ids are little-endian unsigned 32-bit numbers. A null text is an empty one: one piece with the end id alone.
    """
    ends = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step = flat.per_worker(("ids", tokenizer), lambda: Encoder(tokenizer)), 4 * size
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + ends
                out += [(doc_id, k // 4, len(ids[k : k + step]) // 4, len(ids) // 4, ids[k : k + step]) for k in range(0, len(ids), step)]
                held += len(ids)
                if held > 16 << 20:
                    yield _batch(out)
                    out, held = [], 0
            yield _batch(out)

    return identified(docs).select("doc_id", "text").mapInArrow(cut, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in PIECES.split(", ")])


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, how many sequences): longest lengths first, each into the shortest packs that exist.

    Packs are kept by the room they have left, so work depends on the number of lengths, never on the number of pieces.
    """
    by_room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left, opened = histogram[length], []
        while left:
            # The shortest pack has most room. One of this length joins each pack once, then the grown packs wait for
            # the other lengths and for the next round below.
            room = rooms[-1] if rooms and rooms[-1] >= length else None
            if room is None:
                fits = size // length
                whole, rest = divmod(left, fits)
                opened += [((length,) * fits, whole)] * bool(whole) + [((length,) * rest, 1)] * bool(rest)
                break
            pattern, count = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(bisect_left(rooms, room))
            used = min(left, count)
            left -= used
            put(room - length, (*pattern, length), used)
            if count > used:
                put(room, pattern, count - used)
        for pattern, count in opened:
            put(size - sum(pattern), pattern, count)
    found = Counter()
    for same in by_room.values():
        for pattern, count in same:
            found[pattern] += count
    return sorted(found.items(), reverse=True)


def _slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset): pieces of a length, by rank, to sequences of a pattern."""
    rank, out, first = Counter(), [], 0
    for pattern, count in found:
        offset = 0
        for length in pattern:
            out.append((length, rank[length], count, first, offset))
            rank[length] += count
            offset += length
        first += count
    return out


def ranked(rows: DataFrame, per_bucket: int = 20_000) -> DataFrame:
    """rows with `rank`: 0, 1, 2 ... within each length, by bucket, doc_id and start.

    A length that a third of all pieces have is split: pieces are numbered inside buckets of a bounded size, and the
    buckets' counts, summed before, give each its first rank.
    """
    total = rows.count()
    n = max(1, -(-total // per_bucket))
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)))
    counts = bucketed.groupBy("length", "bucket").count()
    # Running sums in two steps, so that no window holds all buckets of one length of a large table.
    part = F.floor(F.col("bucket") / 1000)
    inside = Window.partitionBy("length", part).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("length", part.alias("part")).agg(F.sum("count").alias("sum"))
    parts = parts.select("length", "part", F.coalesce(F.sum("sum").over(above), F.lit(0)).alias("before"))
    firsts = counts.withColumn("part", part).withColumn("inside", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    firsts = firsts.join(parts, ["length", "part"]).select("length", "bucket", (F.col("before") + F.col("inside")).alias("first_rank"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start")
    numbered = bucketed.withColumn("in_bucket", F.row_number().over(own) - 1)
    return numbered.join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first_rank") + F.col("in_bucket")).drop("bucket", "in_bucket", "first_rank")


def assign(rows: DataFrame, size: int = 1024) -> DataFrame:
    """rows (with doc_id, start, length) with sequence_id and offset.

    The histogram has at most `size` entries whatever the number of pieces, so it and the patterns fit the driver. Slots
    are cut at ranks that are multiples of a step, so that a piece finds its slot by equality and not by a range join.
    """
    spark = rows.sparkSession
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    slots = _slots(patterns(histogram, size))
    step = {length: max(1, n // 64) for length, n in histogram.items()}
    table = [(*s, step[s[0]]) for s in slots]
    slots_df = spark.createDataFrame(table, "length long, slot_rank long, slot_count long, slot_sequence long, offset long, step long")
    cells = F.explode(F.sequence(F.floor(F.col("slot_rank") / F.col("step")), F.floor((F.col("slot_rank") + F.col("slot_count") - 1) / F.col("step"))))
    slots_df = slots_df.withColumn("cell", cells)
    steps_df = spark.createDataFrame(list(step.items()), "length long, step long")
    by_rank = ranked(rows).join(F.broadcast(steps_df), "length")  # at most `size` rows
    by_rank = by_rank.withColumn("cell", F.floor(F.col("rank") / F.col("step"))).drop("step")
    # At most `size` lengths times 64 cells, and a row more for each slot, of which patterns make a few per length.
    placed = by_rank.join(F.broadcast(slots_df.drop("step")), ["length", "cell"]).filter("rank >= slot_rank and rank < slot_rank + slot_count")
    return placed.withColumn("sequence_id", F.col("slot_sequence") + F.col("rank") - F.col("slot_rank")).select(*rows.columns, "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, size: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset.

    Each document (its ids and one end id) is cut at multiples of `size`; full pieces are sequences of their own, the rest
    is packed. Null texts count as empty; rows that share a doc_id are packed as documents of their own; a null doc_id
    stays null; an empty table gives no rows. Texts are encoded once: ids are digested before anything is shuffled, and
    `pieces` gives them again for a writer of sequences (`sequences`).
    """
    cut = pieces(docs, tokenizer, size)
    table, _ = write(cut.select("doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32")), "pieces")
    return assign(table, size).select(id_or_null(), "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str, size: int = 1024, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (binary, padded to `size` unless full to a power of two)."""
    # Ids may be null or repeated: each piece gets a number of its own, which the written table keeps.
    table, _ = write(pieces(docs, tokenizer, size).withColumn("piece", F.monotonically_increasing_id()), "piece-ids")
    placed = assign(table.select("doc_id", "start", "length", "piece"), size)
    whole = table.join(placed.select("piece", "sequence_id", "offset"), "piece").groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    ids = F.aggregate("parts", F.unhex(F.lit("")), lambda acc, p: F.concat(acc, p["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(size) - F.col("n_tokens")).cast("int")))
    power = F.bit_count("n_tokens") == 1
    return whole.select("sequence_id", "n_tokens", F.when(power, ids).otherwise(F.concat(ids, pad)).alias("ids"))
