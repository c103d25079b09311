"""Suffix-array dedup: bytes covered by a 100-byte string that starts earlier are removed.

Spreading the work. Every 100-byte window has an anchor: of the 20-byte strings in it the one with the smallest hash, leftmost
first. Equal windows have equal anchors, so windows meet by the hash of their anchor and nothing else has to meet. Windows
next to each other mostly share an anchor; such a run with its bytes is a context, about 140 bytes for 41 windows. Equal
contexts are told by hash, and only their first one is looked at further; of an anchor with one context alone nothing is
left to compare. Where an anchor has different contexts, their texts are gathered and put into a suffix array.

The suffix array is made in two stages: suffixes smaller than their successors are sorted directly, by eight bytes at a
time; all others are induced by scanning the buckets of first bytes in ascending order. Neighbours with a common prefix of 100 bytes
are equal windows, of which all but the first in the corpus are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm import flat
from turnloom.llm.scratch import id_or_null, identified, write

SPAN = 100
GRAM = 20
_BLOCK = 1 << 19
CONTEXTS = "anchor long, context long, doc_id long, variant long, first long, n_windows long, settled boolean"
RANGES = "doc_id long, variant long, first long, last long"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    if len(x) < width:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def contexts_of(data: np.ndarray, starts: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts that stand one behind the other: (text, first window, windows, anchor hash,
    context hash). A text ends one byte before the next one starts."""
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none.astype(flat.U), none.astype(flat.U)
    prefix = flat.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    h = flat.range_hash(prefix, at, at + gram)
    # The low bits hold the place: equal hashes then go to the leftmost, and the minimum tells where it stands.
    low = flat.U((1 << int(len(data)).bit_length()) - 1)
    least = sliding_min((h & ~low) | at.astype(flat.U), span - gram + 1)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    valid = np.zeros(len(data) + 1, np.int32)  # windows that end inside their text
    sizes = np.diff(starts) - 1
    full = sizes >= span
    valid[starts[:-1][full]] += 1
    valid[starts[:-1][full] + sizes[full] - span + 1] -= 1
    window = np.flatnonzero(np.cumsum(valid)[: len(least)])
    if not len(window):
        return none, none, none, none.astype(flat.U), none.astype(flat.U)
    key = least[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(fresh)
    first, n = window[begin], np.diff(np.append(begin, len(window)))
    anchor_at = (key[begin] & low).astype(np.int64)
    inside = flat.range_hash(prefix, first, first + n + span - 1)
    shape = flat.mix((n.astype(flat.U) << flat.U(32)) + (anchor_at - first).astype(flat.U))
    owner = text[first]
    return owner, first - starts[owner], n, h[anchor_at], flat.mix(inside ^ shape)


def contexts(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """All contexts of all texts. What a batch shows to be a repeat is settled there: it comes joined to its neighbours, and
    is spread by a number of its own. So a context meets the others once a batch, however often it stands in the corpus."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            parts = []
            for rows in flat.blocks(batch.column(2), _BLOCK):
                t = flat.texts(batch.column(2), rows, lower=False)
                owner, *rest = contexts_of(t.data, t.starts, span, gram)
                parts.append((ids[rows][owner], variants[rows][owner], *rest))
            doc, variant, first, n, anchor, context = (np.concatenate([p[i] for p in parts]) for i in range(6)) if parts else (np.zeros(0, np.int64),) * 6
            order = np.lexsort((first, variant, doc))
            doc, variant, first, n, anchor, context = (v[order] for v in (doc, variant, first, n, anchor, context))
            both = flat.mix(anchor.astype(flat.U) ^ (context.astype(flat.U) * flat.U(3)))
            by_hash = np.argsort(both, kind="stable")
            same = np.zeros(len(doc), bool)
            a, b = by_hash[:-1], by_hash[1:]
            same[1:] = (both[a] == both[b]) & (anchor[a] == anchor[b]) & (context[a] == context[b])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
            later = np.zeros(len(doc), bool)
            for v in (doc, variant, first):
                later |= v[by_hash] != v[by_hash[head]]
            settled = np.zeros(len(doc), bool)
            settled[by_hash] = same & later
            # Settled neighbours become one range.
            s = np.flatnonzero(settled)
            opens = np.ones(len(s), bool)
            opens[1:] = (doc[s][1:] != doc[s][:-1]) | (variant[s][1:] != variant[s][:-1]) | (first[s][1:] > first[s][:-1] + n[s][:-1])
            o = np.flatnonzero(opens)
            ends = first[s][np.append(o[1:], len(s)) - 1] + n[s][np.append(o[1:], len(s)) - 1] if len(s) else np.zeros(0, np.int64)
            s_doc, s_variant, s_first = doc[s][o], variant[s][o], first[s][o]
            salt = flat.mix((s_doc ^ s_variant).astype(flat.U) * flat.U(0x9E3779B97F4A7C15) + s_first.astype(flat.U))
            k = ~settled
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(flat.signed(np.concatenate([anchor[k].astype(flat.U), salt]))),
                    pa.array(flat.signed(np.concatenate([context[k].astype(flat.U), salt]))),
                    pa.array(np.concatenate([doc[k], s_doc])), pa.array(np.concatenate([variant[k], s_variant])), pa.array(np.concatenate([first[k], s_first])),
                    pa.array(np.concatenate([n[k], ends - s_first])), pa.array(np.concatenate([np.zeros(k.sum(), bool), np.ones(len(o), bool)])),
                ],
                [c.split()[0] for c in CONTEXTS.split(", ")],
            )

    return docs.mapInArrow(cut, CONTEXTS)


# --- the suffix array ------------------------------------------------------------------------------


def words_at(x: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one big-endian number; bytes behind a separator (0) count as 0."""
    padded = np.concatenate([x, np.zeros(8, np.uint8)]).tobytes()
    out = np.ndarray(len(x), ">u8", buffer=padded, strides=(1,)).astype(flat.U)
    separators = np.flatnonzero(x == 0)
    for before in range(8):
        at = separators - before
        out[at[at >= 0]] &= flat.U(0xFFFFFFFFFFFFFFFF ^ ((1 << (64 - 8 * before)) - 1))
    return out


def smaller_than_next(x: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one behind it. Separators are, the earlier the smaller."""
    differs = np.flatnonzero(x[:-1] != x[1:])
    at = np.searchsorted(differs, np.arange(len(x)))
    where = np.minimum(differs[np.minimum(at, max(0, len(differs) - 1))], len(x) - 2) if len(differs) else np.zeros(len(x), np.int64)
    return np.where(x == 0, True, x[where] < x[where + 1])


def sort_directly(x: np.ndarray, places: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Places in the order of their suffixes: by eight bytes, then ties by the next eight, until the separator or `most`
    bytes."""
    order = places[np.argsort(words[places], kind="stable")]
    live = np.arange(len(order))
    key, opens, depth = words[order], np.ones(len(order), bool), 8
    opens[1:] = key[1:] != key[:-1]
    # A group of ties is named by the place, in order, of its first member.
    group = np.maximum.accumulate(np.where(opens, live, 0)) if len(live) else live
    while len(live) and depth < most:
        g = group[live]
        tied = np.zeros(len(live), bool)
        tied[1:] = g[1:] == g[:-1]
        tied[:-1] |= g[:-1] == g[1:]
        # A key whose last byte is 0 has met its separator: equal ones stay in order of place.
        tied &= (words[order[live] + depth - 8] & flat.U(255)) != 0
        live = live[tied]
        if not len(live):
            break
        key = words[np.minimum(order[live] + depth, len(x) - 1)]
        g = group[live]
        by = np.lexsort((key, g))
        order[live], key = order[live][by], key[by]
        opens = np.ones(len(live), bool)
        opens[1:] = (key[1:] != key[:-1]) | (g[1:] != g[:-1])
        group[live] = np.maximum.accumulate(np.where(opens, live, 0))
        depth += 8
    return order


def closure(wanted: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The wanted places and those that they are induced from: of a suffix larger than its successor, the successor too."""
    needed = wanted.copy()
    at = np.flatnonzero(wanted & ~small)
    while len(at):
        at = at + 1
        at = at[~needed[at]]
        needed[at] = True
        at = at[~small[at]]
    return needed


def suffix_array(x: np.ndarray, words: np.ndarray, wanted: np.ndarray | None = None, most: int = 1 << 62) -> np.ndarray:
    """Wanted places of x (all, if not told) in the order of the first `most` bytes of their suffixes.

    x ends in a separator; separators (0) differ, the earlier the smaller; words is `words_at(x)`. Only what the wanted places are induced from is
    sorted along with them.
    """
    small = smaller_than_next(x)
    needed = np.ones(len(x), bool) if wanted is None else closure(wanted, small)
    seps = np.flatnonzero((x == 0) & needed)
    direct = sort_directly(x, np.flatnonzero(small & (x > 0) & needed), words, most)
    firsts = x[direct]
    bounds = np.searchsorted(firsts, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        own = seps if c == 0 else direct[bounds[c] : bounds[c + 1]]
        queue = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        rounds = [queue]
        while len(queue):  # a run of one byte induces its own bucket
            before = queue[queue > 0] - 1
            queue = before[(x[before] == c) & ~small[before] & needed[before]]
            rounds.append(queue)
        bucket = np.concatenate([*rounds, own])
        induced[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(x[before] > c) & ~small[before] & needed[before]]
        if len(before):
            byte = x[before]
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            cuts = np.flatnonzero(np.diff(byte)) + 1
            for part in np.split(before, cuts):
                induced[x[part[0]]].append(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order if wanted is None else order[wanted[order]]


def common_prefixes(x: np.ndarray, order: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to `most` bytes; entry 0 is 0."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    depth = 0
    while len(live) and depth < most:
        a, b = words[np.minimum(order[live - 1] + depth, len(x) - 1)], words[np.minimum(order[live] + depth, len(x) - 1)]
        differ = a ^ b
        # Leading equal bytes of the two words, none of them a separator.
        equal = np.full(len(live), 8, np.int64)
        for i in range(8):
            shift = flat.U(56 - 8 * i)
            stop = (((differ >> shift) & flat.U(255)) != 0) | (((a >> shift) & flat.U(255)) == 0)
            equal = np.where((equal == 8) & stop, i, equal)
        out[live] += equal
        live = live[equal == 8]
        depth += 8
    return np.minimum(out, most)


def later_windows(pieces: list[bytes], span: int) -> list[np.ndarray]:
    """For each piece, the starts of the strings of `span` bytes that stand in an earlier piece, or earlier in this one."""
    sizes = np.array([len(p) + 1 for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    # UTF-8 has no byte over 0xF4, so one can be added to make room for the separator.
    x = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8) + np.uint8(1)
    # Only starts of whole windows are sorted; the bytes behind them are there to be compared.
    whole = np.zeros(len(x) + 1, np.int32)
    full = sizes > span
    whole[begin[:-1][full]] += 1
    whole[begin[1:][full] - span] -= 1
    words = words_at(x)
    order = suffix_array(x, words, np.cumsum(whole)[: len(x)] > 0, span)
    if not len(order):
        return [order] * len(pieces)
    equal = common_prefixes(x, order, words, span) >= span
    # In each run of equal windows the smallest place comes first in the corpus.
    group = np.cumsum(~equal) - 1
    firsts = np.minimum.reduceat(order, np.flatnonzero(~equal))
    again = np.sort(order[order != firsts[group]])
    owner = np.searchsorted(begin, again, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [again[a:b] - begin[i] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


# --- the operator ----------------------------------------------------------------------------------


def _ranges(owners: list[tuple[int, int, int]], starts: list[np.ndarray], span: int) -> pa.RecordBatch:
    """Repeated windows of pieces (doc_id, variant, first) as ranges of bytes; neighbours are joined."""
    rows: list[tuple[int, int, int, int]] = []
    for (d, v, f), s in zip(owners, starts):
        if len(s):
            cut = np.flatnonzero(np.diff(s) > 1) + 1
            low, high = s[np.concatenate([[0], cut])], s[np.concatenate([cut - 1, [len(s) - 1]])]
            rows += [(d, v, f + a, f + b + span) for a, b in zip(low.tolist(), high.tolist())]
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "variant", "first", "last"])


def compared(pieces: DataFrame, span: int, cell_bytes: int = 4 << 20) -> DataFrame:
    """Ranges repeated among pieces (anchor, doc_id, variant, first, piece), which come sorted in that order.

    Whole anchors are gathered up to about `cell_bytes`, then one suffix array compares them.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def done(part: list[tuple]) -> pa.RecordBatch:
            part.sort(key=lambda r: r[1:4])
            return _ranges([r[1:4] for r in part], later_windows([r[4] for r in part], span), span)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held > cell_bytes and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield done(rows)

    return pieces.mapInArrow(sort, RANGES)


def repeated_ranges(docs: DataFrame, span: int = SPAN, gram: int = GRAM, large: int = 100_000, cell_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, variant, first, last): ranges of bytes whose windows start earlier, too. docs is identified, see `scratch`.

    An anchor with more than `large` different contexts is not sorted in one task: the windows of its contexts are spread by
    their own hashes (128 bits), which finds the same repeats.
    """
    by_anchor = Window.partitionBy("anchor")
    # rank, not row_number: contexts at one place of one document, in repeated rows, are none earlier than the other.
    where = ["doc_id", "variant", "first"]
    place = F.rank().over(Window.partitionBy("anchor", "context").orderBy(*where))
    found = contexts(docs, span, gram).select(
        "*", place.alias("place"), F.min("context").over(by_anchor).alias("low"), F.max("context").over(by_anchor).alias("high"), F.count("*").over(by_anchor).alias("of")
    )
    again = F.col("settled") | (F.col("place") > 1)
    found = found.filter(again | (F.col("low") != F.col("high"))).select("anchor", *where, "n_windows", "of", again.alias("again"))
    found, _ = write(found, "contexts")
    settled = found.filter("again").select(*where, (F.col("first") + F.col("n_windows") + span - 1).alias("last"))

    def gather(rows: DataFrame) -> DataFrame:
        """The bytes of the contexts: texts meet their documents' contexts once, and repeated rows give them once."""
        wanted = rows.groupBy(F.col("doc_id").alias("_doc"), F.col("variant").alias("_variant")).agg(F.collect_set(F.struct("anchor", "first", "n_windows")).alias("wanted"))
        same = (F.col("doc_id") == F.col("_doc")) & (F.col("variant") == F.col("_variant"))
        both = docs.join(wanted, same).select("doc_id", "variant", F.col("text").cast("binary").alias("raw"), F.explode("wanted").alias("w"))
        piece = F.substring("raw", (F.col("w.first") + 1).cast("int"), (F.col("w.n_windows") + span - 1).cast("int"))
        return both.select("w.anchor", "doc_id", "variant", "w.first", piece.alias("piece"))

    def ordered(pieces: DataFrame) -> DataFrame:
        return pieces.repartition("anchor").sortWithinPartitions("anchor", *where)

    open_ = found.filter(~F.col("again"))
    ranges = settled.unionByName(compared(ordered(gather(open_.filter(F.col("of") <= large))), span, cell_bytes))
    huge = open_.filter(F.col("of") > large)
    if huge.limit(1).count():
        raw = F.col("piece")
        windows = gather(huge).select("doc_id", "variant", "first", raw, F.explode(F.sequence(F.lit(1), F.octet_length(raw) - span + 1)).alias("i"))
        window = F.substring(raw, F.col("i"), span)
        start = (F.col("first") + F.col("i") - 1).alias("first")
        hashed = windows.select("doc_id", "variant", start, F.xxhash64(window).alias("h1"), F.xxhash64(F.lit(1), window).alias("h2"))
        place = F.rank().over(Window.partitionBy("h1", "h2").orderBy(*where))
        later = hashed.withColumn("place", place).filter("place > 1")
        ranges = ranges.unionByName(later.select(*where, (F.col("first") + span).alias("last")))
    return ranges


def suffix_dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM, large: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay), removed (ranges).

    Texts are UTF-8 bytes; a null text is empty, one of under `span` bytes keeps all. A byte goes if a string of `span`
    bytes over it also starts earlier: in a smaller doc_id, or before in the same. Matches don't cross documents and are judged on
    the input. A null doc_id sorts last and comes back null; rows that share doc_id and text start at the same places, so
    one is never earlier than the other, and both lose the same ranges; other texts of a doc_id stand behind each other.
    Cutting bytes may split characters, so `kept` is binary. Other columns are not looked at.
    """
    own = identified(docs).select("doc_id", "variant", F.coalesce("text", F.lit("")).alias("text"))
    ranges = repeated_ranges(own, span, gram, large)
    per_doc = ranges.groupBy(F.col("doc_id").alias("_doc"), F.col("variant").alias("_variant")).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("variant") == F.col("_variant"))
    joined = own.join(per_doc, same, "left").select(id_or_null(), F.col("text").cast("binary").alias("raw"), "ranges")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        for batch in batches:
            out: list[tuple] = []
            for raw, ranges_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                merged: list[list[int]] = []
                for r in sorted((r["first"], r["last"]) for r in ranges_ or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append([r[0], min(r[1], len(raw))])
                kept, at = [], 0
                for a, b in merged:
                    b = min(b, len(raw))
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                kept = b"".join(kept)
                out.append((len(raw), len(raw) - len(kept), len(merged), kept, [{"first": a, "last": min(b, len(raw))} for a, b in merged]))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64()] * 3 + [pa.binary(), pa.list_(pair)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<first: bigint, last: bigint>>")
