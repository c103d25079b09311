"""Language-model scoring: interpolated modified Kneser-Ney over word pairs, counted in Spark, kept as sorted arrays that workers map into memory."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm import flat
from turnloom.llm.scratch import bounded, drop, write
from turnloom.session import shared_dir

U = np.uint64
#: Stands for the end of a text among the word hashes.
END = U(0xE5D1A6C39F8B7245)
#: Text bytes whose words one part of the vocabulary is made for, and tokens whose pairs one part of the pairs is made for.
WORD_PART = 128 << 20
PAIR_PART = 1 << 21
#: Words or pairs that a task sums up before it hands them on.
HELD = 1 << 20
#: Text bytes that are scored together: they ask each part once, in the order of its keys.
BLOCK = 4 << 20


# --- arrays in the shared folder ------------------------------------------------------------------------------------


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def save(uri: str, array: np.ndarray) -> None:
    """Write an array whole or not at all: a task that runs twice leaves the same file."""
    store, path = _store(uri)
    data = io.BytesIO()
    np.save(data, array)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data.getbuffer())
    store.move(own, path)


def load(uri: str) -> np.ndarray:
    """Map a file of the shared folder; a store that cannot be mapped is read."""
    store, path = _store(uri)
    if isinstance(store, pa.fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with store.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()))


def packed(first: np.ndarray, *others: np.ndarray) -> bytes:
    """Arrays of longs, the first one sorted, as planes of bytes: what is small costs little."""
    arrays = [np.diff(first.astype(U), prepend=U(0)), *(a.astype(U) for a in others)]
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)
    return len(first).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpacked(data: bytes, arrays: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = pa.Codec("zstd").decompress(data[8:], 8 * n * arrays, asbytes=True) if n else b""
    planes = np.frombuffer(raw, np.uint8).reshape(arrays, 8, n)
    out = [np.ascontiguousarray(p.T).view(U).reshape(-1) for p in planes]
    return [np.cumsum(out[0], dtype=U), *out[1:]]


def summed(a: np.ndarray, b: np.ndarray | None, *counts: np.ndarray) -> list[np.ndarray]:
    """One entry for each different a, or (a, b), in order, with its counts added up."""
    if not len(a):
        return [a, *([] if b is None else [b]), *counts]
    if b is None:
        order = np.argsort(a, kind="stable")
    elif max(a.max(), b.max()) < 1 << 32:
        order = np.argsort(a.astype(U) << U(32) | b.astype(U), kind="stable")
    else:
        order = np.lexsort((b, a))
    a, b = a[order], None if b is None else b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) if b is None else (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return [a[at], *([] if b is None else [b[at]]), *(np.add.reduceat(c[order], at) for c in counts)]


def cut(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The ranges of equal values in a sorted array."""
    at = np.flatnonzero(np.diff(part, prepend=part[:1] - 1)) if len(part) else []
    for i, k in enumerate(at):
        yield int(part[k]), slice(int(k), int(at[i + 1]) if i + 1 < len(at) else len(part))


# --- the model ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    folder: str
    #: First word id and tokens before each part of the vocabulary; one entry more than there are parts.
    first_id: np.ndarray
    before: np.ndarray
    #: Tokens and texts learned from. A text's first token has a context of its own, its id is the number of words.
    tokens: int
    texts: int
    #: What is taken off counts of 1, 2 and 3 or more: of pairs, and of the numbers of a word's predecessors.
    pair_off: np.ndarray = field(default_factory=lambda: np.zeros(3))
    word_off: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: Different pairs, and the weight that words have from nowhere.
    pairs: int = 0
    spare: float = 1.0

    @property
    def words(self) -> int:
        return int(self.first_id[-2])

    def drop(self, spark) -> None:
        drop(spark, self.folder)


def tokens(column: pa.Array, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words, each text closed by END, and where each text begins (and the last one ends)."""
    hashes, begins, at = [], [np.zeros(1, np.int64)], 0
    part = column.slice(rows.start, rows.stop - rows.start)
    for some in flat.blocks(part):  # arrays that fit a processor's cache
        t = flat.texts(part, some, lower=True)
        w = flat.words(t, flat.NOT_SPACE)
        n = len(w.first) - 1
        out = np.full(len(w.starts) + n, END)
        out[np.arange(len(w.starts)) + np.repeat(np.arange(n), np.diff(w.first))] = flat.word_hashes(t, w)
        hashes.append(out)
        begins.append(at + w.first[1:] + np.arange(1, n + 1))
        at += len(out)
    return np.concatenate(hashes), np.concatenate(begins)


def word_part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def pair_part(a_before: np.ndarray, a_count: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs lie where their first word's tokens lie, spread over them by the second word: a frequent word has many parts."""
    spread = (flat.mix(b.astype(U) + U(0x632BE5AB)) >> U(11)).astype(float) / 2.0**53
    return (a_before + np.minimum((spread * a_count).astype(np.int64), a_count - 1)) // PAIR_PART


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return flat.mix(flat.mix(a.astype(U)) + b.astype(U) * U(0x9E3779B97F4A7C15) + U(1))


def look_up(model: Model, h: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted hashes: id (-1 if unknown), tokens before the word, its count, and (with `more`) how many followers it has of one, two, more occurrences, and how many predecessors."""
    parts = len(model.first_id) - 2
    ids, before, count, around = np.full(len(h), -1), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros((len(h), 4), np.int64)
    for p, rows in cut(word_part(h, parts)):
        if model.first_id[p] == model.first_id[p + 1]:
            continue
        hashes, upto = load(f"{model.folder}/words-{p}.npy"), load(f"{model.folder}/upto-{p}.npy")
        at = np.minimum(np.searchsorted(hashes, h[rows]), len(hashes) - 1)
        known = np.flatnonzero(hashes[at] == h[rows])
        at, to = at[known], known + rows.start
        ids[to] = model.first_id[p] + at
        low = np.where(at > 0, upto[np.maximum(at - 1, 0)], 0)
        before[to], count[to] = model.before[p] + low, upto[at] - low
        if more:
            around[to] = load(f"{model.folder}/around-{p}.npy")[at]
    return ids, before, count, around


def _count_words(docs: DataFrame, parts: int) -> DataFrame:
    """(part, data) with the hashes and counts of the words of a stretch of rows."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, count = summed(np.concatenate([x for x, _ in held]), None, np.concatenate([c for _, c in held]))
            rows = [(p, packed(h[r], count[r])) for p, r in cut(word_part(h, parts))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], ["part", "data"])

        for batch in batches:
            for rows in flat.blocks(batch.column(0), BLOCK):
                held.append(np.unique(tokens(batch.column(0), rows)[0], return_counts=True))
                n += len(held[-1][0])
                if n >= HELD:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(gather, "part long, data binary")


def _save_words(folder: str):
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        blobs = [unpacked(x.as_py(), 2) for x in table.column("data")]
        h, count = summed(np.concatenate([b[0] for b in blobs]), None, np.concatenate([b[1] for b in blobs]))
        upto = np.cumsum(count.astype(np.int64))
        save(f"{folder}/words-{key[0].as_py()}.npy", h)
        save(f"{folder}/upto-{key[0].as_py()}.npy", upto)
        return pa.table({"part": [key[0].as_py()], "words": [len(h)], "tokens": [int(upto[-1])], "ends": [int(count[h == END].sum())]})

    return merge


def _count_pairs(docs: DataFrame, model: Model) -> DataFrame:
    """(part, data) with the pairs of neighbouring tokens of a stretch of rows, as word ids, and their counts."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            part, a, b, count = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(part, kind="stable")
            part, a, b, count = part[order], a[order], b[order], count[order]
            rows = [(p, packed(*summed(a[r], b[r], count[r]))) for p, r in cut(part)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], ["part", "data"])

        for batch in batches:
            for rows in flat.blocks(batch.column(0), BLOCK):
                h, first = tokens(batch.column(0), rows)
                own, at = np.unique(h, return_inverse=True)
                ids, before, count, _ = look_up(model, own, more=False)
                # The last entry is the context of a text's first token.
                ids, before, count = np.append(ids, model.words), np.append(before, model.tokens), np.append(count, model.texts)
                previous = np.empty_like(at)
                previous[1:] = at[:-1]
                previous[first[:-1]] = len(own)
                a, b, times = summed(previous, at, np.ones(len(at), np.int64))
                held.append((pair_part(before[a], count[a], ids[b]), ids[a], ids[b], times))
                n += len(a)
                if n >= HELD:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(gather, "part long, data binary")


def _save_pairs(model: Model):
    """Writes a part's sorted keys and counts; hands on, by part of the vocabulary, (kind 0) followers of words by 1, 2, more occurrences and (kind 1) predecessors, and (part -1) how many pairs occur 1 to 4 times."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        blobs = [unpacked(x.as_py(), 3) for x in table.column("data")]
        a, b, count = (np.concatenate(x) for x in zip(*blobs))
        a, b, count = summed(a, b, count)
        keys = pair_keys(a, b)
        order = np.argsort(keys, kind="stable")
        often = np.flatnonzero(count[order] >= 255)
        save(f"{model.folder}/pairs-{p}.npy", keys[order])
        save(f"{model.folder}/counts-{p}.npy", np.minimum(count[order], 255).astype(np.uint8))
        save(f"{model.folder}/often-{p}.npy", np.stack([often, count[order][often].astype(np.int64)]))
        of = [(count == k).astype(np.int64) for k in (1, 2, 3, 4)]
        ctx = summed(a, None, of[0], of[1], (count >= 3).astype(np.int64))
        word = summed(b, None, np.ones(len(b), np.int64))
        out = {c: [] for c in ("part", "kind", "data", "t1", "t2", "t3", "t4")}
        for kind, columns in ((0, ctx), (1, word)):
            where = np.searchsorted(model.first_id, columns[0].astype(np.int64), "right") - 1
            for v, rows in cut(where):
                for c, x in (("part", v), ("kind", kind), ("data", packed(*(x[rows] for x in columns))), ("t1", 0), ("t2", 0), ("t3", 0), ("t4", 0)):
                    out[c].append(x)
        for c, x in (("part", -1), ("kind", 0), ("data", b""), *((f"t{k + 1}", int(of[k].sum())) for k in range(4))):
            out[c].append(x)
        return pa.table([pa.array(v, pa.binary() if c == "data" else pa.int64()) for c, v in out.items()], list(out))

    return merge


PAIR_SCHEMA = "part long, kind long, data binary, t1 long, t2 long, t3 long, t4 long"


def _save_around(model: Model):
    """Followers and predecessors of each word of a part, in the order of their ids; hands on how many words have 1 to 4 predecessors, and the number of all."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        first = int(model.first_id[p])
        total = np.zeros((int(model.first_id[p + 1]) - first, 4), np.int64)
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data")):
            columns = unpacked(data.as_py(), 4 if kind == 0 else 2)
            at = columns[0].astype(np.int64) - first
            for i, c in enumerate(columns[1:]):
                total[at, i if kind == 0 else 3] += c.astype(np.int64)
        save(f"{model.folder}/around-{p}.npy", total.astype(np.min_scalar_type(int(total.max(initial=0)))))
        return pa.table({**{f"t{k}": [int((total[:, 3] == k).sum())] for k in (1, 2, 3, 4)}, "words": [int((total[:, 3] > 0).sum())], "pairs": [int(total[:, 3].sum())]})

    return merge


def taken_off(n: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more, from how often the counts 1 to 4 occur.

    Where a count doesn't occur, the formula has no value or one out of range; then the nearest value that leaves every
    context some weight for what it hasn't seen: at least 0.05, at most the count.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    off = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.array([min(max(x, 0.05), k) for k, x in enumerate(off, 1)])


def fit(docs: DataFrame, learn: Column) -> Model:
    """The model of the texts of all rows for which `learn` holds; a null text counts as empty, rows that come twice count twice.

    Words and pairs are summed up in tasks before they are shuffled, so a frequent one meets once a task; parts are cut by
    number of tokens, and the pairs of a frequent first word are spread over several. The driver gets four numbers for each part
    of the vocabulary (128 MB of text) and sums.
    """
    spark = docs.sparkSession
    bounded(spark)
    texts = docs.filter(F.coalesce(learn, F.lit(False))).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = 1 + size // WORD_PART
    folder = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    # The folder is made by a table that stays empty: workers only add files.
    spark.createDataFrame([], "part long").write.parquet(folder)
    counted = _count_words(texts, parts).groupBy("part").applyInArrow(_save_words(folder), "part long, words long, tokens long, ends long").collect()
    words, n_tokens = np.zeros(parts + 2, np.int64), np.zeros(parts + 1, np.int64)
    words[-1] = 1  # the context of a text's first token has a part of its own
    for r in counted:
        words[r["part"] + 1], n_tokens[r["part"] + 1] = r["words"], r["tokens"]
    model = Model(folder, np.cumsum(words), np.cumsum(n_tokens), int(n_tokens.sum()), sum(r["ends"] for r in counted))
    pair_parts = (model.tokens + model.texts) // PAIR_PART + 1
    empty = packed(*[np.zeros(0, np.int64)] * 3)
    every_part = spark.range(pair_parts).select(F.col("id").alias("part"), F.lit(empty).alias("data"))
    found, table = write(_count_pairs(texts, model).unionByName(every_part).groupBy("part").applyInArrow(_save_pairs(model), PAIR_SCHEMA), "ngram-pairs")
    model.pair_off = taken_off([int(x or 0) for x in found.agg(*(F.sum(f"t{k}") for k in (1, 2, 3, 4))).first()])
    around = found.filter("part >= 0").groupBy("part").applyInArrow(_save_around(model), "t1 long, t2 long, t3 long, t4 long, words long, pairs long")
    sums = [int(x or 0) for x in around.agg(*(F.sum(c) for c in around.columns)).first()]
    drop(spark, table)
    model.word_off, model.pairs = taken_off(sums[:4]), sums[5]
    if model.pairs:
        model.spare = float(model.word_off @ [sums[0], sums[1], sums[4] - sums[0] - sums[1]]) / model.pairs
    return model


def _less(count: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts after what is taken off them; none is left of a count of 0."""
    return np.where(count > 0, count - off[np.clip(count, 1, 3) - 1], 0.0)


def _pair_counts(model: Model, part: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), np.int64)
    order = np.lexsort((keys, part))
    for p, rows in cut(part[order]):
        stored = load(f"{model.folder}/pairs-{p}.npy")
        if not len(stored):
            continue
        to = order[rows]
        at = np.minimum(np.searchsorted(stored, keys[to]), len(stored) - 1)
        known = np.flatnonzero(stored[at] == keys[to])
        at, to = at[known], to[known]
        count = load(f"{model.folder}/counts-{p}.npy")[at].astype(np.int64)
        places, times = load(f"{model.folder}/often-{p}.npy")
        high = np.flatnonzero(count == 255)
        count[high] = times[np.searchsorted(places, at[high])]
        out[to] = count
    return out


def measured(model: Model, column: pa.Array, rows: slice) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each of the texts."""
    h, first = tokens(column, rows)
    own, at = np.unique(h, return_inverse=True)
    ids, before, count, around = look_up(model, own, more=True)
    parts = len(model.first_id) - 2
    start = np.array(load(f"{model.folder}/around-{parts}.npy")) if model.texts else np.zeros((1, 4), np.int64)
    word = _less(around[:, 3], model.word_off) / max(1, model.pairs) + model.spare / (model.words + 1)
    base = np.log10((count + 1) / (model.tokens + model.words + 1))
    # The last entry is the context of a text's first token.
    ids, before, count, around = np.append(ids, model.words), np.append(before, model.tokens), np.append(count, model.texts), np.vstack([around, start])
    rest = np.where(count > 0, (around[:, :3] @ model.pair_off) / np.maximum(count, 1), 1.0)
    previous = np.empty_like(at)
    previous[1:] = at[:-1]
    previous[first[:-1]] = len(own)
    pair, of = np.unique(previous * len(own) + at, return_inverse=True)
    a, b = pair // len(own), pair % len(own)
    known = np.flatnonzero((count[a] > 0) & (ids[b] >= 0))
    ka, kb = a[known], b[known]
    seen = np.zeros(len(pair), np.int64)
    seen[known] = _pair_counts(model, pair_part(before[ka], count[ka], ids[kb]), pair_keys(ids[ka], ids[kb]))
    log = np.log10(_less(seen, model.pair_off) / np.maximum(count[a], 1) + rest[a] * word[b])
    begin = first[:-1]
    return [np.diff(first), np.add.reduceat((ids[at] >= 0).astype(np.int64), begin), np.add.reduceat(base[at], begin), np.add.reduceat(log[of], begin)]


FIELDS = "n_tokens: bigint, n_known: bigint, base_score: double, score: double, perplexity: double"


def score(docs: DataFrame, model: Model, columns: list[str] | None = None, into: str = "lm") -> DataFrame:
    """The given columns of docs (all, if none are given) with one more, `into`: n_tokens, n_known, base_score, score and perplexity of each text.

    A null or empty text has one token, its end. Words that the model doesn't know share the probability that the interpolation
    leaves for one word never seen. Each row is scored on its own; a column named as `into` is replaced.
    """
    bounded(docs.sparkSession)
    columns = [c for c in (docs.columns if columns is None else columns) if c != into]
    row = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row.alias("row"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in flat.blocks(batch.column(0), BLOCK):
                n, known, base, log = measured(model, batch.column(0), rows)
                found = pa.StructArray.from_arrays([pa.array(x) for x in (n, known, base, log, 10 ** np.minimum(-log / n, 300))], [f.split(":")[0] for f in FIELDS.split(", ")])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(rows.start, rows.stop - rows.start), found], ["row", "lm"])

    out = rows.mapInArrow(rate, f"row {rows.schema['row'].dataType.simpleString()}, lm struct<{FIELDS}>")
    return out.select(*(F.col(f"row.`{c}`") for c in columns), F.col("lm").alias(into))
