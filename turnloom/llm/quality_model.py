"""Quality classifier: random-indexing vectors of all words, pooled per document, into a two-layer network with calibrated scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import flat
from turnloom.llm.scratch import bounded, write
from turnloom.llm.supervised import adam, fold, labelled_sample, sigmoid

#: Words fall into six shapes (lower, Title, UPPER, mixed, digits, signs). Their index vectors are drawn from a place, of which
#: each shape has this many; what a word learns is its own.
PLACES = 2048
SHAPES = 6
DIM = 32
NONZERO = 4
#: Neighbours on either side that a word learns from.
REACH = 2
#: Words that one step counts together.
SLICE = 1 << 21
#: Up to so many neighbours are kept as their places, which takes less room than their sum.
LISTED = 12
#: The mean of unit vectors is taken over integers, so that it is the same whatever the order.
UNIT = 1 << 24
SUMS = [f"s{i}" for i in range(DIM)]
UNITS = [f"u{i}" for i in range(DIM)]

# Classes of bytes: 0 white space and control characters, 1 letters (everything beyond ASCII is one), 2 digits, 3 signs.
_CLASS = np.full(256, 3, np.int8)
_CLASS[:0x21] = 0
_CLASS[0x7F] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1


@dataclass
class Model:
    words: Words
    mean: np.ndarray
    scale: np.ndarray
    #: Weights and biases of both layers.
    layers: list[np.ndarray]
    temperature: float


def keyed(column: pa.Array, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and place of every word of the texts (runs of bytes of one class), and where each text's words begin."""
    t = flat.texts(column, rows, lower=False)
    kind = _CLASS[t.data]
    edge = np.flatnonzero(np.diff(kind, prepend=0))
    ends = np.append(edge[1:], len(kind))
    word = kind[edge] > 0
    starts, ends = edge[word], ends[word]
    of = kind[starts]
    upper = np.concatenate([[0], np.cumsum(_UPPER[t.data])])
    n_upper, first_upper = upper[ends] - upper[starts], _UPPER[t.data[starts]]
    shape = np.select([of == 2, of == 3, n_upper == 0, n_upper == ends - starts, (n_upper == 1) & (first_upper == 1)], [4, 5, 0, 2, 1], 3)
    first = np.searchsorted(starts, t.starts)
    h = flat.word_hashes(flat.Texts(flat.LOWER[t.data], t.starts), flat.Words(starts, ends, first))
    key = h << flat.U(3) | shape.astype(flat.U)
    return key, place_of(key), first


def place_of(key: np.ndarray) -> np.ndarray:
    """A key holds 61 bits of the word's hash and 3 of its shape."""
    key = key.astype(flat.U)
    return ((key & flat.U(7)) * flat.U(PLACES) + (key >> flat.U(3)) % flat.U(PLACES)).astype(np.int64)


def places(column: pa.Array, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """The place of every word of the texts, and where each text's words begin."""
    return keyed(column, rows)[1:]


def batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, place and text of every word of a batch."""
    parts = [(np.zeros(0, flat.U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for rows in flat.blocks(column):
        key, place, first = keyed(column, rows)
        parts.append((key, place, rows.start + np.repeat(np.arange(len(first) - 1), np.diff(first))))
    return tuple(np.concatenate(p) for p in zip(*parts))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Each place's own sparse random vector: NONZERO dimensions and their signs, drawn from its number."""
    n = SHAPES * PLACES
    h = flat.mix(np.arange(n * NONZERO, dtype=flat.U) + flat.U(0x51ED27)).reshape(n, NONZERO)
    return (h % flat.U(DIM)).astype(np.int64), np.where((h >> flat.U(40)) & flat.U(1), 1.0, -1.0)


def word_sums(docs: DataFrame) -> DataFrame:
    """(key, sums): for each word the sum, over all its places in all documents, of its neighbours' index vectors.

    Batches add up their own words, so that a hash meets once a batch, and sorted keys are added in 64 bits as they stream
    through a task: nothing is bounded but by the number of words. `sums` are packed, see `_unpacked`.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, place, doc = batch_words(batch.column(0))
            for at in range(0, len(key), SLICE):
                yield _sums_of(key, place, doc, np.arange(at, min(len(key), at + SLICE)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                key, sums = batch.column(0), batch.column(1)
                if held is not None:
                    key, sums = (pa.concat_arrays([h, c]) for h, c in zip(held, (key, sums)))
                key, sums = _added(key.to_numpy(), sums)
                held = key[-1:], sums[-1:]
                yield pa.RecordBatch.from_arrays([key[:-1], sums[:-1]], ["key", "sums"])
        if held is not None:
            yield pa.RecordBatch.from_arrays(list(held), ["key", "sums"])

    schema = "key long, sums binary"
    bounded(docs.sparkSession)
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(gather, schema)
    return write(found.repartition("key").sortWithinPartitions("key").mapInArrow(add, schema), "word-sums")[0]


def _sums_of(key: np.ndarray, place: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """(key, sums) of the words at `at`."""
    near = np.full((len(at), 2 * REACH), -1)
    for i, d in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        to = np.clip(at + d, 0, len(key) - 1)
        near[:, i] = np.where((to == at + d) & (doc[to] == doc[at]), place[to], -1)
    own, local, times = np.unique(key[at], return_inverse=True, return_counts=True)
    few = times * 2 * REACH <= LISTED
    often = np.flatnonzero(~few)
    sums = np.empty(len(own), object)
    token = np.flatnonzero(few[local])
    token = token[np.argsort(local[token], kind="stable")]
    there = near[token] >= 0
    data = near[token][there].astype(np.uint16).tobytes()
    ends = 2 * np.cumsum(np.bincount(local[token], there.sum(1), len(own)).astype(np.int64))[few]
    sums[few] = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    row = np.zeros(len(own), np.int64)
    row[often] = np.arange(len(often))
    token = np.flatnonzero(~few[local])
    row, near = np.repeat(row[local[token]], 2 * REACH), near[token].reshape(-1)
    sums[often] = _packed(_index_sums(row[near >= 0], near[near >= 0], len(often)))
    return pa.RecordBatch.from_arrays([pa.array(flat.signed(own)), pa.array(sums.tolist(), pa.binary())], ["key", "sums"])


def _index_sums(row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sums of the index vectors of places, by row."""
    dims, signs = index_vectors()
    out = np.zeros(n * DIM)
    for k in range(NONZERO):
        out += np.bincount(row * DIM + dims[place, k], signs[place, k], n * DIM)
    return out.reshape(n, DIM).astype(np.int64)


def _added(key: np.ndarray, sums: pa.Array) -> tuple[pa.Array, pa.Array]:
    """One row for each of the sorted keys."""
    first = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
    group = np.repeat(np.arange(len(first)), np.diff(first, append=len(key)))
    rows, size = sums.to_pylist(), pc.binary_length(sums).to_numpy()
    single = np.diff(first, append=len(key)) == 1
    whole = np.add.reduceat(size, first)
    listed = (np.maximum.reduceat(size, first) <= 2 * LISTED) & (whole <= 2 * LISTED)
    data, ends = b"".join(rows), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    low, high = ends[first], ends[np.append(first[1:], len(key))]
    out = np.empty(len(first), object)
    same = single | listed
    out[same] = [data[a:b] for a, b in zip(low[same].tolist(), high[same].tolist())]
    at = np.flatnonzero(~same[group])
    if len(at):
        start = np.flatnonzero(np.diff(group[at], prepend=-1))
        out[~same] = _packed(np.add.reduceat(_unpacked(sums.take(pa.array(at))), start))
    return pa.array(key[first]), pa.array(out.tolist(), pa.binary())


def _packed(sums: np.ndarray) -> np.ndarray:
    """Each row as the narrowest integers that hold it; its length tells their width."""
    high = np.abs(sums).max(1) if len(sums) else np.zeros(0, np.int64)
    out = np.empty(len(sums), object)
    for width, low in ((8, 2**31 - 1), (4, 2**15 - 1), (2, 127), (1, -1)):
        at = np.flatnonzero((high > low) & (high <= 2 ** (8 * width - 1) - 1))
        raw = sums[at].astype(f"i{width}").tobytes()
        out[at] = [raw[i : i + width * DIM] for i in range(0, len(raw), width * DIM)]
    return out


def _unpacked(column: pa.Array) -> np.ndarray:
    """Sums of each row, be they packed or listed as at most LISTED places of two bytes; a null is a row of zeros."""
    rows, out = column.to_pylist(), np.zeros((len(column), DIM), np.int64)
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for width in (1, 2, 4, 8):
        at = np.flatnonzero(size == width * DIM)
        out[at] = np.frombuffer(b"".join([rows[i] for i in at.tolist()]), f"i{width}").reshape(-1, DIM)
    at = np.flatnonzero((size > 0) & (size <= 2 * LISTED))
    place = np.frombuffer(b"".join([rows[i] for i in at.tolist()]), np.uint16).astype(np.int64)
    out[at] = _index_sums(np.repeat(np.arange(len(at)), size[at] // 2), place, len(at))
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))


def _centred(sums: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Vectors of unit length. Common words say little: what all vectors have in common is taken off. Zeros stay zeros."""
    v = _unit(sums)
    return _unit(np.where(np.abs(v).sum(1, keepdims=True) > 0, v - common, 0))


def summary(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the words of each place, [places, DIM], and the mean of the words' unit vectors."""
    names = [*SUMS, *UNITS, "n"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SHAPES * PLACES, 2 * DIM + 1), np.int64)
        for batch in batches:
            place, sums = place_of(batch.column(0).to_numpy()), _unpacked(batch.column(1))
            units = np.rint(_unit(sums) * UNIT).astype(np.int64)
            np.add.at(total, place, np.column_stack([sums, units, (sums != 0).any(1)]))
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c) for c in total[at].T.copy())], ["place", *names])

    schema = ", ".join(["place int", *(f"{c} long" for c in names)])
    rows = words.select("key", "sums").mapInArrow(gather, schema).groupBy("place").agg(*(F.sum(c).alias(c) for c in names)).collect()  # one for each place
    total = np.zeros((SHAPES * PLACES, 2 * DIM + 1), np.int64)
    for r in rows:
        total[r[0]] = r[1:]
    return total[:, :DIM].astype(float), total[:, DIM:-1].sum(0) / UNIT / max(1, total[:, -1].sum())


def context_sums(docs: DataFrame) -> np.ndarray:
    """Sum, over all words of all documents, of the index vectors of their neighbours: [places, DIM]."""
    return summary(word_sums(docs))[0]


@dataclass
class Words:
    """Vectors of the words of the fitted documents, by sorted key; any other word has its place's vector."""

    keys: np.ndarray
    vectors: np.ndarray
    places: np.ndarray

    def of(self, key: np.ndarray) -> np.ndarray:
        out = self.places[place_of(key)].astype(float)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            out[known] = self.vectors[at[known]]
        return out


def word_vectors(docs: DataFrame) -> Words:
    """Vectors of the words of docs, which must be a bounded sample: they go to the driver. A word that stands there once only has its place's vector."""
    words = word_sums(docs)
    sums, common = summary(words)
    rows = words.filter(F.octet_length("sums") > 4 * REACH).select("key", "sums").collect()
    keys = np.array([r["key"] for r in rows], np.int64).view(flat.U)
    order = np.argsort(keys)
    own = _centred(_unpacked(pa.array([rows[i]["sums"] for i in order], pa.binary())), common)
    return Words(keys[order], own.astype(np.float16), _centred(sums, common).astype(np.float32))


def features(column: pa.Array, words: Words) -> np.ndarray:
    """For each text: mean and spread of the words' vectors, shares of the shapes, how often words repeat, length. All zero without words."""
    parts = [np.zeros((0, 2 * DIM + SHAPES + 2))]
    for rows in flat.blocks(column):
        key, place, first = keyed(column, rows)
        n_docs, sizes = len(first) - 1, np.diff(first)
        doc = np.repeat(np.arange(n_docs), sizes)
        x = np.zeros((n_docs, 2 * DIM + SHAPES + 2))
        if len(key):
            own, local = np.unique(key, return_inverse=True)
            pair, times = np.unique(doc * len(own) + local, return_counts=True)
            of, word = pair // len(own), pair % len(own)
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            to, n = of[begin], sizes[of[begin]][:, None]
            weighed = words.of(own)[word]
            mean = np.add.reduceat(weighed * times[:, None], begin) / n
            x[to, :DIM] = mean
            x[to, DIM : 2 * DIM] = np.sqrt(np.maximum(0, np.add.reduceat(weighed * weighed * times[:, None], begin) / n - mean**2))
            x[:, 2 * DIM : -2] = np.bincount(doc * SHAPES + place // PLACES, minlength=n_docs * SHAPES).reshape(n_docs, SHAPES) / np.maximum(1, sizes)[:, None]
            x[to, -2] = np.diff(begin, append=len(of)) / n[:, 0]
        x[:, -1] = np.log1p(sizes)
        parts.append(x)
    return np.concatenate(parts)


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.maximum(0, x @ w1 + b1)
    return hidden, (hidden @ w2 + b2)[:, 0]


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 600, rate: float = 0.01, batch: int = 1024) -> list[np.ndarray]:
    """Logistic loss, Adam, one hidden layer of rectified units; the same numbers on every run."""
    rng = np.random.default_rng(1)
    layers = [rng.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), (hidden, 1)), np.zeros(1)]

    def grads(p: list[np.ndarray], _: int) -> list[np.ndarray]:
        take = rng.integers(0, len(x), min(batch, len(x)))
        xb, yb = x[take], y[take]
        h, z = _forward(p, xb)
        d = ((sigmoid(z) - yb) / len(take))[:, None]
        dh = (d @ p[2].T) * (h > 0)
        return [xb.T @ dh + 3e-4 * p[0], dh.sum(0), h.T @ d + 3e-4 * p[2], d.sum(0)]

    return adam(layers, grads, steps, rate)


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The factor by which dividing the network's outputs makes the labels of the calibration rows likeliest."""
    if not len(z) or y.min() == y.max():
        return 1.0
    tries = np.exp(np.linspace(math.log(0.2), math.log(10), 200))
    loss = [np.logaddexp(0, -np.where(y == 1, z, -z) / t).mean() for t in tries]
    return float(tries[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8000) -> Model:
    """Word vectors from at most `per_class` labelled documents of each class, the network from those of folds 2 to 4.

    Fold 1 sets the temperature, fold 0 is held out. So the model's size is bounded by the sample, whatever the number of
    documents. Without labels of both classes every score is the share of good ones (0.5 if there is none).
    """
    spark = docs.sparkSession
    sample, _ = write(labelled_sample(docs, labels, "quality", per_class).select("text", "label", "fold"), "quality-sample")
    words = word_vectors(sample)
    shared = spark.sparkContext.broadcast(words)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(features(batch.column(0), shared.value)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, batch.column(1), batch.column(2)], ["x", "label", "fold"])

    rows = sample.mapInArrow(pool, "x array<double>, label int, fold int").collect()  # 2 * per_class vectors at most
    width = 2 * DIM + SHAPES + 2
    x = np.array([r["x"] for r in rows]).reshape(-1, width)
    y, of = np.array([r["label"] for r in rows], float), np.array([r["fold"] for r in rows])
    order = np.lexsort((*x.T[::-1], of, y))  # rows arrive in any order
    x, y, of = x[order], y[order], of[order]
    counts = {r["quality"]: r["n"] for r in labels.filter(F.col("quality").isNotNull() & (fold() != 0)).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    learn = of > 1
    if not learn.any() or y[learn].min() == y[learn].max():
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        z = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(words, np.zeros(width), np.ones(width), [np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.array([z])], 1.0)
    mean, scale = x[learn].mean(0), x[learn].std(0) + 1e-6
    layers = fit_network((x[learn] - mean) / scale, y[learn])
    # The sample has the classes in other shares than the labels; the last bias takes them back.
    layers[3] = layers[3] + math.log(max(1, counts.get(1, 0)) / max(1, counts.get(0, 0))) - math.log(max(1, y[learn].sum()) / max(1, (1 - y[learn]).sum()))
    calibrate = of == 1
    z = _forward(layers, (x[calibrate] - mean) / scale)[1] if calibrate.any() else np.zeros(0)
    return Model(words, mean, scale, layers, fit_temperature(z, y[calibrate]))


def score(docs: DataFrame, model: Model, into: str = "quality_score") -> DataFrame:
    """docs with one more column: the calibrated probability that the document is good. A column of that name is replaced.

    A null or empty text has no words and gets the score of zero vectors. Nothing is shuffled: the model, whose size the
    sample bounds, goes to the tasks. Rows that share a doc_id are scored each on its own.
    """
    bounded(docs.sparkSession)
    docs = docs.drop(into)
    at, names = docs.columns.index("text"), [*docs.columns, into]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = features(batch.column(at), model.words)
            z = _forward(model.layers, (x - model.mean) / model.scale)[1] / model.temperature
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(z))], names)

    return docs.mapInArrow(rate, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
