"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give document scores and spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from turnloom.llm import flat
from turnloom.llm.scratch import bounded, write
from turnloom.llm.supervised import adam, held_out, labelled_sample, logistic, sigmoid

#: Tokens on either side of a marked word that stand in its training sequence.
REACH = 4
_SPAN = pa.struct([("first_char", pa.int64()), ("end_char", pa.int64()), ("probability", pa.float64())])
_SCORED = pa.struct([("score", pa.float64()), ("n_tokens", pa.int64()), ("toxic_tokens", pa.float64()), ("spans", pa.list_(_SPAN))])
SCORED = from_arrow_type(_SCORED)


@dataclass
class Model:
    """States: 0 clean, 1 toxic. A token's feature is its place in `words` (sorted hashes), or the last one if it has none."""

    words: np.ndarray
    emission: np.ndarray
    #: Log potentials of going from a state to a state, and of the first state.
    change: np.ndarray
    first: np.ndarray
    #: Logistic regression from the marginals' summary to the document's score.
    document: np.ndarray


def _tokens(column: pa.Array, rows: slice) -> tuple[flat.Texts, flat.Words, np.ndarray]:
    t = flat.texts(column, rows, lower=True)
    w = flat.words(t, flat.ALNUM)
    return t, w, flat.word_hashes(t, w)


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, in_toxic, in_clean): documents of either class that hold a word, by the word's hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for rows in flat.blocks(batch.column(0)):
                _, w, h = _tokens(batch.column(0), rows)
                doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, toxic = h[fresh], label[rows][doc[fresh]]
                word, at = np.unique(h, return_inverse=True)
                n1 = np.bincount(at, toxic, len(word)).astype(np.int64)
                n = np.bincount(at, minlength=len(word))
                yield pa.RecordBatch.from_arrays([pa.array(flat.signed(word)), pa.array(n1), pa.array(n - n1)], ["word", "in_toxic", "in_clean"])

    found = sample.select("text", "label").mapInArrow(count, "word long, in_toxic long, in_clean long")
    return found.groupBy("word").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_clean").alias("in_clean"))


def lexicon(sample: DataFrame) -> np.ndarray:
    """Hashes of the words that mark toxic documents: at least 3 of them, over 6 times as often as in clean ones, and
    beyond chance by a likelihood ratio of 15. All of them: the sample bounds their number."""
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, flat.U)
    a, b = F.col("in_toxic").cast("double"), F.col("in_clean").cast("double")
    share = (a + b) / (n1 + n0)
    surprise = 2 * (a * F.log(a / (n1 * share)) + F.when(b > 0, b * F.log(b / (n0 * share))).otherwise(0.0))
    marked = word_counts(sample).filter((a >= 3) & (a / n1 > 6 * (b + 0.5) / n0)).withColumn("surprise", surprise).filter("surprise > 15")
    rows = marked.select("word").collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(flat.U))


def _features(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, len(vocabulary))


def training_sequences(sample: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token features and labels, one window of 2 * REACH + 1 tokens a row (-1 beyond a text's ends), and how often it stands.

    Windows stand around marked words, and around every 200th token. A token is labelled toxic if it is marked and its
    document is toxic. Windows look alike wherever the same marked words stand among unmarked ones, so they are counted, and
    only different ones go to the driver. The sample bounds their number.
    """
    width = 2 * REACH + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for rows in flat.blocks(batch.column(0)):
                _, w, h = _tokens(batch.column(0), rows)
                f = _features(h, vocabulary)
                doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
                centre = np.flatnonzero((f < len(vocabulary)) | (np.arange(len(f)) % 200 == 0))
                at = centre[:, None] + np.arange(-REACH, REACH + 1)
                inside = (at >= w.first[doc[centre]][:, None]) & (at < w.first[doc[centre] + 1][:, None])
                x = np.where(inside, f[np.clip(at, 0, max(0, len(f) - 1))], -1) if len(f) else np.zeros((0, width), np.int64)
                y = (x >= 0) & (x < len(vocabulary)) & (label[rows][doc[centre]] == 1)[:, None]
                windows, n = np.unique(np.concatenate([x, y], axis=1).astype("<i4"), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in windows], pa.binary()), pa.array(n.astype(np.int64))], ["window", "n"])

    found = sample.select("text", "label").mapInArrow(cut, "window binary, n long").groupBy("window").agg(F.sum("n").alias("n"))
    rows = found.orderBy("window").collect()
    both = np.frombuffer(b"".join(r["window"] for r in rows), "<i4").astype(np.int64).reshape(-1, 2 * width)
    return both[:, :width], both[:, width:], np.array([r["n"] for r in rows], float)


def _marginals(score: np.ndarray, change: np.ndarray, first: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over rows of equal width. score: [rows, width, 2]; tokens that aren't `there` pass states on.

    Returns the marginals of the states, and for each row the sum over places of the marginals of state pairs.
    """
    n, width, _ = score.shape
    lse = lambda z, axis: np.logaddexp.reduce(z, axis=axis)
    ahead, back = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    started = there[:, 0]
    ahead[:, 0] = np.where(started[:, None], first + score[:, 0], 0)
    for t in range(1, width):
        moved = lse(ahead[:, t - 1, :, None] + change, 1) + score[:, t]
        begun = np.where(started[:, None], moved, first + score[:, t])
        ahead[:, t] = np.where(there[:, t, None], begun, ahead[:, t - 1])
        started = started | there[:, t]
    for t in range(width - 2, -1, -1):
        moved = lse(change + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(there[:, t + 1, None] & there[:, t, None], moved, back[:, t + 1])
    state = ahead + back
    state = np.exp(state - lse(state, 2)[..., None]) * there[..., None]
    pair = ahead[:, :-1, :, None] + change + (score[:, 1:] + back[:, 1:])[:, :, None, :]
    pair = np.exp(pair - lse(lse(pair, 3), 2)[..., None, None]) * (there[:, :-1] & there[:, 1:])[..., None, None]
    return state, pair.sum(1)


def fit_chain(x: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, steps: int = 150) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximise the likelihood of the labels; `size` words and one feature for all other tokens."""
    there = x >= 0
    f = np.where(there, x, size)
    begin = there & ~np.pad(there, ((0, 0), (1, 0)))[:, :-1]
    each = np.broadcast_to(weight[:, None], x.shape)
    seen_pairs = np.zeros((2, 2))
    follow = there[:, :-1] & there[:, 1:]
    np.add.at(seen_pairs, (y[:, :-1][follow], y[:, 1:][follow]), each[:, 1:][follow])
    seen_first = np.array([each[begin & (y == s)].sum() for s in (0, 1)])
    hit = there & (y == 1)
    seen_words = np.bincount(f[hit], each[hit], size + 1)
    n = max(1.0, weight.sum())

    def grads(params: list[np.ndarray], _: int) -> list[np.ndarray]:
        emission, change, first = params
        score = np.stack([np.zeros(f.shape), emission[f]], -1) * there[..., None]
        state, pairs = _marginals(score, change, first, there)
        words = np.bincount(f[there], (state[..., 1] * each)[there], size + 1)
        firsts = (state * each[..., None])[begin].sum(0)
        pairs = (pairs * weight[:, None, None]).sum(0)
        return [(words - seen_words) / n + 1e-4 * emission, (pairs - seen_pairs) / n + 1e-3 * change, (firsts - seen_first) / n + 1e-3 * first]

    emission, change, first = adam([np.zeros(size + 1), np.zeros((2, 2)), np.zeros(2)], grads, steps, 0.15)
    return emission, change, first


class Tagger:
    """Exact marginals of whole texts. Unmarked tokens share one potential, so a run of them is a power of one matrix."""

    def __init__(self, model: Model):
        self.model, size = model, len(model.words)
        step = np.exp(model.change - model.change.max())
        plain = step * np.exp([0, model.emission[size]])[None, :]
        plain /= plain.max()
        self.powers = [np.eye(2)]
        while len(self.powers) < 4096:  # beyond that, or once rows are alike, further factors change nothing
            nxt = self.powers[-1] @ plain
            self.powers.append(nxt / nxt.max())
            if abs(np.linalg.det(self.powers[-1])) < 1e-17:
                break
        self.powers = np.array(self.powers)
        self.step = step
        self.tokens = np.exp(np.stack([np.zeros(size + 1), model.emission], 1) - np.maximum(0, model.emission)[:, None])
        self.first = np.exp(model.first - model.first.max())

    def marked(self, at: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        """Toxic marginals of the marked tokens, which stand at `at` and have the features f, of a text of n tokens."""
        gaps = np.minimum(np.diff(at, prepend=-1, append=n) - 1, len(self.powers) - 1)
        last, size = len(at), len(self.model.words)
        ahead, back = np.zeros((last, 2)), np.ones((last, 2))
        for k in range(last):
            if k:
                v = ahead[k - 1] @ self.powers[gaps[k]] @ self.step
            elif at[0]:
                v = (self.first * self.tokens[size]) @ self.powers[min(at[0] - 1, len(self.powers) - 1)] @ self.step
            else:
                v = self.first
            v = v * self.tokens[f[k]]
            ahead[k] = v / v.sum()
        back[-1] = self.powers[gaps[-1]] @ np.ones(2)
        for k in range(last - 2, -1, -1):
            v = self.powers[gaps[k + 1]] @ self.step @ (self.tokens[f[k + 1]] * back[k + 1])
            back[k] = v / v.sum()
        p = ahead * back
        return p[:, 1] / p.sum(1)


def _summary(p: np.ndarray, n: int) -> list[float]:
    """What the document score sees: the chance that any token is toxic, how many are, and their share."""
    any_toxic = 1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-6)).sum())
    return [any_toxic, np.log1p(p.sum()), p.sum() / max(1, n), np.log1p(p.sum() / max(1, n) * 100)]


def _tagged(column: pa.Array, tagger: Tagger) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray]]:
    """For every text: number of tokens, (first_char, end_char, probability) of marked tokens, their marginals."""
    vocabulary = tagger.model.words
    for rows in flat.blocks(column):
        t, w, h = _tokens(column, rows)
        f = _features(h, vocabulary)
        hit = np.flatnonzero(f < len(vocabulary))
        bounds = np.searchsorted(hit, w.first)
        for d in range(len(w.first) - 1):
            n, mine = int(w.first[d + 1] - w.first[d]), hit[bounds[d] : bounds[d + 1]]
            if not len(mine):
                yield n, [], np.zeros(0)
                continue
            p = tagger.marked(mine - w.first[d], f[mine], n)
            begin = t.starts[d]
            chars = np.concatenate([[0], np.cumsum((t.data[begin : t.starts[d + 1]] & 0xC0) != 0x80)])
            yield n, list(zip(chars[w.starts[mine] - begin].tolist(), chars[w.ends[mine] - begin].tolist(), p.tolist())), p


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8000) -> Model:
    """Learn from at most `per_class` toxic and as many clean labelled documents, none of fold 0.

    Labels are given per document, so a token counts as labelled toxic where a word that marks toxic documents stands in
    one. Without documents of both classes there is no model of words, and every score is the share of toxic ones (0
    if there are none).
    """
    sample, _ = write(labelled_sample(docs, labels, "toxic", per_class), "toxicity-sample")
    vocabulary = lexicon(sample)
    if not len(vocabulary):
        n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
        share = n.get(1, 0) / max(1, sum(n.values()))
        bias = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(vocabulary, np.zeros(1), np.zeros((2, 2)), np.zeros(2), np.array([0, 0, 0, 0, bias]))
    emission, change, first = fit_chain(*training_sequences(sample, vocabulary), len(vocabulary))
    model = Model(vocabulary, emission, change, first, np.zeros(5))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            rows = [_summary(p, n) for n, _, p in _tagged(batch.column(0), tagger)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    rows = sample.select("text", "label").mapInArrow(summarise, "x array<double>, label int").collect()  # 2 * per_class at most
    known = {r["label"]: r["n"] for r in _class_sizes(labels)}
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    model.document = logistic(x, y)
    # The sample holds the classes in other shares than the labels do; the bias takes them back.
    odds = lambda a, b: np.log(max(a, 1) / max(b, 1))
    model.document[-1] += odds(known.get(1, 0), known.get(0, 0)) - odds(y.sum(), len(y) - y.sum())
    return model


def _class_sizes(labels: DataFrame) -> list:
    return labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("toxic").alias("label")).agg(F.count("*").alias("n")).collect()


def score(docs: DataFrame, model: Model, into: str = "toxicity", least: float = 0.5) -> DataFrame:
    """docs with one more column: score, number of tokens, expected toxic tokens, and the spans of at least `least`.

    Offsets are code points of the text. A null or empty text has no tokens and gets the score of a text without marked
    words. Nothing is shuffled; rows that share a doc_id are scored each on its own.
    """
    bounded(docs.sparkSession)
    at, names = docs.columns.index("text"), [*docs.columns, into]

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            out = []
            for n, spans, p in _tagged(batch.column(at), tagger):
                z = float(sigmoid(np.dot(model.document, [*_summary(p, n), 1.0])))
                offending = [{"first_char": a, "end_char": b, "probability": q} for a, b, q in spans if q >= least]
                out.append({"score": z, "n_tokens": n, "toxic_tokens": float(p.sum()), "spans": offending})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _SCORED)], names)

    return docs.mapInArrow(tag, T.StructType([*docs.schema.fields, T.StructField(into, SCORED)]))
