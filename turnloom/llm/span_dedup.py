"""Substring dedup: hash every run of several consecutive sentences, join globally, remove what a non-first run covers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm import flat
from turnloom.llm.scratch import id_or_null, identified

SENTENCES = 3
MIN_WORDS = 20
#: What a sentence ends behind. Long sentences are cut at their clauses, or a passage that begins or ends inside one would stay.
ENDS = ".!?;:,"
RUNS = "h1 long, h2 long, doc_id long, variant long, first long, size long, settled boolean"
#: Closing quotes and brackets: of one byte, and in UTF-8 the right-hand quotes and guillemets.
_CLOSES = np.zeros(256, bool)
_CLOSES[[0x22, 0x27, 0x29, 0x5D, 0x7D]] = True
_WIDE = ["\u2019".encode(), "\u201d".encode(), "\u203a".encode(), "\u00bb".encode()]


def _last_bytes(t: flat.Texts, w: flat.Words) -> np.ndarray:
    """The place of each word's last byte before its closing quotes and brackets."""
    last, open_ = w.ends - 1, np.arange(len(w.ends))
    while len(open_):
        at, low = last[open_], w.starts[open_]
        step = np.where(_CLOSES[t.data[at]], 1, 0)
        for mark in _WIDE:
            k = len(mark)
            fits = at - k >= low
            for i, b in enumerate(mark):
                fits &= t.data[np.maximum(0, at - k + 1 + i)] == b
            step[fits] = k
        step[at - step < low] = 0
        last[open_] = at - step
        open_ = open_[step > 0]
    return last


def sentence_starts(t: flat.Texts, w: flat.Words, ends: str = ENDS) -> np.ndarray:
    """The words that begin a sentence: the first of a text, one behind a line feed, one behind a word that ends in one of `ends`.

    Quotes and brackets may close behind these signs.
    """
    n, closing = len(w.starts), np.zeros(256, bool)
    closing[list(ends.encode())] = True
    begins = np.zeros(n, bool)
    if n:
        feeds = np.concatenate([[0], np.cumsum(t.data == 0x0A)])
        begins[w.first[:-1][np.diff(w.first) > 0]] = True
        begins[1:] |= closing[t.data[_last_bytes(t, w)[:-1]]] | (feeds[w.starts[1:]] > feeds[w.ends[:-1]])
    return np.flatnonzero(begins)


def runs(t: flat.Texts, sentences: int, min_words: int, ends: str = ENDS, whole: bool = False) -> tuple[np.ndarray, ...]:
    """(text, first sentence, sentences, hash, second hash) of the run that begins at each sentence.

    A run has at least `sentences` sentences and at least `min_words` words. The last one of a text ends with it, and is all of a
    text of `min_words` words in fewer sentences; a text of fewer words has none.
    With `whole` there is the shortest run of `min_words` words from each sentence on and the shortest up to each sentence,
    which together cover every stretch of that many words, and a text of fewer words is one run.
    """
    w = flat.words(t, flat.NOT_SPACE)
    starts = sentence_starts(t, w, ends)
    n_texts = len(t.starts) - 1
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, flat.U),) * 2
    ends = np.append(starts[1:], len(w.starts))  # the words behind each sentence
    text = np.searchsorted(w.first, starts, side="right") - 1
    bound = np.searchsorted(text, np.arange(n_texts + 1))  # a text's sentences are bound[i]:bound[i + 1]
    at = np.arange(len(starts))
    enough = np.searchsorted(ends, starts + min_words)
    if whole:
        back = np.searchsorted(starts, ends - min_words, side="right") - 1
        ok, ok_back = enough < bound[text + 1], back >= bound[text]
        first_word = np.append(starts, len(w.starts))[bound]
        short = np.flatnonzero((np.diff(bound) > 0) & (np.diff(first_word) < min_words))
        pairs = np.concatenate([np.stack([at[ok], enough[ok]]), np.stack([back[ok_back], at[ok_back]]), np.stack([bound[short], bound[short + 1] - 1])], axis=1)
        at, last = np.unique(pairs, axis=1)
    else:
        last = np.maximum(at + sentences - 1, enough)
        ok = last < bound[text + 1]
        long_ = np.flatnonzero(np.diff(np.append(starts, len(w.starts))[bound]) >= min_words)
        final = bound[long_ + 1] - 1
        back = np.minimum(np.searchsorted(starts, ends[final] - min_words, side="right") - 1, final - sentences + 1)
        at, last = np.unique(np.stack([np.append(at[ok], np.maximum(back, bound[long_])), np.append(last[ok], final)]), axis=1)
    # Two hashes of the words and of their sequence, which have nothing to do with each other: 122 bits.
    h1, h2 = (flat.stretch_hashes(flat.word_hashes(t, w, k), starts[at], ends[last], k) for k in (0, 1))
    return text[at], at - bound[text[at]], last - at + 1, h1, h2


def hashed_runs(docs: DataFrame, sentences: int, min_words: int, ends: str = ENDS, whole: bool = False) -> DataFrame:
    """All runs. One that its batch shows to be a repeat is settled there and spread by a hash of its place, so that a hash
    meets once a batch, however often it stands in the corpus."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            parts = []
            for rows in flat.blocks(batch.column(2)):
                owner, *rest = runs(flat.texts(batch.column(2), rows, lower=True), sentences, min_words, ends, whole)
                parts.append((ids[rows][owner], variants[rows][owner], *rest))
            if not parts:
                continue
            doc, variant, first, size, h1, h2 = (np.concatenate([p[i] for p in parts]) for i in range(6))
            order = np.lexsort((first, variant, doc, h2, h1))
            doc, variant, first, size, h1, h2 = doc[order], variant[order], first[order], size[order], h1[order], h2[order]
            same = np.zeros(len(doc), bool)
            same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc)))) if len(doc) else np.zeros(0, np.int64)
            settled = same & ((doc != doc[head]) | (variant != variant[head]) | (first != first[head]))
            salt = flat.mix((doc ^ variant).astype(flat.U) * flat.U(0x9E3779B97F4A7C15) + first.astype(flat.U))
            columns = [flat.signed(np.where(settled, salt, h1)), flat.signed(np.where(settled, salt, h2)), doc, variant, first, size, settled]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in RUNS.split(", ")])

    return docs.mapInArrow(cut, RUNS)


def span_dedup(docs: DataFrame, sentences: int = SENTENCES, min_words: int = MIN_WORDS, ends: str = ENDS, whole: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_sentences, n_removed, text (without the repeated sentences), removed (their places).

    A sentence ends behind one of `ends` at a word's end (quotes and brackets may close behind it), and at a line feed; it takes
    the white space behind it along. `ends` holds the signs between clauses too, so that a passage loses little where it is cut
    off inside a long sentence. A run begins at every sentence: the next `sentences`, and more until it has `min_words`
    words; the last run of a text ends with it. Two runs are equal if their words are, A-Z lower-cased (122 bits of hash). All runs but the first, by doc_id and place, are repeats, and every
    sentence of a repeat goes. Null and empty texts have no sentence; texts of fewer than `min_words` words keep all. A null doc_id
    sorts last and comes back null; rows that share doc_id and text are one document, so one is no repeat of the other, and
    both lose the same sentences; other texts of a doc_id stand behind each other. Other columns are not looked at.

    With `whole`, `sentences` is not looked at: each repeated stretch of whole sentences goes that has `min_words` words
    or more, be it a single sentence, and so does a repeated text of fewer words. What a repeated passage holds of a sentence that is cut off at its edge stays.
    """
    own = identified(docs).select("doc_id", "variant", F.coalesce("text", F.lit("")).alias("text"))
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "variant", "first"))
    repeats = hashed_runs(own, sentences, min_words, ends, whole).withColumn("place", place).filter("settled or place > 1")
    per_doc = repeats.groupBy(F.col("doc_id").alias("_doc"), F.col("variant").alias("_variant")).agg(F.collect_set(F.struct("first", "size")).alias("runs"))
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("variant") == F.col("_variant"))
    joined = own.join(per_doc, same, "left").select(id_or_null(), "text", "runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            repeated = batch.column(2).to_pylist()
            for rows in flat.blocks(batch.column(1)):
                t = flat.texts(batch.column(1), rows, lower=False)
                w = flat.words(t, flat.NOT_SPACE)
                starts = sentence_starts(t, w, ends)
                bound = np.searchsorted(starts, w.first)
                for d in range(len(t.starts) - 1):
                    raw = t.data[t.starts[d] : t.starts[d + 1] - 1]
                    n = int(bound[d + 1] - bound[d])
                    gone = np.zeros(n + 1, np.int64)
                    for r in repeated[rows.start + d] or ():
                        gone[r["first"]] += 1
                        gone[r["first"] + r["size"]] -= 1
                    gone = np.cumsum(gone)[:n] > 0
                    if gone.any():
                        at = np.append(w.starts[starts[bound[d] : bound[d + 1]]] - t.starts[d], len(raw))
                        mask = np.ones(len(raw), bool)
                        for i in np.flatnonzero(gone).tolist():
                            mask[at[i] : at[i + 1]] = False
                        raw = raw[mask]
                    out.append((n, int(gone.sum()), raw.tobytes().decode(), np.flatnonzero(gone).tolist()))
            columns = list(zip(*out)) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_sentences", "n_removed", "text", "removed"])

    return joined.mapInArrow(remove, "doc_id long, n_sentences long, n_removed long, text string, removed array<bigint>")
