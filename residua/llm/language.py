"""Language identification by a linear-chain conditional random field over words.

Each word has features: itself, affixes, character n-grams, and the languages in whose lexicon it stands.
Their learned weights give emission scores, learned transitions tie neighbours together, and
forward-backward gives each word's distribution over languages, so texts that switch languages are
labelled word by word. A document's language is the one with the largest mean probability.

The model is fitted on a bounded sample of runs of words of labelled documents, cut into shorter ones and spliced so that languages
change inside a sequence. Prediction reads every word of every text where it stands, without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, small, worker_slot
from .shingles import M1, M2, mix

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and marks of a lowered text; number signs alone are no word."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


FITTED_CHARS = 150_000
RUN = 5_000
SLOTS = 1 << 16
REMEMBERED = 300_000
LONGEST_REMEMBERED = 64
LEXICON = 2_000
CELLS = 600_000
UNKNOWN = "und"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words one after the other, and how many each has.

    A word is marked at both ends; its features are the n-grams of two and three characters (those with
    a mark are the short affixes), the affixes of three characters, and the word itself.
    """
    flat = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    padded = np.concatenate([flat, np.zeros(3, np.uint64)])
    slots, owners = [], []
    gram = mix(flat)
    for n in (2, 3, 4):
        gram = mix(gram * M1 + padded[n - 1 : n - 1 + len(flat)])
        if n < 4:
            inside = np.arange(len(flat)) + n <= ends[owner]
            slots.append(gram[inside])
            owners.append(owner[inside])
        else:
            long = np.flatnonzero(sizes >= 4)
            slots += [gram[starts[long]] + np.uint64(1), gram[ends[long] - 4] + np.uint64(2)]
            owners += [long, long]
    place = (np.arange(len(flat)) - starts[owner]).astype(np.uint64)
    slots.append(np.add.reduceat(mix(flat * M2 + place), starts))
    owners.append(np.arange(len(words)))
    every = np.concatenate(owners)
    order = np.argsort(every, kind="stable")
    return (mix(np.concatenate(slots)[order]) % np.uint64(SLOTS)).astype(np.int64), np.bincount(every, minlength=len(words))


class Field:
    """The fitted chain. ``weights`` has a row per feature slot and language, ``lexicon`` maps a word to the number, from 1, of the language that has most of it."""

    def __init__(self, languages: list[str], weights: np.ndarray, lexicon: dict[str, int], in_lexicon: np.ndarray, transitions: np.ndarray, start: np.ndarray):
        self.languages, self.weights, self.lexicon, self.in_lexicon = languages, weights, lexicon, in_lexicon
        self.transitions, self.start = transitions, start

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, sizes = features(words)
        scores = np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]
        known = np.array([self.lexicon.get(w, 0) for w in words], np.int64)
        scores += np.concatenate([np.zeros_like(self.in_lexicon[:1]), self.in_lexicon])[known]
        return scores.astype(np.float32)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posteriors of sequences in descending order of length; ``scores`` is (time, sequence, language).

    With ``pairs`` also the expected number of each transition and of each first label.
    """
    t_max, _, k = scores.shape
    heat = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max()).astype(heat.dtype)
    live = np.searchsorted(-lengths, -np.arange(1, t_max + 1), side="right")  # sequences that reach step t
    ahead = np.empty_like(heat)
    first = heat[0] * np.exp(start - start.max()).astype(heat.dtype)
    ahead[0] = first / first.sum(axis=1, keepdims=True)
    for t in range(1, t_max):
        n = live[t]
        x = (ahead[t - 1, :n] @ move) * heat[t, :n]
        ahead[t, :n] = x / x.sum(axis=1, keepdims=True)
    back = np.ones_like(heat[0])
    counts = np.zeros((k, k))
    for t in range(t_max - 1, 0, -1):
        n = live[t]
        later = heat[t, :n] * back[:n]
        if pairs:
            joint = ahead[t - 1, :n, :, None] * move[None] * later[:, None, :]
            counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        posterior = ahead[t, :n] * back[:n]
        b = later @ move.T
        back[:n] = b / b.sum(axis=1, keepdims=True)
        ahead[t, :n] = posterior / posterior.sum(axis=1, keepdims=True)
    posterior = ahead[0] * back
    ahead[0] = posterior / posterior.sum(axis=1, keepdims=True)
    return ahead, live, counts


def fit(texts: list[str], labels: list[str], rounds: int = 40, seed: int = 5) -> Field | None:
    """Maximum conditional likelihood by Adam on spliced sequences; None without labelled words."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    runs = []
    for text, label in zip(texts, labels, strict=True):
        words = words_of(text)
        at = 0
        while at < len(words):
            n = int(rng.integers(5, 40))
            runs.append((words[at : at + n], languages.index(label)))
            at += n
    if not runs:
        return None
    vocabulary = Counter(w for words, _ in runs for w in words)
    names = list(vocabulary)
    number = {w: i for i, w in enumerate(names)}
    by_language = [Counter() for _ in languages]
    for words, k in runs:
        by_language[k].update(words)
    lexicon: dict[str, int] = {}
    for k, counter in enumerate(by_language):
        for w, n in sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if 2 * n > vocabulary[w]:
                lexicon[w] = k + 1

    order = rng.permutation(len(runs))
    sequences: list[tuple[list[int], list[int]]] = []
    at = 0
    while at < len(order):
        take = int(rng.integers(1, 4))
        words, tags = [], []
        for i in order[at : at + take]:
            words += [number[w] for w in runs[i][0]]
            tags += [runs[i][1]] * len(runs[i][0])
        sequences.append((words, tags))
        at += take
    sequences.sort(key=lambda s: -len(s[0]))
    lengths = np.array([len(s[0]) for s in sequences])
    word_at, tag_at = np.zeros((lengths[0], len(sequences)), np.int64), np.zeros((lengths[0], len(sequences)), np.int64)
    real = np.zeros(word_at.shape, bool)
    for j, (words, tags) in enumerate(sequences):
        word_at[: len(words), j], tag_at[: len(words), j], real[: len(words), j] = words, tags, True
    k = len(languages)
    seen_words, seen_tags = word_at[real], tag_at[real]
    gold = np.bincount(seen_words * k + seen_tags, minlength=len(names) * k).reshape(-1, k)
    switch = np.zeros((k, k))
    both = real[1:] & real[:-1]
    np.add.at(switch, (tag_at[:-1][both], tag_at[1:][both]), 1)
    starts = np.bincount(tag_at[0], minlength=k)

    flat, sizes = features(names)
    owner = np.repeat(np.arange(len(names)), sizes)
    known = np.array([lexicon.get(w, 0) for w in names])
    flags = (known[:, None] == np.arange(1, k + 1)).astype(float)
    model = Field(languages, np.zeros((SLOTS, k)), lexicon, np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    parts = [model.weights, model.in_lexicon, model.transitions, model.start]
    momenta, speeds, total = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], len(seen_words)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for step in range(1, rounds + 1):
        emission = np.add.reduceat(model.weights[flat], offsets, axis=0) / sizes[:, None] + flags @ model.in_lexicon
        posterior, _, moved = forward_backward(emission[word_at], lengths, model.transitions, model.start, pairs=True)
        expected = np.stack([np.bincount(seen_words, posterior[:, :, j][real], minlength=len(names)) for j in range(k)], axis=1)
        by_word = (gold - expected) / total
        per_feature = (by_word / sizes[:, None])[owner]
        slopes = [
            np.stack([np.bincount(flat, per_feature[:, j], minlength=SLOTS) for j in range(k)], axis=1) - 1e-7 * model.weights,
            flags.T @ by_word - 1e-5 * model.in_lexicon,
            (switch - moved) / total - 1e-4 * model.transitions,
            (starts - posterior[0].sum(axis=0)) / total - 1e-4 * model.start,
        ]
        for p, g, m, s in zip(parts, slopes, momenta, speeds, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    model.weights = model.weights.astype(np.float32)
    return model


class Tagger:
    """A field with the emission scores of the words it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(field.languages)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        place = self.place
        if not words:
            return self.table[:0]
        rows = list(map(place.get, words))
        if None in rows:
            new = list({w for w, r in zip(words, rows, strict=True) if r is None})
            if len(place) + len(new) > REMEMBERED:
                place.clear()
                new = list(set(words))
            need = len(place) + len(new)
            if need > len(self.table):
                table = np.zeros((2 * need, self.table.shape[1]), np.float32)
                table[: len(place)] = self.table[: len(place)]
                self.table = table
            for at in range(0, len(new), 50_000):
                part = new[at : at + 50_000]
                self.table[len(place) : len(place) + len(part)] = self.field.emissions(part)
                place.update(zip(part, range(len(place), len(place) + len(part)), strict=True))
            rows = list(map(place.get, words))
        return self.table[rows]

    def posteriors(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, a row for each word."""
        out: list = [None] * len(texts)
        scores: list[np.ndarray] = []
        for at in range(0, len(texts), 250):
            words = [words_of(text) for text in texts[at : at + 250]]
            flat = self.scores(list(chain.from_iterable(words)))
            scores += np.split(flat, np.cumsum([len(w) for w in words])[:-1])
        lengths = np.array([len(s) for s in scores])
        order = [i for i in np.argsort(-lengths, kind="stable") if lengths[i]]
        at = 0
        while at < len(order):
            longest = lengths[order[at]]
            batch = order[at : at + max(1, CELLS // longest)]
            at += len(batch)
            padded = np.zeros((longest, len(batch), self.table.shape[1]), np.float32)
            for j, i in enumerate(batch):
                padded[: lengths[i], j] = scores[i]
            found, _, _ = forward_backward(padded, lengths[batch], self.field.transitions.astype(np.float32), self.field.start.astype(np.float32))
            for j, i in enumerate(batch):
                out[i] = found[: lengths[i], j]
        return [np.zeros((0, self.table.shape[1]), np.float32) if p is None else p for p in out]


def tagger_of(sent) -> Tagger | None:
    """The worker's tagger of a broadcast model; a worker serves many tasks."""
    return worker_slot(("language", sent.id), lambda: None if sent.value is None else Tagger(sent.value))


class Sent:
    """A broadcast with a name that outlives the task."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from; a null id is not held out (and not learned from either)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _runs(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """``lang``, ``h``, ``run``: labelled texts that are not held out, cut at white space into runs of at most ``RUN`` characters."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null and id is not null").filter(~held_out("id"))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{RUN}}}(?!\S)|.{{1,{RUN}}}"), F.lit(0))
    runs = rows.select("id", "lang", F.posexplode(F.when(F.char_length("text") <= RUN, F.array("text")).otherwise(pieces)).alias("i", "run"))
    return runs.select("lang", F.xxhash64("id", "i", "run").alias("h"), "run")


def fitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fitted_chars: int = FITTED_CHARS) -> Field | None:
    """Fit on runs of words of each language, none of a held-out document: those with the smallest hashes of id, place and run.

    Of every language at least one run is learned from, and no more than ``fitted_chars`` characters or that one run. Repeated rows count once.
    """
    runs = _runs(docs, doc_id, text, lang)
    sizes = checkpointed(runs.groupBy("lang", "h").agg(F.max(F.char_length("run") + 1).alias("n")))
    bucket = F.shiftright("h", 48)
    by = Window.partitionBy("lang").orderBy("bucket")
    filled = sizes.groupBy("lang", bucket.alias("bucket")).agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(by) - F.col("n"))
    edges = filled.filter(F.col("before") < fitted_chars).groupBy(F.col("lang").alias("of")).agg(F.max("bucket").alias("edge"))
    near = sizes.join(F.broadcast(edges), (F.col("lang") == F.col("of")) & (bucket <= F.col("edge")))
    by = Window.partitionBy("lang").orderBy("h")
    chosen = near.withColumn("upto", F.sum("n").over(by)).withColumn("place", F.row_number().over(by)).filter((F.col("upto") <= fitted_chars) | (F.col("place") == 1))
    chosen = checkpointed(chosen.select("lang", "h"))
    n = chosen.count()
    if not n:
        return None
    found = runs.join(small(chosen, n), ["lang", "h"]).groupBy("lang", "h").agg(F.min("run").alias("run")).collect()
    found = sorted((r["h"], r["lang"], r["run"]) for r in found)
    return fit([r[2] for r in found], [r[1] for r in found])


def predicted(docs: DataFrame, field: Field | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``: the language with the largest mean probability, and that mean.

    Only the text decides. A null text, one without a letter, or any text when nothing could be
    learned gives ``und`` with score 0. Every row gets a row.
    """
    sent = _sent(docs, field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = tagger_of(sent)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                texts = [t or "" for t in part.column(2).to_pylist()]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                for i, p in enumerate(tagger.posteriors(texts) if tagger else []):
                    if len(p):
                        mean = p.mean(axis=0, dtype=np.float64)
                        names[i], scores[i] = tagger.field.languages[int(mean.argmax())], min(1.0, float(mean.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def filtered(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language, in all their columns and where they stand: no shuffle.

    Null texts and texts without a letter go; where nothing could be learned the letters alone decide. Only
    the text is sent to the tagger.
    """
    if field is None:
        return docs.filter(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    sent = _sent(docs, field)

    @F.pandas_udf("string")
    def predict(texts: pd.Series) -> pd.Series:
        tagger = tagger_of(sent)
        plain = [t or "" for t in texts]
        found = [p for at in range(0, len(plain), 2000) for p in tagger.posteriors(plain[at : at + 2000])]
        return pd.Series([tagger.field.languages[int(p.mean(axis=0).argmax())] if len(p) else UNKNOWN for p in found])

    return docs.filter(predict(F.col(text)) != UNKNOWN)


def labelled_words(docs: DataFrame, field: Field | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``words`` and their ``labels``, for texts that switch languages."""
    sent = _sent(docs, field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = tagger_of(sent)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words = [words_of(t) for t in texts]
            labels = [[tagger.field.languages[j] for j in p.argmax(axis=1)] for p in tagger.posteriors(texts)] if tagger else [[UNKNOWN] * len(w) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string()))], ["doc_id", "words", "labels"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, words array<string>, labels array<string>")


def _sent(docs: DataFrame, field: Field | None) -> Sent:
    context = docs.sparkSession.sparkContext
    return Sent(context.broadcast(field), f"{context.applicationId}-{uuid.uuid4().hex}")
