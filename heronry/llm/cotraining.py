"""Quality scores by co-training a classifier of texts and one of page metadata.

Each view has a logistic model. Over some rounds both score all unlabelled documents, and each hands confident labels
to the other view's training rows. Scores are calibrated on labelled rows kept apart, and a second small model on the
same rows combines the two views. Documents are scored in tasks; models are fitted on the driver, on bounded samples
of labelled and pseudo-labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm import textvec
from heronry.llm.common import materialise, require_free, slice_ends, trim

#: Bounds of the rows that models are fitted on: labelled rows over both classes, and pseudo-labelled rows that a view
#: hands to the other in a round, over both classes.
MAX_LABELLED, MAX_PASSED = 3000, 600
ROUNDS = 3
#: Calibrated confidence from which a pseudo-label may be passed on, and the weight of such a row.
CONFIDENT, PSEUDO = 0.95, 0.5
#: Share of labelled rows kept apart for calibration.
APART = 0.25
THRESHOLD = 0.5
#: Bytes of text that are described at once.
SLICE = 1 << 18

#: Classes of bytes whose trigrams describe a text's shape.
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".;:", ",", "!?", "|/\\_=+~^", "#*$%&<>@", "'\"()[]{}-`")
_KIND = np.full(256, len(_KINDS), np.int32)
for _i, _chars in enumerate(_KINDS):
    _KIND[list(_chars.encode())] = _i
_SHAPES = (len(_KINDS) + 1) ** 3
_WORDS = 1024
_STATS = 8
TEXT_DIM = _SHAPES + _WORDS + _STATS
_SOURCES, _LANGS, _SIZES = 128, 32, 16
#: Least spread by which features are scaled: shares of rare trigrams and words stay small.
_FLOOR = np.concatenate([np.full(_SHAPES, 0.02), np.full(_WORDS, 0.05), np.full(_STATS, 0.02)]).astype(np.float32)
META_DIM = _SOURCES + _LANGS + _SIZES + 3

RESULT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("text", "meta", "quality")])


@dataclass
class TextParts:
    """What describes each text of a slice: shape trigrams and hashed words with their texts, and statistics."""

    n: int
    shape: np.ndarray
    shape_doc: np.ndarray
    word: np.ndarray
    word_doc: np.ndarray
    stats: np.ndarray

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Products of all texts' features with the weights."""
        out = self.stats @ weights[_SHAPES + _WORDS :]
        for at, doc, w in ((self.shape, self.shape_doc, weights[:_SHAPES]), (self.word, self.word_doc, weights[_SHAPES : _SHAPES + _WORDS])):
            out += np.bincount(doc, w[at], self.n) / np.maximum(1, np.bincount(doc, minlength=self.n))
        return out

    def matrix(self) -> np.ndarray:
        parts = []
        for at, doc, size in ((self.shape, self.shape_doc, _SHAPES), (self.word, self.word_doc, _WORDS)):
            counts = np.bincount(doc.astype(np.int64) * size + at, minlength=self.n * size).reshape(self.n, size)
            parts.append(counts / np.maximum(1, counts.sum(1, keepdims=True)))
        return np.concatenate([*parts, self.stats], axis=1)


def describe(raw: np.ndarray, offsets: np.ndarray) -> TextParts:
    n = len(offsets) - 1
    base = len(_KINDS) + 1
    kind = _KIND[raw]
    doc_of = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    inside = doc_of[2:] == doc_of[:-2] if len(raw) > 2 else np.zeros(0, bool)
    shape = ((kind[:-2] * base + kind[1:-1]) * base + kind[2:])[inside] if len(raw) > 2 else np.zeros(0, np.int64)
    starts, ends, doc = textvec.words(raw, offsets)
    h = textvec.word_hashes(textvec.ascii_lower(raw), starts, ends)
    count = np.bincount(doc, minlength=n)
    some = np.maximum(1, count)
    keys = np.sort(h ^ textvec.mix(doc + 1))
    # distinct words by text: a key's first occurrence, found through the sorted keys' texts
    order = np.argsort(h ^ textvec.mix(doc + 1), kind="stable")
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount(doc[order][first], minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    wide = ends - starts > 1
    last = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    doubled = wide & (last == raw[np.maximum(ends - 2, 0)]) & (_KIND[last] >= 5) & (_KIND[last] < len(_KINDS)) if len(ends) else wide
    by_kind = lambda *k: np.bincount(doc_of[np.isin(kind, k)], minlength=n) / np.maximum(1, np.diff(offsets))
    of_words = lambda which: np.bincount(doc[which], minlength=n) / some
    stats = np.stack([np.log1p(count) / 5, distinct / some, of_words(again), by_kind(1) * 4, by_kind(8, 9) * 10, of_words(doubled), np.bincount(doc, ends - starts, n) / some / 8, by_kind(2) * 4], axis=1)
    return TextParts(n, shape, doc_of[2:][inside] if len(raw) > 2 else shape, (h >> np.uint64(54)).astype(np.int64), doc, stats)


def metadata(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Rows of page metadata: hashed source and language, and the binary order of the length; null is a value."""
    out = np.zeros((len(lang), META_DIM))
    code = lambda values, size: [int(x) for x in pd.util.hash_array(np.array([str(v) for v in values], object)) % np.uint64(size)] if values else []
    rows = np.arange(len(lang))
    out[rows, code(source, _SOURCES)] = 1
    out[rows, _SOURCES + np.array(code(lang, _LANGS), np.int64)] = 1
    size = np.array([-1 if v is None else min(_SIZES - 1, int(max(0, v)).bit_length()) for v in n_chars], np.int64)
    out[rows[size >= 0], _SOURCES + _LANGS + size[size >= 0]] = 1
    for j, values in enumerate((lang, source, n_chars)):
        out[[i for i, v in enumerate(values) if v is None], META_DIM - 3 + j] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, sample: np.ndarray, steps: int, start: np.ndarray | None = None, penalty: float = 3e-3) -> np.ndarray:
    """Weights, the last one the constant, of a penalised logistic model: steps of accelerated gradient descent."""
    w = np.zeros(x.shape[1] + 1, np.float32) if start is None else start.copy()
    ahead, before = w.copy(), w.copy()
    share = (sample / sample.sum()).astype(np.float32)
    rate = np.float32(4 / max(1.0, float((share @ (x * x).sum(1))) + 1))
    for t in range(steps):
        error = share * (_sigmoid(x @ ahead[:-1] + ahead[-1]) - y).astype(np.float32)
        grad = np.append(x.T @ error, error.sum())
        grad[:-1] += penalty * ahead[:-1]
        w = ahead - rate * grad
        ahead = w + np.float32(t / (t + 3)) * (w - before)
        before = w
    return w


@dataclass
class View:
    """A linear score and its calibration: log-odds = slope * score + offset."""

    weights: np.ndarray
    constant: float
    slope: float = 1.0
    offset: float = 0.0

    def odds(self, scores: np.ndarray) -> np.ndarray:
        return self.slope * (scores + self.constant) + self.offset


@dataclass
class Model:
    text: View
    meta: View
    mix: np.ndarray
    history: list[tuple[int, int]]

    def combine(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return _sigmoid(np.stack([text, meta], axis=1) @ self.mix[:2] + self.mix[2])


def _view(x: np.ndarray, y: np.ndarray, weight: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, held_weight: np.ndarray, floor: np.ndarray, steps: int, start: tuple | None) -> tuple[View, tuple]:
    """Fit on standardised features, calibrate on the rows kept apart, and fold the scaling into the weights."""
    mean, spread = (x.mean(0), np.maximum(x.std(0), floor)) if start is None else start[:2]
    w = _logistic(((x - mean) / spread).astype(np.float32), y, weight, steps, None if start is None else start[2])
    raw = w[:-1] / spread
    view = View(raw, float(w[-1] - raw @ mean))
    scores = (held_x @ raw + view.constant)[:, None].astype(np.float32)
    view.slope, view.offset = map(float, _logistic(scores / 4, held_y, held_weight, 200, penalty=1e-3))
    view.slope = max(view.slope / 4, 1e-3)
    return view, (mean, spread, w)


class Trainer:
    """Training rows of both views and their models. Labelled rows: y is 0 or 1; prior is the share of 1 among all
    labels, which calibration restores, as both classes give like numbers of rows."""

    def __init__(self, x_text: np.ndarray, x_meta: np.ndarray, y: np.ndarray, prior: float) -> None:
        apart = np.arange(len(y)) % round(1 / APART) == 0
        if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
            apart = np.zeros(len(y), bool)
        self.held = apart if apart.any() else np.ones(len(y), bool)
        self.y = y
        share = y[self.held].mean()
        self.fair = np.where(y[self.held] > 0.5, prior / share, (1 - prior) / (1 - share))
        self.whole = (x_text, x_meta)
        self.sets = [[x[~apart], y[~apart].astype(np.float32), np.ones((~apart).sum())] for x in self.whole]
        self.starts: list[tuple | None] = [None, None]
        self.views: list[View | None] = [None, None]
        self.history: list[tuple[int, int]] = []

    def refit(self) -> None:
        floors = (_FLOOR, np.full(META_DIM, 0.05, np.float32))
        for v in (0, 1):
            x, y, weight = self.sets[v]
            ones = (y > 0.5).mean()
            balance = np.where(y > 0.5, 0.5 / max(1e-9, ones), 0.5 / max(1e-9, 1 - ones))
            steps = 80 if self.starts[v] is None else 30
            self.views[v], self.starts[v] = _view(x, y, weight * balance, self.whole[v][self.held], self.y[self.held], self.fair, floors[v], steps, self.starts[v])

    def learn(self, view: int, x: np.ndarray, y: np.ndarray) -> None:
        """Take in rows that the other view has labelled."""
        old = self.sets[view]
        self.sets[view] = [np.concatenate([old[0], x]), np.append(old[1], y.astype(np.float32)), np.append(old[2], np.full(len(y), PSEUDO))]

    def model(self) -> Model:
        odds = np.stack([self.views[v].odds(self.whole[v][self.held] @ self.views[v].weights) for v in (0, 1)], axis=1)
        mix = _logistic(np.clip(odds, -12, 12).astype(np.float32) / 4, self.y[self.held], self.fair, 300, penalty=1e-3)
        return Model(self.views[0], self.views[1], np.array([mix[0] / 4, max(0.0, mix[1] / 4), mix[2]]), self.history)


def _features(text: Column) -> Column:
    @F.arrow_udf(T.BinaryType())
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out, begin = [], 0
            for end in slice_ends(column, 1 << 18):
                if end > begin:
                    out += [row.astype(np.float16).tobytes() for row in describe(*textvec.column_bytes(column.slice(begin, end - begin))).matrix()]
                begin = end
            trim()
            yield pa.array(out, pa.binary())

    return features(text)


def _gather(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Features of both views of a bounded number of documents, in order of doc_id; of rows with one doc_id, one."""
    each = rows.select("doc_id", F.struct(_features(F.col("text").cast("string")).alias("f"), *(F.col(c).cast(k).alias(c) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "long")))).alias("r"))
    got = sorted(each.groupBy("doc_id").agg(F.min("r").alias("r")).collect())
    x = np.stack([np.frombuffer(r.r.f, np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, TEXT_DIM), np.float32)
    meta = metadata([r.r.lang for r in got], [r.r.source for r in got], [r.r.n_chars for r in got]).astype(np.float32)
    return x, meta, [r.doc_id for r in got]


def _draw(column: str) -> Column:
    """A number from 0 to 1 that the value decides."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _confident(scored: DataFrame, turn: int, most: int, passed: list[set]) -> dict[int, dict[int, int]]:
    """For each view the doc_ids, and their labels, that it passes on: of the confident rows of each class those with
    the smallest hashes, most // 2 of them, without those it passed on before."""
    out: dict[int, dict[int, int]] = {}
    for v, p in enumerate(("text", "meta")):
        out[v] = {}
        for label in (0, 1):
            sure = scored.filter((F.col(p) >= CONFIDENT) if label else (F.col(p) <= 1 - CONFIDENT))
            ids = [r.doc_id for r in sure.orderBy(F.xxhash64("doc_id", F.lit(turn)), "doc_id").select("doc_id").limit(most // 2 + len(passed[v])).collect()]
            out[v] |= dict.fromkeys([i for i in ids if i not in passed[v]][: most // 2], label)
        passed[v] |= set(out[v])
    return out


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_passed: int = MAX_PASSED, rounds: int = ROUNDS) -> Model | None:
    """A co-trained model; None if the labels don't hold both classes.

    Both classes give half of max_labelled rows each, or all they have, those with the smallest hash of doc_id. In
    each round both views score all documents without a label, and each passes on max_passed of its confident labels
    at most, drawn by hash from all of them. What reaches the driver is a vector of fixed length for each of those
    rows. Labels without a doc_id or quality are ignored; several labels of a document count by their mean, and of
    rows that share a doc_id one is learned from. Reruns agree.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        return None
    quota = max_labelled // 2
    share = F.when(F.col("y") == 1, min(1.0, quota / counts[1])).otherwise(min(1.0, quota / counts[0]))
    chosen = {r.doc_id: r.y for r in known.filter(_draw("doc_id") <= share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()}
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").filter(F.col("doc_id").isNotNull())
    spark = docs.sparkSession
    # the ids are bounded by the parameters, so they can go to all executors
    of = lambda ids: _gather(rows.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids], "doc_id long")), "doc_id"))
    x_text, x_meta, ids = of(chosen) if chosen else of([])
    y = np.array([chosen[i] for i in ids])
    if set(y) != {0, 1}:
        return None
    by = np.argsort(y, kind="stable")
    trainer = Trainer(x_text[by], x_meta[by], y[by], counts[1] / (counts[0] + counts[1]))
    trainer.refit()
    passed: list[set] = [set(), set()]
    for turn in range(rounds):
        now = Model(trainer.views[0], trainer.views[1], np.zeros(3), [])
        scored = rows.select("doc_id", score(now, *(F.col(c) for c in ("text", "lang", "source", "n_chars"))).alias("s")).groupBy("doc_id").agg(F.min("s.text").alias("text"), F.min("s.meta").alias("meta"))
        scored = materialise(scored.join(known, "doc_id", "left_anti"), "confidence")
        new = _confident(scored, turn, max_passed, passed)
        every = sorted(set(new[0]) | set(new[1]))
        if every:
            x_text, x_meta, ids = of(every)
            for v, x in ((0, x_meta), (1, x_text)):  # what the text view labels, the metadata view learns from
                at = [k for k, i in enumerate(ids) if i in new[v]]
                trainer.learn(1 - v, x[at], np.array([new[v][ids[k]] for k in at]))
        trainer.history.append((len(new[0]), len(new[1])))
        trainer.refit()
        trim()
    model = trainer.model()
    trim()
    return model


def score(model: Model | None, text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
    """A struct of the calibrated scores of both views and their combination, from 0 to 1.

    Whole texts count; a null text is empty. Without a model all scores are 1: nothing is known against a document.
    """

    @F.arrow_udf(RESULT)
    def scores(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, *meta in batches:
            out, begin = [], 0
            for end in slice_ends(texts, SLICE):
                if end > begin or not len(texts):
                    n = end - begin
                    if model is None:
                        parts = [np.ones(n)] * 3
                    else:
                        t = model.text.odds(describe(*textvec.column_bytes(texts.slice(begin, n))).scores(model.text.weights))
                        m = model.meta.odds(metadata(*(c.slice(begin, n).to_pylist() for c in meta)) @ model.meta.weights)
                        parts = [_sigmoid(t), _sigmoid(m), model.combine(np.clip(t, -12, 12), np.clip(m, -12, 12))]
                    out.append(pa.StructArray.from_arrays([pa.array(p) for p in parts], names=RESULT.names))
                begin = end
            trim()
            yield pa.concat_arrays(out)

    return scores(text.cast("string"), lang.cast("string"), source.cast("string"), n_chars.cast("long"))


def score_documents(docs: DataFrame, model: Model | None, name: str = "scores") -> DataFrame:
    """The columns of docs and a struct ``name`` of text, meta and quality scores.

    A column of docs called like ``name`` is an error."""
    require_free(docs, name)
    return docs.withColumn(name, score(model, F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars")))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the scores of both views and of their combination, and whether the document is kept."""
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", F.col("scores.text").alias("text_score"), F.col("scores.meta").alias("meta_score"), F.col("scores.quality").alias("quality"), (F.col("scores.quality") >= THRESHOLD).alias("kept"))
