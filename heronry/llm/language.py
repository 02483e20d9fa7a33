"""Language identification in two steps: the family first, then linear support vector machines, one for each pair of
its languages, that vote."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm import textvec
from heronry.llm.common import in_slices

#: Families of language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu"),
    "sinitic": ("zh", "yue"),
    "semitic": ("ar", "he", "am"),
}
#: Buckets of hashed byte trigrams.
BUCKETS = 1 << 13
#: Rows that the model is fitted on, over all languages, and passes over them.
MAX_ROWS, EPOCHS = 2000, 120
#: Factor that brings shares of trigrams to a useful range, and the penalty on weights.
SCALE, PENALTY = 100.0, 1e-4

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"lang:{lang}")


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram within a text, and its text. Letters are folded, other ASCII is a space."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _FOLD[raw]
    accent = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    x[accent] += 32
    x = x.astype(np.uint32)
    h = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:-2]
    inside = np.ones(len(h), bool)
    for back in (1, 2):
        edge = offsets[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(h))]] = False
    return h[inside].astype(np.int64), doc[inside]


def profile(text: Column) -> Column:
    """Shares of the text's trigrams by bucket, as float16 bytes."""

    @F.arrow_udf(T.BinaryType())
    def profiles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def rows(column: pa.Array) -> pa.Array:
            raw, offsets = textvec.column_bytes(column)
            n = len(column)
            h, doc = trigrams(raw, offsets)
            cuts = np.searchsorted(doc, np.arange(n + 1))
            out = [(np.bincount(h[a:b], minlength=BUCKETS) * (SCALE / max(1, b - a))).astype(np.float16).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.array(out, pa.binary())

        for column in batches:
            yield in_slices(column, rows)

    return profiles(text)


@dataclass
class Model:
    """Weights by bucket: columns for the families, then a column for each pair of languages within a family."""

    families: list[str]
    members: dict[str, list[str]]
    weights: np.ndarray

    @property
    def columns(self) -> list[tuple[str, str, str]]:
        return [("", f, "") for f in self.families] + [(f, a, b) for f in self.families for a, b in combinations(self.members[f], 2)]


def _hinge(x: np.ndarray, y: np.ndarray, epochs: int, penalty: float) -> np.ndarray:
    """Linear SVM weights for +1/-1 targets, one column each: averaged subgradient steps, classes weighed alike."""
    n, k = y.shape
    w, total = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32)
    rarity = np.where(y > 0, 0.5 / np.maximum((y > 0).mean(0), 1 / n), 0.5 / np.maximum((y < 0).mean(0), 1 / n)).astype(np.float32)
    for t in range(epochs):
        active = ((x @ w) * y < 1) * y * rarity
        w = (1 - penalty) * w + (x.T @ active.astype(np.float32)) * np.float32(0.5 / n / (1 + t / 20))
        if t >= epochs // 2:
            total += w
    return total / max(1, epochs - epochs // 2)


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, text_col: str = "text", lang_col: str = "lang", key_col: str = "key") -> Model | None:
    """Learn from a bounded sample of rows with a language; None if there are none.

    Each language gives the same number of rows, about max_rows in all, those with the smallest hash in
    ``key_col``; rows without a key are not learned from. What reaches the driver is max_rows profiles of fixed length.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    quota = max(1, max_rows // len(counts))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, float(min(1.0, quota / n)))))
    draw = F.pmod(F.xxhash64(F.col(key_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(draw <= share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(key_col).alias("key"))
    # keys are chosen without their texts, and max_rows of them can go to all executors
    keys = sample.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(max_rows)
    each = sample.join(F.broadcast(keys), "key").select("key", "lang", profile(F.col("text")).alias("p"))
    # of rows that share a key one is learned from
    got = sorted(each.groupBy("key").agg(F.min(F.struct("lang", "p")).alias("r")).select("r.lang", "r.p", F.xxhash64("key").alias("h"), "key").collect(), key=lambda r: (r.h, r.key))
    return learn([r.lang for r in got], np.stack([np.frombuffer(r.p, np.float16) for r in got]).astype(np.float32))


def learn(labels: list[str], x: np.ndarray) -> Model:
    """A model from profiles and their languages: a column for each family against the others, then one for each pair
    of languages of a family, fitted on rows of those two alone."""
    langs = np.array(labels)
    kinds = np.array([family(lang) for lang in langs])
    families = sorted(set(kinds))
    members = {f: sorted(set(langs[kinds == f])) for f in families}
    parts = [_hinge(x, np.where(kinds[:, None] == np.array(families)[None], 1, -1), EPOCHS, PENALTY)]
    for f in families:
        for a, b in combinations(members[f], 2):
            mine = (langs == a) | (langs == b)
            parts.append(_hinge(x[mine], np.where(langs[mine][:, None] == a, 1, -1), EPOCHS, PENALTY))
    return Model(families, members, np.concatenate(parts, axis=1))


def _vote(margins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of k languages wins most of its pairs (of equals the one with the larger margins), and mean margins.

    margins: a column for each pair, positive for its first language.
    """
    votes, total = np.zeros((len(margins), k)), np.zeros((len(margins), k))
    for j, (a, b) in enumerate(combinations(range(k), 2)):
        votes[:, a] += margins[:, j] >= 0
        votes[:, b] += margins[:, j] < 0
        total[:, a] += margins[:, j] / (k - 1)
        total[:, b] -= margins[:, j] / (k - 1)
    return np.where(votes == votes.max(1, keepdims=True), total, -np.inf).argmax(1), total


def _predict(model: Model | None, column: pa.Array) -> pa.StructArray:
    raw, offsets = textvec.column_bytes(column)
    n = len(column)
    letter = ((raw >= 97) & (raw <= 122)) | ((raw >= 65) & (raw <= 90))
    to = np.concatenate([np.zeros(1, np.int64), np.cumsum(letter)])
    known = to[offsets[1:]] > to[offsets[:-1]]
    for i in np.flatnonzero(~known & (np.diff(offsets) > 0)).tolist():
        known[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode())
    if model is None:
        return pa.StructArray.from_arrays([pa.array(["und"] * n, pa.string()), pa.array([0.0] * n)], names=["lang_pred", "score"])
    h, doc = trigrams(raw, offsets)
    cuts = np.searchsorted(doc, np.arange(n + 1))
    sums = np.zeros((n, model.weights.shape[1]))
    for c in range(model.weights.shape[1]):
        to = np.concatenate([np.zeros(1), np.cumsum(model.weights[:, c].astype(np.float64)[h])])
        sums[:, c] = to[cuts[1:]] - to[cuts[:-1]]
    margins = sums * (SCALE / np.maximum(1, np.diff(cuts)))[:, None]
    columns = model.columns
    k = len(model.families)
    softmax = lambda z: (e := np.exp(np.clip(2 * (z - z.max(1, keepdims=True)), -60, 0))) / e.sum(1, keepdims=True)
    outer = softmax(margins[:, :k])
    first = margins[:, :k].argmax(1)
    names, score = np.empty(n, object), outer[np.arange(n), first]
    for i, f in enumerate(model.families):
        mine = np.flatnonzero(first == i)
        at = [j for j, (of, _, _) in enumerate(columns) if of == f]
        if not at:
            names[mine] = model.members[f][0]
        elif len(mine):
            best, total = _vote(margins[np.ix_(mine, at)], len(model.members[f]))
            inner = softmax(total)
            names[mine] = np.array(model.members[f], object)[best]
            score[mine] *= inner[np.arange(len(mine)), best]
    names[~known], score[~known] = "und", 0.0
    return pa.StructArray.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], names=["lang_pred", "score"])


def predict_language(text: Column, model: Model | None) -> Column:
    """A struct of lang_pred and score (0 to 1) from the whole text.

    ``und`` with score 0 for a null text, a text without a letter, or a model that learned no language.
    """

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield in_slices(column, lambda x: _predict(model, x))

    return predict(text.cast("string"))


def held_out() -> Column:
    """True where crc32 of the doc_id as text leaves 2 modulo 4; false for a null id, which is not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from those that are not held out."""
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang", F.col("doc_id").alias("key"))
    model = fit(learn, max_rows)
    out = docs.select("doc_id", held_out().alias("held_out"), predict_language(F.col("text"), model).alias("r"))
    return out.select("doc_id", "held_out", "r.lang_pred", "r.score")
