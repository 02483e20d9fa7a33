"""Near copies of documents: all pairs whose sets of shingles have a Jaccard similarity of 4/5 or more.

SimHash fingerprints within a few bits, found under covering masks, give the first candidates; whole sets decide.
Similarity 4/5 lies near ten bits, which would need thousands of masks, so prefixes of the sets (see line_dedup)
find all other pairs: no pair is missed. Documents that the fingerprints linked already are not compared again,
unless their sets are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm import line_dedup, textvec
from heronry.llm.common import batch_slices, in_slices, materialise, trim
from heronry.llm.components import components
from heronry.llm.line_dedup import DEN, FILTER_BITS, NUM
from heronry.llm.simhash import _fingerprints, fingerprint_links

SETS = "id long, fp long, sig long, n int, bits long, wide binary, prefix array<long>"


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of all shingles; a text of fewer words is one shingle, one without words has none."""
    starts, ends, doc = textvec.words(raw, offsets)
    w = textvec.word_hashes(textvec.ascii_lower(raw), starts, ends)
    if not len(w):
        return doc, w
    left = np.searchsorted(doc, doc, side="right") - np.arange(len(doc))
    h = w.copy()
    for j in range(1, width):
        on = np.flatnonzero(left > j)
        h[on] = textvec.mix(h[on] * np.uint64(textvec.BASE) + w[on + j])
    kept = (left >= width) | np.append(True, doc[1:] != doc[:-1])
    return doc[kept], h[kept]


def signature(text: Column, width: int) -> Column:
    """An order-free hash, as a long, of the text's set of shingles; zero for none."""

    @F.arrow_udf(T.LongType())
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = np.zeros(line_dedup.CELLS, np.uint64)

        def of(column: pa.Array) -> pa.Array:
            raw, offsets = textvec.column_bytes(column)
            doc, h = line_dedup.by_rarity(*shingles(raw, offsets, width), ranks, len(column))
            first, _, sig, _ = line_dedup._signature(doc, h)
            out = np.zeros(len(column), np.uint64)
            out[doc[first]] = sig
            return pa.array(out.view(np.int64))

        for column in batches:
            yield in_slices(column, of)

    return signed(text.cast("string"))


def _sets(docs: DataFrame, ranks: object, width: int) -> DataFrame:
    """A row for each document with a word: id, fingerprint, set, and the rarest shingles that make its prefix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "text"):
            raw, offsets = textvec.column_bytes(batch.column("text"))
            doc, h = line_dedup.by_rarity(*shingles(raw, offsets, width), ranks.value, batch.num_rows)
            first, size, sig, bits = line_dedup._signature(doc, h)
            reach = np.where(size * DEN < (size + 1) * NUM, 0, size - (NUM * size + DEN - 1) // DEN + 1)
            at = np.repeat(first, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(reach)), pa.int32()), pa.array(h[at].view(np.int64)))
            # fingerprints are taken here, since a second Python worker for each task would need memory of its own
            mine = [c.take(pa.array(doc[first])) for c in (batch.column("id"), _fingerprints(batch.column("text"), width))]
            columns = [*mine, pa.array(sig.view(np.int64)), pa.array(size, pa.int32()), pa.array(bits.view(np.int64)), line_dedup._wide_bitmaps(h, first, size), prefix]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "sig", "n", "bits", "wide", "prefix"])

    return docs.select("id", "text").mapInArrow(rows, SETS)


def _whole_sets(docs: DataFrame, ranks: object, sigs: DataFrame, width: int) -> DataFrame:
    """sig and all shingles, in order of rarity, of the sets that sigs names and of some others."""
    member = docs.sparkSession.sparkContext.broadcast(line_dedup._membership(sigs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches, "text"):
            raw, offsets = textvec.column_bytes(batch.column("text"))
            doc, h = line_dedup.by_rarity(*shingles(raw, offsets, width), ranks.value, batch.num_rows)
            first, size, sig, _ = line_dedup._signature(doc, h)
            bit = (sig.view(np.int64) % FILTER_BITS).astype(np.uint64)
            hit = np.flatnonzero(member.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
            _, once = np.unique(sig[hit], return_index=True)
            hit = hit[once]
            words = h.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig[hit].view(np.int64)), pa.array([words[a : a + n].tobytes() for a, n in zip(first[hit].tolist(), size[hit].tolist(), strict=True)], pa.binary())], names=["sig", "words"])

    return docs.select("text").mapInArrow(rows, "sig long, words binary").join(sigs, "sig", "left_semi").groupBy("sig").agg(F.first("words").alias("words"))


@F.arrow_udf(T.BooleanType())
def _similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = (np.frombuffer(v.as_py(), np.int64) for v in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append((NUM + DEN) * both >= NUM * (len(x) + len(y)))
        yield pa.array(out, pa.bool_())
    trim()


def _fingerprint_links(docs: DataFrame, sets: DataFrame, ranks: object, radius: int, width: int) -> DataFrame:
    """Links (a, b) of similar sets whose fingerprints are equal or linked by covering masks."""
    of = materialise(sets.select("fp", "sig").distinct(), "set-prints")
    least = materialise(of.groupBy("fp").agg(F.min("sig").alias("rep")), "set-reps")
    equal = of.join(least, "fp").filter("sig <> rep").select(F.col("rep").alias("a"), F.col("sig").alias("b"))
    near = fingerprint_links(least.select("fp"), radius)
    rep = lambda c: least.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}"))
    near = near.join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    pairs = materialise(equal.unionByName(near).distinct(), "set-pairs")
    sigs = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    whole = materialise(_whole_sets(docs, ranks, sigs, width), "pair-sets")
    side = lambda c: whole.select(F.col("sig").alias(c), F.col("words").alias(f"words_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_similar(F.col("words_a"), F.col("words_b"))).select("a", "b")


def _roots(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """The least member of each of m members' component under links i, j."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        for at in (i, j, root[i], root[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _prefix_links(docs: DataFrame, sets: DataFrame, parts: DataFrame, ranks: object, width: int) -> DataFrame:
    """Links (a, b) that, with those within parts, connect all similar sets. parts: node, least."""
    once = sets.groupBy("sig").agg(F.first("n").alias("n"), F.first("wide").alias("wide"))
    live = materialise(line_dedup._live(sets), "live-sets")
    some = live.select("sig").distinct()
    known = once.join(some, "sig", "left_semi").join(parts, F.col("sig") == F.col("node"), "left").select("sig", "n", "wide", F.coalesce("least", "sig").alias("part"))
    live = materialise(line_dedup._refined(live, known), "refined-sets")
    sigs = live.select("sig").distinct()
    live = materialise(line_dedup._needed(live), "needed-sets")
    whole = materialise(_whole_sets(docs, ranks, sigs, width), "whole-sets")
    rows = line_dedup.dealt(live, whole).select("word", "i", "j", "own", "sig", "words")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in line_dedup._whole_groups(batches, ("word", "i", "j")):
            key = np.stack([t.column(c).to_numpy() for c in ("word", "i", "j")])
            edge = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))), t.num_rows)
            own, sig, raw = t.column("own").to_numpy(), t.column("sig").to_numpy(), t.column("words")
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for begin, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if end - begin < 2:
                    continue
                members = [np.frombuffer(w, np.int64) for w in raw.slice(begin, end - begin).to_pylist()]
                place = [int(np.flatnonzero(s == key[0, begin])[0]) for s in members]
                i, j = line_dedup._pairs(members, place, own[begin:end] if key[1, begin] != key[2, begin] else None)
                if len(i):
                    root = _roots(i, j, end - begin)
                    tied = np.flatnonzero(root != np.arange(len(root)))
                    a.append(sig[begin + root[tied]])
                    b.append(sig[begin + tied])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])
        trim()

    return rows.repartition("word", "i", "j").sortWithinPartitions("word", "i", "j").mapInArrow(join, "a long, b long")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group that similar pairs connect, the one with the smallest id, with the columns of docs.

    Pairs are similar if their sets of shingles have a Jaccard similarity of 4/5 or more; radius bounds the
    fingerprints' candidates, which changes cost and not results. Of rows that share the smallest id the first text
    by order stays. A group of null ids alone keeps one of them. Documents without words are equal documents.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = line_dedup.word_counts(plain, lambda raw, offsets: shingles(raw, offsets, width)[1])
    ranks = docs.sparkSession.sparkContext.broadcast(line_dedup._ranks(counts))
    sets = materialise(_sets(plain, ranks, width), "sets")
    near = materialise(_fingerprint_links(plain, sets, ranks, radius, width), "near-links")
    parts = materialise(components(near), "near-parts")
    more = _prefix_links(plain, sets, parts, ranks, width)
    found = components(parts.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(more))
    ids = sets.select("id", "sig").unionByName(plain.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select("id", F.lit(0).cast("long").alias("sig")))
    named = ids.groupBy("sig").agg(F.min("id").alias("id")).join(found, F.col("sig") == F.col("node"), "left").select("sig", "id", F.coalesce("least", "sig").alias("part"))
    named = materialise(named, "set-parts")
    named = named.join(named.groupBy("part").agg(F.min("id").alias("component")), "part").select(F.col("sig").alias("s"), "part", "component")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), signature(F.col(text_col), width).alias("sig"), F.struct(*docs.columns).alias("row"))
    best = rows.join(named, F.col("sig") == F.col("s")).filter(F.col("id").eqNullSafe(F.col("component")))
    return best.groupBy("part").agg(F.min_by("row", F.coalesce(F.col(f"row.{text_col}"), F.lit(""))).alias("row")).select("row.*")
