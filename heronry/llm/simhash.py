"""SimHash fingerprints and their links, found by covering locality-sensitive hashing.

The masks are structured: every bit position gets a nonzero vector of radius + 1 bits, and the mask of a nonzero
vector v keeps the positions whose vector has an odd product with v. Any ``radius`` positions leave some v with
even products to all of them, so two fingerprints that differ in these positions only agree under v's mask:
no pair within the radius is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from heronry.llm import textvec
from heronry.llm.common import in_slices, materialise
from heronry.llm.components import components

BITS = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Distinct fingerprints that a task compares with each other; larger buckets are masked again.
MAX_BUCKET = 4096


def _fingerprints(column: pa.Array, width: int) -> pa.Array:
    raw, offsets = textvec.column_bytes(column)
    data = textvec.ascii_lower(raw).tobytes()
    out = np.zeros(len(column), np.uint64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        words = _WORD.findall(data, a, b)
        if not words:
            continue
        if len(words) <= width:
            out[i] = xxh64_intdigest(b" ".join(words), 42)
            continue
        text = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
        h = np.array([xxh64_intdigest(text[s:e], 42) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
        ones = np.zeros(BITS, np.int64)
        for k in range(0, len(h), 1 << 16):
            part = np.ascontiguousarray(h[k : k + (1 << 16)])
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return pa.array(out.view(np.int64))


def fingerprint(text: Column, width: int = 4) -> Column:
    """A 64-bit SimHash, as a long, of the text's ``width``-word shingles.

    Words are runs outside white space with A-Z in lower case. A text of fewer words is one shingle; a text
    without words, empty or null, has fingerprint zero. Repeated shingles count as often as they occur.
    """

    @F.arrow_udf(T.LongType())
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield in_slices(column, lambda x: _fingerprints(x, width))

    return hashed(text.cast("string"))


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius + 1) - 1 masks of about bits / 2 ones each that cover all pairs within the radius."""
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    return [sum(1 << i for i, p in enumerate(vectors) if (p & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _roots(values: np.ndarray, radius: int) -> np.ndarray:
    """Index of a fixed member of each value's component under links within the radius; rows of the matrix of
    differences are taken a block at a time."""
    n = len(values)
    root, todo = np.full(n, -1), np.arange(n)
    while len(todo):
        first = todo[0]
        root[first] = first
        front, rest = todo[:1], todo[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for block in np.array_split(front, -(-len(front) // 256)):
                near |= (np.bitwise_count(values[block][:, None] ^ values[rest][None]) <= radius).any(0)
            front, rest = rest[near], rest[~near]
            root[front] = first
        todo = rest
    return root


def _bucket_links(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """A star of links for each component within each bucket; a bucket has MAX_BUCKET rows at most."""

    def link(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in groups:
            got = pa.Table.from_batches([batch])
            held = got if held is None else pa.concat_tables([held, got])
            bucket = np.stack([held.column(k).to_numpy() for k in keys])
            # the last bucket may go on in the next batch
            edge = np.flatnonzero((bucket[:, 1:] != bucket[:, :-1]).any(0)) + 1
            if len(edge):
                yield _stars(held.column("fp").to_numpy()[: edge[-1]], np.concatenate([[0], edge]), radius)
                held = held.slice(edge[-1])
        if held is not None:
            yield _stars(held.column("fp").to_numpy(), np.array([0, held.num_rows]), radius)

    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp").mapInArrow(link, "a long, b long")


def _stars(fp: np.ndarray, cuts: np.ndarray, radius: int) -> pa.RecordBatch:
    fp = fp.view(np.uint64)
    a, b = [], []
    sizes = np.diff(cuts)
    two = cuts[:-1][sizes == 2]
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
    a.append(fp[two[near]])
    b.append(fp[two[near] + 1])
    for begin, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        values = np.unique(fp[begin : begin + n])
        root = _roots(values, radius)
        tied = np.flatnonzero(root != np.arange(len(values)))
        a.append(values[root[tied]])
        b.append(values[tied])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def fingerprint_links(fingerprints: DataFrame, radius: int = 4, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius of each other.

    fingerprints: one column fp of distinct longs. A bucket is a mask and what it keeps of a fingerprint; its
    members are compared in one task, and each component gives one star of links instead of all pairs. A bucket
    of more than max_bucket members is masked again with the same masks over the bits that are still free; this
    keeps every pair, since those bits hold all differences. Every level leaves about half of the bits free that
    were, and a bucket with b free bits has 2^b members at most, so levels end, and no bucket is ever compared that is larger
    than max_bucket.
    """
    masks = covering_masks(radius)
    table = F.array(*(F.lit(_signed(m)).cast("long") for m in masks))
    first = fingerprints.select("fp", F.posexplode(table).alias("t1", "mask")).select("fp", F.col("t1").cast("long").alias("t"), F.col("mask"), (F.col("fp").bitwiseAND(F.col("mask"))).alias("kept"))
    keys = ["t", "kept"]
    counts = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = materialise(counts, "buckets")
    many = counts.filter(F.col("n") > max_bucket)
    some = counts.filter(F.col("n") <= max_bucket)
    links = _bucket_links(first.join(some.drop("n"), keys, "left_semi"), keys, radius)
    level = 0
    while many.take(1):
        if level == 62 // (radius + 1) - 1:  # beyond, numbers of mask sequences outgrow a long
            raise RuntimeError(f"buckets are still crowded after {level} levels of masks")
        # bits outside the mask are free: deal masks over their ranks by masking again with shifted vectors
        level += 1
        rows = first.join(many.drop("n"), keys, "left_semi")
        again = F.array(*(F.lit(_signed(m)).cast("long") for m in _shifted_masks(radius, level)))
        rows = rows.select("fp", F.col("t"), F.col("mask"), F.posexplode(again).alias("u", "more"))
        first = rows.select("fp", (F.col("t") * (1 << (radius + 1)) + F.col("u") + 1).alias("t"), F.col("mask").bitwiseOR(F.col("more")).alias("mask")).withColumn("kept", F.col("fp").bitwiseAND(F.col("mask")))
        first = materialise(first, "masked")
        counts = materialise(first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
        many = counts.filter(F.col("n") > max_bucket)
        some = counts.filter(F.col("n") <= max_bucket)
        links = links.unionByName(_bucket_links(first.join(some.drop("n"), keys, "left_semi"), keys, radius))
    return links


def _shifted_masks(radius: int, level: int) -> list[int]:
    """Covering masks whose vectors are dealt to the bits in another, fixed order for each level."""
    order = np.random.default_rng(level).permutation(BITS).tolist()
    return [sum(1 << order[i] for i in range(BITS) if m >> i & 1) for m in covering_masks(radius)]


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """id, fp, part and component of each document: the smallest id that links of fingerprints within the radius
    reach; part numbers the components.

    Links are searched between distinct fingerprints, so copies cost nothing. Every row gives a row; equal ids
    share a component only if their texts do; a null id is never the smallest unless all ids of a component
    are null. With keep_columns the columns of docs come along in a struct ``row``.
    """
    extra = [F.struct(*docs.columns).alias("row")] if keep_columns else []
    rows = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp"), *extra)
    prints = materialise(rows.select("id", "fp"), "prints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least_id"))
    least = materialise(least, "least")
    found = components(fingerprint_links(least.select("fp"), radius))
    parts = least.join(found, least["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("least", "fp").alias("part"))
    named = parts.groupBy("part").agg(F.min("least_id").alias("component"))
    named = parts.join(named, "part").select(F.col("fp").alias("p"), "part", "component")
    return (rows if keep_columns else prints).join(named, F.col("fp") == F.col("p"), "left").drop("p")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with the columns of docs.

    Of rows that share that id the first text by order stays. A component of null ids alone keeps one of them.
    Documents without words are equal documents.
    """
    found = near_duplicates(docs, radius, width, id_col, text_col, keep_columns=True)
    best = found.filter(F.col("id").eqNullSafe(F.col("component")))
    return best.groupBy("part").agg(F.min_by("row", F.coalesce(F.col(f"row.{text_col}"), F.lit(""))).alias("row")).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex and component_id of every document."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
