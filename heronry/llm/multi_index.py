"""Nearest neighbours by multi-index hashing over learned, rotated binary codes.

Codes come from rotations learned on a bounded sample: principal axes, then the rotation that loses least when
coordinates are cut to their signs, twice from different starts. A code is split into substrings of like length,
each with a table of its own, in which buckets hold the rows whose substrings begin alike. Depths are dealt to tables
so that every code within a radius R is within the depth of some table (see thresholds): a query goes to the buckets
whose beginnings lie within the depth, and probes their substrings; full codes and then the original vectors decide
among what the tables retrieve.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.common import materialise

#: Rows that the rotations and the radius are learned from.
SAMPLE_ROWS = 4000
#: Rotations (each gives a bit for each dimension), and bits in a substring, at most.
ROTATIONS, SUBSTRING = 2, 26
#: Share of the sample's true neighbours that the radius must hold. Neighbours in the whole table are nearer
#: than those in the sample, so the table's share lies above it.
TARGET = 0.95
#: Rows of a bucket that a task holds at once, queries that it is asked, and queries that it takes at once.
BUCKET, QUERY_BLOCK, QUERY_BATCH = 16_384, 65_536, 512


@dataclass
class Index:
    """Axes to project on (augmented dimension by bits), the sample's mean, the largest norm, and the radius."""

    axes: np.ndarray
    mean: np.ndarray
    norm: float
    radius: int

    @property
    def dim(self) -> int:
        return len(self.mean) - 1

    def bits(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return (augment(x, self.norm, query) - self.mean) @ self.axes > 0

    @property
    def tables(self) -> int:
        return max(1, -(-self.axes.shape[1] // SUBSTRING))

    @property
    def edges(self) -> list[int]:
        """Where substrings begin and end: they share the bits evenly."""
        n = self.axes.shape[1]
        return [n * t // self.tables for t in range(self.tables + 1)]

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Substrings of the codes, a column for each table."""
        bits, edges = self.bits(x, query), self.edges
        return np.stack([bits[:, a:b] @ (1 << np.arange(b - a - 1, -1, -1, dtype=np.int64)) for a, b in zip(edges[:-1], edges[1:], strict=True)], 1)

    def packed(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Whole codes as bytes."""
        return np.packbits(self.bits(x, query), axis=1)


def augment(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Vectors on the unit sphere whose cosines are in the order of the inner products: a candidate gets the
    coordinate that fills it up to the largest norm, a query gets zero there."""
    length = np.linalg.norm(x, axis=1)
    if query:
        return np.column_stack([x / length[:, None], np.zeros(len(x))])
    return np.column_stack([x / norm, np.sqrt(np.maximum(0, 1 - (length / norm) ** 2))])


def _rotation(v: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """The rotation that brings v's rows nearest to corners of the cube."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return r


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int32)


def fit(sample: np.ndarray, norm: float, k: int, rotations: int = ROTATIONS, target: float = TARGET) -> Index:
    """Learn axes from the sample's vectors, and a radius from their neighbours among themselves."""
    x = augment(sample, norm, False)
    mean = x.mean(0)
    _, s, axes = np.linalg.svd(x - mean, full_matrices=False)
    axes = axes[s > 1e-9 * max(1e-300, s[0])].T if len(s) else np.eye(x.shape[1])
    if not axes.size:
        axes = np.eye(x.shape[1])
    v = (x - mean) @ axes
    index = Index(np.concatenate([axes @ _rotation(v, i) for i in range(rotations)], axis=1), mean, norm, 0)
    codes, queries = index.packed(sample), index.packed(sample, query=True)
    found = []
    for i in range(0, len(sample), max(1, len(sample) // 200)):
        score = sample @ sample[i]
        score[i] = -np.inf
        nearest = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        found.append(distances(codes[nearest], queries[i]))
    found = np.concatenate(found) if found else np.zeros(0)
    index.radius = int(np.quantile(found, target, method="higher")) if len(found) else index.axes.shape[1]
    return index


def thresholds(radius: int, tables: int) -> list[int]:
    """For each table, how far a substring may differ; -1 for a table that needs no look. They add up to radius - tables +
    1: a code that lies further away in every table differs in radius + 1 bits at least."""
    low, more = divmod(radius - tables + 1, tables)
    return [max(-1, low + (t < more)) for t in range(tables)]


def retrieved(substrings: np.ndarray, own: np.ndarray, depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the tables retrieve each row for a query, and the first table that does. substrings: a column a table."""
    near = np.bitwise_count(substrings ^ own) <= np.array(depths)
    return near.any(1), near.argmax(1)


def search_bucket(index: Index, table: int, depths: list[int], radius: int, k: int, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, id and score of each query's k best among the rows of one bucket of a table that lie within
    the radius. A row that an earlier table retrieves too is left to that table."""
    substrings, packed = index.codes(x), index.packed(x)
    order = np.argsort(substrings[:, table], kind="stable")
    values, starts = np.unique(substrings[order, table], return_index=True)
    sizes = np.diff(np.append(starts, len(order)))
    own, own_packed = index.codes(queries, query=True), index.packed(queries, query=True)
    out = []
    for place, q in enumerate(query_ids.tolist()):
        probed = np.bitwise_count(values ^ own[place, table]) <= depths[table]
        rows = order[np.repeat(probed, sizes)]
        rows = rows[distances(packed[rows], own_packed[place]) <= radius]
        if table:
            earlier, _ = retrieved(substrings[rows, :table], own[place, :table], depths[:table])
            rows = rows[~earlier]
        rows = rows[ids[rows] != q]
        # a row's sum must not depend on where it stands: equal vectors must tie
        score = (x[rows] * queries[place]).sum(1)
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), place), ids[rows][best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in chunks]
    return (np.concatenate(flat) if flat else np.zeros(0)).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows found with the largest inner products with each query.

    Every row but those with the query's own id is a candidate; ties go to the smaller id. Rows with a null id,
    and vectors that are null, zero, hold a null or non-finite component or have not the most common dimension,
    take no part. Repeated rows are candidates of their own, and every query row gets an answer of its own. A query
    finds min(k, candidates) rows: one that finds too few within the radius is asked again with a wider one. Rows are
    dealt by table and bucket, and crowded buckets in parts; queries go to the buckets that they can reach.
    """
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialise(rows, "vectors")
    spark = vectors.sparkSession
    kinds = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))
    kind = kinds.orderBy(F.desc("n"), "dim").first()
    if kind is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == kind.dim)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).select("v").toPandas()["v"]
    index = fit(np.stack(sample.to_list()), kind.norm, k)
    # equal query rows are asked once and answered as often as they occur
    asking = rows.withColumnRenamed("id", id_col).filter(is_query).groupBy(F.col(id_col).alias("id"), "v").agg(F.count(F.lit(1)).alias("times"))
    asking = materialise(asking.withColumn("key", F.xxhash64("id", "v")), "queries")
    total = kind.n
    placed = _placed(rows, index, total)
    counts = placed.groupBy("t", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / BUCKET).cast("int")).drop("n")
    counts = materialise(counts, "buckets")
    found, waiting, widest = None, asking, index.axes.shape[1]
    for radius in (index.radius, index.radius + (widest - index.radius) // 4, widest):
        hits = materialise(_search(placed, counts, waiting, index, radius, k, total), "found")
        found = hits if found is None else found.join(waiting.select("key"), "key", "left_anti").unionByName(hits)
        # those that have found fewer than k, and could find more
        enough = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("key")
        waiting = materialise(waiting.join(enough, "key", "left_anti"), "waiting")
        if radius == widest or not waiting.take(1):
            break
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.withColumn("times", F.explode(F.array_repeat("times", F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")


def prefix_bits(index: Index, rows: int) -> int:
    """How many bits of a substring name its bucket, so that buckets have about BUCKET rows."""
    shortest = min(b - a for a, b in zip(index.edges[:-1], index.edges[1:], strict=True))
    return min(shortest, max(0, (rows // BUCKET).bit_length()))


def _buckets(index: Index, codes: np.ndarray, bits: int) -> np.ndarray:
    width = np.diff(index.edges)
    return codes >> (width - bits)


def _placed(rows: DataFrame, index: Index, total: int) -> DataFrame:
    """t, b, id and v: every row in its bucket of every table."""
    bits = prefix_bits(index, total)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = _buckets(index, index.codes(_matrix(batch.column("v"), index.dim)), bits)
            for t in range(index.tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(bucket[:, t]), batch.column("id"), batch.column("v")], names=["t", "b", "id", "v"])

    return rows.select("id", "v").mapInArrow(place, "t int, b long, id long, v array<double>")


def _reached(asking: DataFrame, index: Index, radius: int, total: int) -> DataFrame:
    """t, b, key, id, v and times of the buckets whose beginnings lie within a query's depth in their table."""
    bits, depths = prefix_bits(index, total), thresholds(radius, index.tables)
    every = np.arange(1 << bits, dtype=np.int64)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _buckets(index, index.codes(_matrix(batch.column("v"), index.dim), query=True), bits)
            for t, depth in enumerate(depths):
                for i in range(batch.num_rows):
                    near = every[np.bitwise_count(every ^ own[i, t]) <= depth]
                    if len(near):
                        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([near.tolist()], pa.list_(pa.int64())), *(batch.column(c).slice(i, 1) for c in ("key", "id", "v", "times"))], names=["t", "b", "key", "id", "v", "times"])

    wide = asking.select("key", "id", "v", "times").mapInArrow(reach, "t int, b array<long>, key long, id long, v array<double>, times long")
    return wide.withColumn("b", F.explode("b"))


def _search(placed: DataFrame, counts: DataFrame, asking: DataFrame, index: Index, radius: int, k: int, total: int) -> DataFrame:
    """query_id, key, times, vec_id and score of what each bucket's part gives each query that reaches it."""
    depths = thresholds(radius, index.tables)
    blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    all_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    of = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    # equal rows are dealt by their places in the table too
    part = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts")).cast("int")
    dealt = placed.join(counts, ["t", "b"]).withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = _reached(asking, index, radius, total).join(counts, ["t", "b"]).withColumn("part", all_parts).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    group = ["t", "b", "part", "block"]
    one = dealt.select(*group, F.lit(0).alias("side"), "id", "v", none("long").alias("key"), none("long").alias("times"))
    two = asked.select(*group, F.lit(1).alias("side"), "id", "v", "key", "times")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held, queries in _bucket_queries(batches, group, index.dim):
            ids, x = held
            at, vec_id, score = search_bucket(index, name[0], depths, radius, k, ids, x, queries.column("id").to_numpy(), _matrix(queries.column("v"), index.dim))
            pick = lambda c: queries.column(c).take(pa.array(at.astype(np.int64)))  # noqa: E731,B023
            t = pa.table({"query_id": pick("id"), "key": pick("key"), "times": pick("times"), "vec_id": pa.array(vec_id, pa.int64()), "score": pa.array(score, pa.float64())})
            yield from t.combine_chunks().to_batches()

    together = one.unionByName(two).repartition(*group).sortWithinPartitions(*group, "side")
    return together.mapInArrow(search, "query_id long, key long, times long, vec_id long, score double")


def _bucket_queries(batches: Iterator[pa.RecordBatch], group: list[str], dim: int) -> Iterator[tuple[tuple, tuple[np.ndarray, np.ndarray], pa.Table]]:
    """Each bucket's rows, once for every QUERY_BATCH of the queries that follow them. Rows come sorted by bucket, rows of
    the table before queries."""
    name, rows, held, waiting = None, [], None, []

    def built() -> tuple[np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(rows).combine_chunks()
        return t.column("id").to_numpy(), _matrix(t.column("v"), dim)

    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in (*group, "side")])
        edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if a == b:
                continue
            here, side = tuple(key[:-1, a].tolist()), key[-1, a]
            if here != name:
                if waiting and held is not None:
                    yield name, held, pa.Table.from_batches(waiting)
                name, rows, held, waiting = here, [], None, []
            if side == 0:
                rows.append(batch.slice(a, b - a))
                continue
            if held is None and rows:
                held, rows = built(), []
            waiting.append(batch.slice(a, b - a))
            if sum(w.num_rows for w in waiting) >= QUERY_BATCH:
                if held is not None:
                    yield name, held, pa.Table.from_batches(waiting)
                waiting = []
    if waiting and held is not None:
        yield name, held, pa.Table.from_batches(waiting)


def report(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20: query_id, rank, vec_id and score."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
