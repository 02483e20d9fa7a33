"""Clustering of vectors around centroids by zone maps along a space-filling curve.

Vectors are ordered along a Hilbert curve over the axes in which the first centroids differ most, and packed in that
order into blocks. A block keeps the least and the largest value of each component (its box). For two centroids the
difference of their distances is linear in the vector, so its least value over a box is known from the box alone: a
centroid that is further than another one everywhere in the box can be nearest to none of the block's vectors. Those
that are left are compared exactly, a whole block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.llm.common import bound_batches, drop_path, materialise, materialise_at

#: Components of a vector, centroids, rounds, and steps in a unit of a component.
DIM, CENTROIDS, ROUNDS, STEPS = 64, 40, 5, 256
#: Axes of the curve and bits on each; together they make a key of 63 bits or fewer.
CURVE_AXES, CURVE_BITS = 9, 7
#: Vectors in a block, and rows of a part of the range that the curve is cut into, at most.
BLOCK, PART_ROWS = 128, 100_000
#: Sums of tasks are added up in so many groups for each centroid, and then those.
SUM_GROUPS = 256
#: Below this size of components, sums of squares of whole numbers are exact in floating point.
EXACT = float(1 << 22)

BLOCK_SCHEMA = "ids array<long>, data binary, low binary, high binary"


# ---- the curve ----


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cells (whole numbers below 2^bits, a column for each axis) on the Hilbert curve.

    Neighbours on the curve differ by one step on one axis. Gray-code and rotation steps are undone bit by bit, for all
    rows at once; the key's bits are then those of the axes in turn, highest first.
    """
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[:, i] & q) != 0
            swap = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] ^= np.where(flip, p, swap)
            x[:, i] ^= np.where(flip, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_axes(starts: np.ndarray, most: int = CURVE_AXES) -> np.ndarray:
    """Directions in which the first centroids differ most, one a column."""
    z = starts - starts.mean(0)
    top = np.abs(z).max(initial=0.0)
    _, s, axes = np.linalg.svd(z / (top or 1.0), full_matrices=False)
    kept = axes[s > 1e-9 * max(s[0], 1e-300)][:most] if len(s) and s[0] > 0 else axes[:0]
    return (kept if len(kept) else np.eye(starts.shape[1])[:1]).T


# ---- blocks ----


def pack(ids: pa.Array, x: np.ndarray, size: int = BLOCK) -> pa.RecordBatch:
    """Rows in order as blocks of ``size``: ids, components, and the box."""
    cuts = list(range(0, len(x), size))
    parts = [x[a : a + size] for a in cuts]
    columns = [
        pa.array([ids[a : a + size].to_pylist() for a in cuts], pa.list_(pa.int64())),
        *(pa.array([f(p).tobytes() for p in parts], pa.binary()) for f in (np.ascontiguousarray, lambda p: p.min(0), lambda p: p.max(0))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "data", "low", "high"])


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some vector of a box, in ascending order.

    The centroid nearest to the middle of the box beats another one everywhere in the box if the least difference of
    their squared distances, sum of c^2 - b^2 - 2 x (c - b) over the box, is above zero.
    """
    middle = (low + high) / 2
    best = int(((centroids - middle) ** 2).sum(1).argmin())
    away = centroids - centroids[best]
    least = ((centroids + centroids[best]) * away).sum(1) - 2 * np.where(away > 0, high * away, low * away).sum(1)
    return np.flatnonzero(least <= 0)


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, as Python's numbers of any size."""
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def nearest(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance for each vector of a block; exact, ties to the smaller number."""
    size = max(np.abs(low).max(initial=0), np.abs(high).max(initial=0), max(abs(v) for c in centroids for v in c))
    if size < EXACT:
        c = np.array(centroids, np.float64)
        which = candidates(low, high, c)
        c = c[which]
        d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        at = d.argmin(1)
        return which[at], d[np.arange(len(x)), at].astype(np.int64)
    big, c = _whole(x), np.array(centroids, object)
    d = np.stack([((big - row) ** 2).sum(1) for row in c], 1)
    at = np.array([min(range(len(c)), key=lambda j: (row[j], j)) for row in d])
    return at, d[np.arange(len(x)), at]


# ---- rounds ----


def stepped(vector: Column, dim: int = DIM, steps: int = STEPS) -> Column:
    """Components as whole numbers, floor(steps * x), held as doubles (which is exact); null for a vector that has not
    ``dim`` components, or one that is null, not finite or beyond doubles when multiplied."""
    by = lambda v: F.lit(float(steps)) * v.cast("double")
    # a double from 2^52 on is whole, and may be too large for a long
    out = F.transform(vector, lambda v: F.when(F.abs(by(v)) < float(1 << 52), F.floor(by(v)).cast("double")).otherwise(by(v)))
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(by(v)) < F.lit(float("inf"))))
    return F.when((F.size(vector) == dim) & F.coalesce(sound, F.lit(False)), out)


def _start(rows: DataFrame, k: int) -> list[list[int]]:
    """The k rows with the smallest hash of ``2:<id>``, in that order, then that of their components."""
    digest = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [[int(v) for v in r.v] for r in rows.orderBy(digest, "v").select("v").limit(k).collect()]


def blocks(rows: DataFrame, starts: list[list[int]], n: int) -> DataFrame:
    """rows (id, v) as blocks along the curve. Equal vectors are dealt to parts by their ids and places in the input."""
    first = np.array(starts, np.float64)
    axes = curve_axes(first)
    flat = first @ axes
    centre, spread = flat.mean(0), np.maximum(3 * flat.std(0), 1e-9)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            cell = np.clip(((x @ axes - centre) / spread + 1) / 2, 0, 1 - 1e-12) * (1 << CURVE_BITS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(hilbert(cell, CURVE_BITS)), batch.column("deal")], names=["id", "v", "at", "deal"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 16 * BLOCK:
                whole = pa.Table.from_batches(held).combine_chunks()
                full = whole.num_rows // BLOCK * BLOCK
                yield pack_table(whole.slice(0, full))
                held = whole.slice(full).combine_chunks().to_batches()
        if held:
            yield pack_table(pa.Table.from_batches(held).combine_chunks())

    def pack_table(t: pa.Table) -> pa.RecordBatch:
        v = t.column("v").combine_chunks()
        return pack(t.column("id").combine_chunks(), v.flatten().to_numpy().reshape(t.num_rows, -1))

    dealt = rows.withColumn("deal", F.xxhash64("id", F.monotonically_increasing_id()))
    placed = dealt.select("id", "v", "deal").mapInArrow(keyed, "id long, v array<double>, at long, deal long")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS))
    ranged = placed.repartitionByRange(parts, "at", "deal").sortWithinPartitions("at", "deal")
    return ranged.select("id", "v").mapInArrow(packed, BLOCK_SCHEMA)


def _sums(table: DataFrame, centroids: list[list[int]]) -> list[tuple[int, list[int]]]:
    """For each centroid, the number of its vectors and the sums of their components. A task gives a row for each of its
    centroids, whose sums are texts, as they may be of any size; they are added up in two steps."""
    dim = len(centroids[0])
    kind = pa.schema([("c", pa.int32()), ("g", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.string()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for x, low, high in _read(batch, dim):
                which, _ = nearest(x, low, high, centroids)
                small = max(np.abs(low).max(), np.abs(high).max()) < EXACT
                for c in np.unique(which).tolist():
                    mine = x[which == c]
                    total = mine.sum(0) if small else _whole(mine).sum(0)
                    n, s = found.get(c, (0, [0] * dim))
                    found[c] = n + len(mine), [a + int(b) for a, b in zip(s, total, strict=True)]
        group = TaskContext.get().partitionId() % SUM_GROUPS
        rows = [{"c": c, "g": group, "n": n, "s": list(map(str, s))} for c, (n, s) in found.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=kind)

    def merge(part: pa.Table) -> pa.Table:
        total = [sum(map(int, column)) for column in zip(*part.column("s").to_pylist(), strict=True)]
        row = {"c": part.column("c")[0].as_py(), "g": part.column("g")[0].as_py(), "n": sum(part.column("n").to_pylist()), "s": list(map(str, total))}
        return pa.Table.from_pylist([row], schema=kind)

    ddl = "c int, g int, n long, s array<string>"
    found = table.mapInArrow(add, ddl).groupBy("c", "g").applyInArrow(merge, ddl).groupBy("c").applyInArrow(merge, ddl)
    got = {r.c: (r.n, [int(v) for v in r.s]) for r in found.collect()}
    return [got.get(c, (0, [])) for c in range(len(centroids))]


def _read(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for data, low, high in zip(*(batch.column(c) for c in ("data", "low", "high")), strict=True):
        yield np.frombuffer(data.as_py(), np.float64).reshape(-1, dim), np.frombuffer(low.as_py(), np.float64), np.frombuffer(high.as_py(), np.float64)


def _assigned(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    dim, most = len(centroids[0]), (1 << 63) - 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(x, low, high, centroids) for x, low, high in _read(batch, dim)]
            which, far = (np.concatenate(c) if c else np.zeros(0) for c in (tuple(zip(*found, strict=True)) or ((), ())))
            far = pa.array([min(int(d), most) for d in far], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("ids").flatten(), pa.array(which.astype(np.int32)), far], names=["id", "cluster", "distance"])

    return table.mapInArrow(assign, "id long, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, list[list[int]]]:
    """id, cluster and distance (squared) of every vector that takes part, and the final centroids.

    Components are whole numbers (see stepped). The first centroids are the k rows with the smallest hashes of their
    ids; a table of fewer rows has fewer centroids. A round assigns every vector to the nearest centroid (ties to the
    smaller number) and moves centroids to the floor of the mean of theirs; one without vectors stays. Rows whose vector
    is null, of another length, or holds a null or non-finite component take no part; repeated rows count as often as
    they occur; a row without an id takes part, and its hash is that of ``2:``. All is exact; a distance beyond a long is
    given as the largest long. Only centroids and their sums come to the driver: k vectors a round.
    """
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), stepped(F.col(vector_col), dim).alias("v")).filter("v is not null")
    centroids = _start(rows, k)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "id long, cluster int, distance long"), []
    table, path = materialise_at(blocks(rows, centroids, rows.count()), "zones")
    for _ in range(rounds):
        centroids = [[v // n for v in s] if n else c for c, (n, s) in zip(centroids, _sums(table, centroids), strict=True)]
    out = materialise(_assigned(table, centroids), "clusters")
    drop_path(vectors.sparkSession, path)
    return out, centroids


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part. Sums
    beyond a long are given as the largest long."""
    out, centroids = cluster(vectors)
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(total("distance").alias("s")).collect()}
    whole = min(sum(sums.values()), (1 << 63) - 1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = vectors.sparkSession.createDataFrame([(c, sums.get(c, 0), d) for c, d in enumerate(digests)], "cluster int, cluster_inertia long, centroid_sha256 string")
    # a row for each centroid
    return out.join(F.broadcast(each), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")


def _oracle() -> str:
    """The report in SQL: a distance is a sum over components; a round is two tables."""
    steps = [
        f"kept AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, v FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({STEPS} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))",
        f"flat AS (SELECT r, unnest(range(1, {DIM} + 1)) AS j, unnest(v) AS x FROM kept)",
        f"starts AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept QUALIFY c < {CENTROIDS})",
        f"c0 AS (SELECT c, unnest(range(1, {DIM} + 1)) AS j, unnest(v) AS x FROM starts)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"d{i} AS (SELECT r, c, sum((f.x - c{i}.x) * (f.x - c{i}.x))::BIGINT AS d FROM flat f JOIN c{i} USING (j) GROUP BY r, c)")
        steps.append(f"a{i} AS (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < ROUNDS:
            steps.append(f"m{i} AS (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM flat JOIN a{i} USING (r) GROUP BY c, j)")
            steps.append(f"c{i + 1} AS (SELECT c, j, CASE WHEN n IS NULL THEN x ELSE s // n - CASE WHEN s < 0 AND s % n <> 0 THEN 1 ELSE 0 END END AS x FROM c{i} LEFT JOIN m{i} USING (c, j))")
    steps.append(f"final AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256"
        f" FROM a{ROUNDS} JOIN kept USING (r) JOIN final USING (c)"
    )


CLUSTER_SQL = _oracle()
