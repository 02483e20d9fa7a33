"""Mixing sources to target weights.

Each document gets a hash-random key; documents are ranged by it within their source, prefix sums of their
sizes are taken over ranges of keys first and within each range then, and the mix is cut where a source's
budget ends. A budget beyond the source's size repeats the source, whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.llm.common import free_name, require_free

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source that a window task may hold, on average.
ROWS_PER_RANGE = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Water-filling of all sources' sizes over their weights.

    sizes: one row a source (``source``, ``source_size``); weights repeat over the sources by code point, null
    last. A target is the lesser of ``cap`` times the source's size and its weight's share of what the capped
    sources leave; that is where resharing the excess by weight again and again ends. The number of sources is
    the only thing that this window holds.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("long"))
    ranked = (
        ranked.withColumn("ceiling", F.col("source_size") * cap)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("ceiling").over(before), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(after))
        # in order of ceiling by weight, a source is capped iff its share of what is left lies above its ceiling
        .withColumn("capped", F.col("left") * F.col("weight") >= F.col("ceiling") * F.col("shares"))
    )
    open_ = F.when(~F.col("capped"), F.struct((-F.col("shares")).alias("k"), "left", "shares"))
    level = F.min(open_).over(every)
    share = (level["left"] * F.col("weight")).cast("double") / level["shares"].cast("double")
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("ceiling").cast("double")).otherwise(share)).select("source", "source_size", "target")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_range: int = ROWS_PER_RANGE,
    keep: list[str] | None = None,
    name: str = "mix",
) -> DataFrame:
    """The columns of ``docs`` (those in ``keep``, if given) and ``name``, a struct of size, source_size, target, epochs, in_cut and taken.

    size counts the words of the text (null or empty: 0). epochs counts the whole passes over the source;
    in_cut is true for documents that begin before the last, partial pass ends; taken counts the document's
    words in the mix, the last document of the partial pass in part, so that a source gives its target to the
    word. A null source is a source. The key is a hash of id and text: equal rows get equal keys, and ties are
    equal in all that decides, so reruns agree. No rows give no rows. Columns of docs keep their names; a kept column
    called like ``name`` is an error.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))))
    kept = [c for c in docs.columns if keep is None or c in keep]
    require_free(docs.select(*kept), name)
    rows = docs.select(F.struct(*kept).alias("row"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    return _cut(rows, weights, cap, rows_per_range).select("row.*", F.struct("size", "source_size", "target", "epochs", "in_cut", "taken").alias(name))


def _range_of(ranges: int) -> Column:
    """The key's range: its first 31 bits, dealt into equal parts."""
    return F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int")


def _cut(rows: DataFrame, weights: tuple[int, ...], cap: int, rows_per_range: int) -> DataFrame:
    n = rows.select("source").count()
    ranges = max(64, -(-n // rows_per_range))
    rows = rows.withColumn("range", _range_of(ranges))
    totals = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    above = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("words").over(above), F.lit(0)))
    sizes = totals.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, cap)
    ledger = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.col("o.source").alias("l_source"), F.col("o.range").alias("l_range"), "offset", "source_size", "target"
    )
    within = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(ledger, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("range") == F.col("l_range")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    before = F.col("offset") + F.col("inner")
    rest = budget - F.col("epochs") * F.col("source_size") - before
    return (
        joined.withColumn("epochs", epochs)
        .withColumn("in_cut", (rest > 0) & (F.col("size") > 0))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.least(rest, F.col("size")), F.lit(0)))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once for every pass that takes it, whole, with the columns of docs.

    The one document of a source that its cut divides is kept whole, so a source may run over its target by
    less than that document.
    """
    name = free_name(docs, "mix")
    mixed = mix_sources(docs, name=name, **options)
    times = F.col(f"{name}.epochs") * F.when(F.col(f"{name}.size") > 0, 1).otherwise(0) + F.col(f"{name}.in_cut").cast("long")
    return mixed.withColumn(name, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).drop(name)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix_sources(docs, keep=["doc_id"], **options).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


#: The same rows in DuckDB.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
f AS (SELECT *, 3 * source_size AS ceiling,
        (sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
        (sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS shares FROM w),
c AS (SELECT *, rest * weight >= ceiling * shares AS capped FROM f),
o AS (SELECT arg_max(rest, shares) AS rest, max(shares) AS shares FROM c WHERE NOT capped),
t AS (SELECT c.source, source_size, CASE WHEN capped THEN ceiling::DOUBLE
        ELSE (o.rest * weight)::DOUBLE / o.shares::DOUBLE END AS target FROM c LEFT JOIN o ON true),
p AS (SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(least(budget - epochs * source_size - before, size), 0))::BIGINT AS taken FROM e
"""
