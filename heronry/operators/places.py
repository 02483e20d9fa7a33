"""Numbers of rows within their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.sources.tables import cut

#: Rows of a group that one task numbers.
MOST = 1_000_000


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str, most: int = MOST) -> DataFrame:
    """rows with ``name``, their numbers from 1 within a group by an order that is total in it (equal rows apart).

    A group of up to ``most`` rows is numbered by a window. Larger ones are cut into ranges of (keys, order), which are
    sorted: a row's number is the count of its group's rows in earlier ranges, which is a sum over ranges, and its place
    among its group's rows in its own. How many ranges there are follows from the rows, not from ``most`` alone.
    Groups are told apart by a count first; keys may be null.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    wide = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    total = wide.agg(F.sum("__n")).first()[0]
    if not total:
        return rows.withColumn(name, F.row_number().over(window))
    named = cut(wide, "wide-groups").select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    few = rows.join(named, same, "left_anti").withColumn(name, F.row_number().over(window))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2 * total // MOST, min(2 * total // most, spread)) + 1
    ranged = rows.join(named, same, "left_semi").repartitionByRange(int(parts), *keys, *order).sortWithinPartitions(*keys, *order)
    # written, so that a range and a row's place in it are the same for all that follows
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__seat", F.monotonically_increasing_id()), "ranges")
    counts = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__seat").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), (before - F.col("__first") + 1).alias("__before"))
    # written, as its size tells whether each task can have it whole
    many = ranged.join(cut(offsets, "offsets"), same & (F.col("__part") == F.col("__p")))
    many = many.withColumn(name, (F.col("__before") + F.col("__seat")).cast("int")).select(*rows.columns, name)
    return few.unionByName(many)


def free_numbers(rows: DataFrame, held: DataFrame | None, keys: list[str], order: list[Column], name: str, start: int = 0, most: int = MOST) -> DataFrame:
    """rows with ``name``: of the numbers from ``start`` on that nobody holds in their group, the k-th goes to the k-th row.

    held: keys and ``name``, distinct, or none if nobody holds any; numbers below start and null ones count for nothing. A held number is put behind as
    many rows as there are free numbers below it; in that common order rows and held numbers stand at their own numbers.
    No number that is not held or given is ever made, and groups may be of any size. Keys may be null.
    """
    if held is None:
        return numbered(rows, keys, order, name, most).withColumn(name, (F.col(name) + (start - 1)).cast("long"))
    own = [c for c in rows.columns if c not in keys]
    asking = rows.select(*keys, F.lit(1).alias("__kind"), F.lit(None).cast("long").alias("__at"), F.struct(*own, *(c.alias(f"__o{i}") for i, c in enumerate(order))).alias("__row"))
    holding = held.filter(F.col(name) >= start).select(*keys, F.lit(0).alias("__kind"), F.col(name).cast("long").alias("__at"))
    both = cut(asking.unionByName(holding, allowMissingColumns=True), "numbers")
    places = [F.col("__at"), *(F.col(f"__row.__o{i}") for i in range(len(order)))]
    both = numbered(both, [*keys, "__kind"], places, "__k", most)
    # free numbers below a held one, rows before a row
    both = both.withColumn("__v", F.coalesce(F.col("__at") - start, F.lit(0)) - F.when(F.col("__kind") == 0, F.col("__k") - 1).otherwise(1 - F.col("__k")))
    both = numbered(both, keys, [F.col("__v"), F.col("__kind"), F.col("__k")], "__n", most)
    given = both.filter("__kind = 1")
    return given.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in own), (F.col("__n") + (start - 1)).cast("long").alias(name))
