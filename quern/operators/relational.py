"""Filters, limits, merges and counts over catalogs. Plain DataFrame operations, so Catalyst pushes and prunes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import all_of
from quern.operators.lineage import cut


def where(df: DataFrame, **predicates) -> DataFrame:
    """Rows that meet all given predicates: equality, or membership for a list; None is no predicate."""
    return df.where(all_of(predicates))


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


def latest(df: DataFrame, limit: int, time: str, key: str) -> DataFrame:
    """The ``limit`` newest rows, ties by key; all rows if ``limit`` is not positive."""
    return df if limit <= 0 else df.orderBy(F.col(time).desc(), key).limit(limit)


def one(df: DataFrame, **key):
    """The row with this key; KeyError if there is none."""
    found = where(df, **key).take(1)
    if not found:
        raise KeyError(", ".join(f"{k}={v!r}" for k, v in key.items()))
    return found[0]


def merge_pages(df: DataFrame, key: str, page: str, *order: str) -> DataFrame:
    """One row for each key, that of the last page; ``order`` decides inside a page."""
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(page, *order))
    return df.groupBy(key).agg(last.alias("__row")).select(key, "__row.*")


def merge_maps(*maps: Column) -> Column:
    """Union of map columns by key; the last one that has a key wins. Independent of the session's policy for repeated keys."""

    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(two, maps)


def all_match(df: DataFrame, predicate: Column | None = None, name: str = "all_match", **more: Column) -> DataFrame:
    """Whether every row meets the predicate; true without rows. Further predicates, by name, are tested in the same pass."""
    named = ({} if predicate is None else {name: predicate}) | more
    return df.agg(*(F.coalesce(F.bool_and(p), F.lit(True)).alias(n) for n, p in named.items()))


def first_by(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """The row whose ``column`` comes first; ``ties`` decide between equal ones."""
    return df.orderBy(column, *ties).limit(1)


def count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def row_numbers(df: DataFrame, order: str, name: str = "message_id") -> DataFrame:
    """Numbers from 1 in the order of ``order`` (unique), as text, without one task for all rows."""
    return places(df, order).withColumn(name, (F.col("__place") + 1).cast("string")).drop("__place")


def places(df: DataFrame, *order: str) -> DataFrame:
    """Add ``__place``: each row's number from 0 in the order of ``order``."""
    rows = ranged(df, *order)
    before, total = [], 0
    for part, n in sorted(map(tuple, rows.groupBy("__part").count().collect())):
        before.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(before, "__part int, __before bigint")
    return rows.join(F.broadcast(starts), "__part").withColumn("__place", F.col("__before") + F.col("__place")).drop("__part", "__before")


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """The rows, sorted by range and cut, with __part, the range's number, and __place, the place in it. What runs over all rows in order can run
    over ranges, and needs one row or number of each range for the rest: no task gets all rows of a key, and rows are shuffled once."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(rows.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))


def with_previous(df: DataFrame, *order: str) -> DataFrame:
    """``ranged`` rows and ``__previous``, the row before in the order of ``order`` as a struct (null for the first of all). The window that hands on the
    ranges' last rows is over as many rows as there are ranges."""
    rows = ranged(df, *order)
    last = rows.groupBy("__part").agg(F.max_by(F.struct(*df.columns), "__place").alias("__last"))
    last = last.withColumn("__last", F.lag("__last").over(Window.orderBy("__part")))
    inside = F.lag(F.struct(*df.columns)).over(Window.partitionBy("__part").orderBy("__place"))
    return rows.join(F.broadcast(last), "__part").withColumn("__previous", F.coalesce(inside, "__last")).drop("__last")


def running_sum(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` (long) over ``ranged`` rows up to each, in their order over all ranges."""
    sums = rows.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(sums.select("__part", before.alias("__before"))), "__part").withColumn(name, F.col("__before") + inside).drop("__before")
