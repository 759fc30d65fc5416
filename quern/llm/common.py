"""What the corpus operators share: tables, lineage cuts, size-checked joins, exact distributed prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.lineage import cut, shared_folder  # noqa: F401

#: Words are separated by space, tab, line feed, vertical tab, form feed and carriage return. ``bytes.split()`` splits
#: at these six and no others, so operators split the UTF-8 bytes of a text.
#: A side is broadcast only when it was counted and has no more rows than this; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of one Arrow batch of texts.
BATCH_BYTES = "4194304b"
#: A bitmap's rows and 64-bit words in a row.
MAP_ROWS, MAP_WORDS = 1 << 12, 1 << 9
#: Rows that one bucket of a distributed prefix sum holds on average.
BUCKET_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``small`` (cheap to count, unique by ``keys``) to ``big``; nulls in the keys match each other.

    ``small`` is broadcast if it has at most ``most`` rows. A larger one is joined by a shuffle, whose skewed
    partitions Spark's adaptive execution splits.
    """
    renamed = small.select(*(F.col(c).alias(f"__small_{c}" if c in keys else c) for c in small.columns))
    if renamed.limit(most + 1).count() <= most:
        renamed = F.broadcast(renamed)
    on = reduce(lambda x, y: x & y, (big[k].eqNullSafe(renamed[f"__small_{k}"]) for k in keys))
    return big.join(renamed, on, how).drop(*(f"__small_{k}" for k in keys))


def wrapped(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as one struct, ``__row``. Operators put their own columns beside it and select ``__row.*`` in the end, so no
    name of theirs can meet one of ``docs``."""
    return docs.select(F.struct("*").alias("__row"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as keep it apart from ``taken`` in any case of letters."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def bitmap(df: DataFrame, keys: list[str]) -> DataFrame:
    """A map of 2**27 bits in which each row's keys have set one: 16 MB in 4096 rows, whatever the number of keys."""
    h = F.xxhash64(*keys)
    used = df.select(_map_row(h).alias("__at"), _map_word(h).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), _map_bit(h)).alias("b"))
    none = df.sparkSession.range(MAP_ROWS * MAP_WORDS).select(F.expr(f"id % {MAP_ROWS}").alias("__at"), F.expr(f"id div {MAP_ROWS}").alias("w"), F.lit(0).cast("long").alias("b"))
    words = used.unionByName(none).groupBy("__at", "w").agg(F.bit_or("b").alias("b"))
    return words.groupBy("__at").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("__bits"))


def maybe_in(df: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose keys have their bit set in ``marked`` (a ``bitmap``): all whose keys were put in, and few others while
    the map is not full. The map is broadcast; nothing of ``df`` is shuffled."""
    h = F.xxhash64(*keys)
    hit = F.call_function("shiftrightunsigned", F.element_at("__bits", (_map_word(h) + 1).cast("int")), _map_bit(h)).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(marked), _map_row(h) == F.col("__at")).where(hit).drop("__at", "__bits")


def _map_row(h: Column) -> Column:
    return h.bitwiseAND(F.lit(MAP_ROWS - 1))


def _map_word(h: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, F.lit(12)).bitwiseAND(F.lit(MAP_WORDS - 1))


def _map_bit(h: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, F.lit(21)).bitwiseAND(F.lit(63)).cast("int")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of texts, for the session, unless the user has set a bound. Spark's own bound of 64 MB is met several
    times over in a task, as buffers grow by doubling and Python holds words beside bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def arrow_function(df: DataFrame, fn: Callable[..., pa.Array], schema: str):
    """``fn`` over Arrow arrays as a column function. Spark must not call it again for each use of its result, hence
    nondeterministic."""
    small_batches(df.sparkSession)
    return F.arrow_udf(fn, schema).asNondeterministic()


def arrow_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """``fn`` turns each Arrow batch into columns (a dict of lists or arrays); batches are bounded by Spark in rows and bytes."""
    small_batches(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def range_of(u: str, rows: int) -> Column:
    """Which range of about BUCKET_ROWS rows a row falls in; ``u`` is a long from 0 to 2**32 - 1, spread evenly."""
    n = max(1, -(-rows // BUCKET_ROWS))
    return F.expr(f"cast(floor({u} * {n}D / 4294967296D) as int)")


def range_starts(df: DataFrame, group: list[str], u: str, value: str, rows: int) -> DataFrame:
    """The sum of ``value`` before each range of ``u`` in each group: as many rows as there are ranges with rows."""
    sums = df.withColumn("__range", range_of(u, rows)).groupBy(*group, "__range").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return cut(sums.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total"))


def prefix_sums(df: DataFrame, starts: DataFrame, group: list[str], u: str, ties: list[str], value: str, out: str, rows: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group up to this one, in the order of (u, ties).

    ``starts`` comes from ``range_starts`` over the same rows. A group of any size is spread over many tasks: sums of
    ranges are added up first, then rows inside each range. No row is dropped and sums are exact.
    """
    df = df.withColumn("__range", range_of(u, rows))
    inside = Window.partitionBy(*group, "__range").orderBy(u, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return lookup(df, starts, [*group, "__range"]).withColumn(out, F.col("__before") + F.sum(value).over(inside)).drop("__before", "__range")
