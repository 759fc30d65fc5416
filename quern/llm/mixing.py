"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, arrow_function, cut, lookup, prefix_sums, range_starts, wrapped

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def _measured(texts: pa.Array) -> pa.Array:
    raw = [b or b"" for b in texts.cast(pa.large_binary()).to_pylist()]
    return pa.StructArray.from_arrays([pa.array([len(b.split()) for b in raw], pa.int64()), pa.array([hashlib.md5(b).hexdigest() for b in raw], pa.string())], ["size", "md5"])


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """``docs`` with __size (words), __order (the shuffle: an MD5 of seed, id and text), __u (its first 32 bits), __source."""
    measure = arrow_function(docs, _measured, "struct<size:bigint,md5:string>")
    seen = docs.withColumn("__m", measure(text_col))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("__m.md5")).cast("binary"))
    seen = seen.withColumns({"__size": F.col("__m.size"), "__order": order, "__source": F.col(source_col)}).drop("__m")
    return seen.withColumn("__u", F.conv(F.substring("__order", 1, 8), 16, 10).cast("long"))


def targets(rows: DataFrame, budget: float, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row for each source of ``rows`` (__source, __words): __source, __rank, __source_size, __target.

    Sources by code point, null last, take the weights in turn and divide the budget. No target
    passes ``cap`` times its source's size; what is left over is divided anew by weight. That ends at one common
    level: a source has level * weight, or its cap if that is less. Sorted by cap / weight, the capped sources stand first.
    The two windows are over sources, a row of some 50 bytes each, in one task, as ranks and levels depend on all of them.
    """
    sums = cut(rows.groupBy("__source").agg(F.sum("__words").alias("__source_size")))
    by_name = Window.orderBy(F.col("__source").isNull(), "__source")
    ranked = sums.withColumn("__rank", F.row_number().over(by_name)).withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") - 1) % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("__cap", (cap * F.col("__source_size")).cast("double"))
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    ranked = ranked.withColumns({
        "__caps": F.coalesce(F.sum("__cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "__rest": F.sum("__w").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
    })
    ranked = cut(ranked.withColumn("__full", F.col("__cap") <= (F.lit(budget) - F.col("__caps")) / F.col("__rest") * F.col("__w")))
    caps, rest = ranked.agg(F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0.0)), F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("__w")))).first()
    level = (budget - caps) / rest if rest else 0.0
    return ranked.select("__source", "__rank", "__source_size", F.when(F.col("__full"), F.col("__cap")).otherwise(F.lit(level) * F.col("__w")).alias("__target"))


def _entries(queued: DataFrame, parts: int) -> DataFrame:
    """An entry for each copy of a row and each pass over its source: f, the virtual finish time; what orders entries of equal time (rank,
    pass, order, task, copy); c, the source's words up to it; s, its words; and the part of time it falls in."""
    each = queued.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("j")).withColumn("c", F.col("__before") + F.col("j") * F.col("__size"))
    again = F.when(F.col("__target") > F.col("__source_size"), (F.col("__source_size") + F.col("c")) / F.col("__target"))
    passes = F.array(F.struct((F.col("c") / F.col("__target")).alias("f"), F.lit(1).alias("k")), F.struct(again.alias("f"), F.lit(2).alias("k")))
    found = each.select(F.explode(passes).alias("e"), F.col("__rank").alias("r"), F.col("__order").alias("o"), F.col("__task").alias("t"), "j", "c", F.col("__size").alias("s"))
    found = found.select("e.*", "r", "o", "t", "j", "c", "s").where("f is not null")
    return found.withColumn("part", F.floor(F.least(F.col("f"), F.lit(2.0)) * parts).cast("long"))


def _that_fit(entries: DataFrame, budget: float) -> DataFrame:
    """The entries, in order of finish time over all sources, up to where the budget is used up.

    Sums over parts of time come first: a row for each part, in one task, as many as there are BUCKET_ROWS entries. Only the part in which
    the budget ends is then sorted, in one task too; it has BUCKET_ROWS entries on average, as hashes order the documents.
    """
    place = F.struct("f", "r", "k", "o", "t", "j")
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = entries.groupBy("part").agg(F.sum("s").alias("s")).withColumn("c", F.sum("s").over(up_to))
    over = sums.where(F.col("c") > budget).orderBy("part").limit(1).first()
    if over is None:
        return entries
    inside = Window.orderBy("f", "r", "k", "o", "t", "j").rowsBetween(Window.unboundedPreceding, 0)
    fits = entries.where(F.col("part") == over["part"]).withColumn("c", F.sum("s").over(inside)).where(F.col("c") + (over["c"] - over["s"]) <= budget)
    last = fits.agg(F.max(place).alias("last")).first()["last"]
    before = F.col("part") < over["part"]
    if last is None:
        return entries.where(before)
    kinds = dict(entries.dtypes)
    end = F.struct(*(F.lit(last[n]).cast(kinds[n]).alias(n) for n in ("f", "r", "k", "o", "t", "j")))
    return entries.where(before | ((F.col("part") == over["part"]) & (place <= end)))


def _ends(queued: DataFrame, fits: DataFrame, goal: DataFrame) -> DataFrame:
    """A row for each source: __source, __source_size, __target, and for both passes the order up to which the mix takes documents (__o1, __o2),
    how many rows of just this order it takes (__m1, __m2), and how many there are (__all1, __all2)."""
    last = cut(fits.groupBy("r", "k").agg(F.max(F.struct("o", "c")).alias("m")).select(F.col("r").alias("__rank"), "k", F.col("m.o").alias("__order"), F.col("m.c").alias("c")))
    own = queued.select("__rank", "__order", "__before", "__size", "__n")
    tied = lookup(own, last.select("__rank", "__order").distinct(), ["__rank", "__order"], "left_semi")
    tied = cut(tied.groupBy("__rank", "__order").agg(F.min("__before").alias("before"), F.max("__size").alias("size"), F.sum("__n").alias("all")))
    ends = last.join(tied, ["__rank", "__order"]).withColumn("m", F.expr("(c - before) div size"))
    of = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    ends = ends.groupBy("__rank").agg(*(of(k, c).alias(f"{n}{k}") for k in (1, 2) for c, n in (("__order", "__o"), ("m", "__m"), ("all", "__all"))))
    return cut(lookup(goal, ends, ["__rank"]).drop("__rank"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs``, whose columns must not have these names, with __size, __source_size, __target, __copies (0, 1 or 2).

    Each source's documents, shuffled by a hash of seed, id and text, queue up; a document's virtual finish time is
    the sum of its source's words up to it divided by the source's target, and a source whose target exceeds its size
    is queued twice. The queue of all sources, in order of finish time, is cut where the budget is used up, so a source
    ends within a document of its target. Sums over sources and over ranges of time come first, then rows inside a range; rows of equal id and text are
    counted by task first: no source and no group of copies, however hot, meets in one task.

    As finish times grow in the order of the hashes, all that is kept of the queue is where it ends in each source. With that, which is broadcast, each
    row of ``docs`` tells by its own hash how often it is taken, and is not shuffled (but for rows of equal id and text of which only some are taken).
    Null texts have size 0 and are never taken; a null source is a source; rows that repeat each count; empty input gives no rows.
    """
    narrow = sized(docs.select(id_col, source_col, text_col), id_col, source_col, text_col, seed).select("__source", "__size", "__order", "__u", F.spark_partition_id().alias("__task"))
    narrow = cut(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("__n")).withColumn("__words", F.col("__size") * F.col("__n")))
    n, words = narrow.agg(F.count("*"), F.sum("__words")).first()
    budget = share * (words or 0)
    goal = targets(narrow, budget, weights, cap)
    starts = range_starts(narrow, ["__source"], "__u", "__words", n)
    queued = lookup(prefix_sums(narrow, starts, ["__source"], "__u", ["__order", "__task"], "__words", "__sum", n), goal, ["__source"])
    queued = cut(queued.where("__size > 0 and __target > 0").select("__rank", "__source_size", "__target", "__order", "__task", "__size", "__n", (F.col("__sum") - F.col("__words")).alias("__before")))
    ends = _ends(queued, _that_fit(_entries(queued, max(1, -(-2 * n // BUCKET_ROWS))), budget), goal)
    rows = lookup(sized(docs, id_col, source_col, text_col, seed), ends, ["__source"])
    some = [F.coalesce((F.col("__order") == F.col(f"__o{k}")) & (F.col(f"__m{k}") < F.col(f"__all{k}")), F.lit(False)) for k in (1, 2)]
    whole = [F.coalesce((F.col("__size") > 0) & (F.col("__order") <= F.col(f"__o{k}")), F.lit(False)) & ~s for k, s in zip((1, 2), some, strict=True)]
    rows = rows.withColumn("__copies", whole[0].cast("int") + whole[1].cast("int"))
    if ends.where("__m1 < __all1 or __m2 < __all2").limit(1).count():
        number = F.row_number().over(Window.partitionBy("__source", "__order").orderBy("__size"))
        few = rows.where(some[0] | some[1]).withColumn("__number", number)
        more = [(s & (F.col("__number") <= F.col(f"__m{k}"))).cast("int") for k, s in zip((1, 2), some, strict=True)]
        rows = rows.where(~(some[0] | some[1])).unionByName(few.withColumn("__copies", F.col("__copies") + more[0] + more[1]).drop("__number"))
    return rows.drop("__order", "__u", "__source", *(f"__{c}{k}" for c in ("o", "m", "all") for k in (1, 2)))


def table_of(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of ``docs``: id, size, source_size, target, taken."""
    rows = mixed(docs.select(id_col, source_col, text_col), id_col, source_col, text_col, **options)
    return rows.select(id_col, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``; a document that is taken twice is there twice."""
    row = F.col("__row")
    rows = wrapped(docs).select("__row", row[id_col].alias("id"), row[source_col].alias("source"), row[text_col].alias("text"))
    rows = mixed(rows, "id", "source", "text", **options).where("__copies > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
