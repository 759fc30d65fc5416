"""Exact deduplication by progressive refinement: length, then a hash of a prefix, then a hash of everything.

All of it is expressions of Spark's own; no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bitmap, cut, lookup, maybe_in, wrapped

#: Characters of the normalised text that the second of the three tests hashes.
PREFIX = 128


def normalised(text: Column) -> Column:
    """The text without its blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(normalised(text).cast("binary"), 256)


def points(text: Column) -> Column:
    """Code points of the original text."""
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def outlined(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with __len, bytes of the normalised text, and __prefix, a hash of its first characters."""
    norm = normalised(text)
    return df.withColumns({"__len": F.octet_length(norm), "__prefix": F.xxhash64(F.substring(norm, 1, PREFIX))})


def survivors(rows: DataFrame) -> DataFrame:
    """(__len, __prefix) that two or more of ``rows``, which are outlined, have. Lengths that occur once fall away before prefixes are looked at."""
    counted = cut(rows.groupBy("__len", "__prefix").count())
    lengths = counted.groupBy("__len").agg(F.sum("count").alias("__n")).where("__n > 1").select("__len")
    return cut(counted.join(lengths, "__len", "left_semi").where("count > 1").select("__len", "__prefix"))


def among(rows: DataFrame, alive: DataFrame) -> DataFrame:
    """The outlined rows whose outline is in ``alive``. If that is too large to broadcast, a bitmap of it is, and a few rows more
    pass; no text is shuffled either way."""
    keys = ["__len", "__prefix"]
    if alive.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(alive), keys, "left_semi")
    return maybe_in(rows, cut(bitmap(alive, keys)), keys)


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    rows = outlined(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), F.col("__text"))
    alive = survivors(rows)
    full = among(rows, alive).select("__id", points(F.col("__text")).alias("__points"), digest(F.col("__text")).alias("text_sha256"))
    # a row's rank: more code points first, then the smaller id, null ids last
    rank = F.struct((-F.col("__points")).alias("p"), F.col("__id").isNull().alias("n"), F.col("__id").alias("i"))
    best = full.groupBy("text_sha256", "__points", "__id").agg(F.count("*").alias("__n")).groupBy("text_sha256").agg(
        F.min(F.struct(rank.alias("r"), F.col("__n").alias("n"))).alias("__best"), F.sum("__n").alias("group_size")
    )
    found = cut(best.where("group_size > 1").select("text_sha256", F.col("__best.r.i").alias("keep_id"), (-F.col("__best.r.p")).alias("keep_points"), "group_size", F.col("__best.n").alias("n_keep")))
    return found, alive


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each set of two or more equal texts: text_sha256, keep_id, keep_points, group_size, n_keep.

    The first pass reads lengths and hashes of prefixes and sends on one counter for each length and prefix. Only rows
    whose length and prefix occur twice are hashed in full. keep_points and keep_id belong to the row that stays: most code points, then
    smallest id (null ids last); n_keep says how many rows tie for that, which happens only if an id repeats.
    """
    return _groups(docs, id_col, text_col)[0]


def _one_of_ties(rows: DataFrame, sha: str) -> DataFrame:
    """(sha, __first): a row of each group in ``rows``, minima of whose numbers are built before the shuffle."""
    return rows.groupBy(sha).agg(F.min("__number").alias("__first"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: the id, keep_id, group_size (long), kept, text_sha256.

    A null text is an empty one; texts of blanks only equal it. Rows that repeat an id are rows of their own: of those
    that tie for staying, exactly one has kept = true. A null id can stay only if no other row of the group ranks before
    it. Empty input gives no rows; other columns are ignored.
    """
    found = groups(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("__id"), points(F.col(text_col)).alias("__points"), digest(F.col(text_col)).alias("text_sha256"))
    tied = found.where("n_keep > 1")
    ties = bool(tied.limit(1).count())
    if ties:
        rows = cut(rows.withColumn("__number", F.monotonically_increasing_id()))
    rows = lookup(rows, found, ["text_sha256"])
    single = F.col("group_size").isNull()
    wins = single | (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__points") == F.col("keep_points")))
    rows = rows.withColumns({"__wins": wins, "keep_id": F.when(single, F.col("__id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1)).cast("long")})
    if ties:
        first = cut(_one_of_ties(rows.where("__wins and n_keep > 1"), "text_sha256"))
        rows = lookup(rows, first, ["text_sha256"]).withColumn("__wins", F.col("__wins") & (F.col("__first").isNull() | (F.col("__number") == F.col("__first"))))
    return rows.select(F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__wins").alias("kept"), "text_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the choice is that of ``decisions``, and of rows that tie in id and
    text any one stays. Only texts whose outline occurs twice are hashed in full. Rows are joined to at most
    BROADCAST_ROWS groups without a shuffle; beyond that they are shuffled once.
    """
    found, alive = _groups(docs, id_col, text_col)
    rows = wrapped(docs)
    text, own = F.col("__row")[text_col], F.col("__row")[id_col]
    rows = lookup(outlined(rows, text), alive.withColumn("__alive", F.lit(True)), ["__len", "__prefix"])
    rows = rows.withColumns({"__sha": F.when(F.col("__alive"), digest(text)), "__points": points(text)}).drop("__len", "__prefix", "__alive")
    rows = lookup(rows, found.select(F.col("text_sha256").alias("__sha"), "keep_id", "keep_points", "n_keep"), ["__sha"])
    rows = rows.where(F.col("n_keep").isNull() | (own.eqNullSafe(F.col("keep_id")) & (F.col("__points") == F.col("keep_points"))))
    if found.where("n_keep > 1").limit(1).count():
        tied = F.coalesce(F.col("n_keep") > 1, F.lit(False))
        rows = rows.where(~tied).select("__row").unionByName(rows.where(tied).dropDuplicates(["__sha"]).select("__row"))
    return rows.select("__row.*")
