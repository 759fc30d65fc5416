"""Placement of documents on shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, wrapped

SLOTS = 65_537
SHARDS = 64


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of each slot.

    Every shard has its own permutation of the slots, offset + i * skip (mod slots), from a digest of its name. The
    shards take turns; each claims the next slot of its permutation that is still free. All shards end with equally
    many slots, give or take one, and a shard that leaves moves few slots between the others.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not _prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime number, not below the number of shards")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in digests]
    owner = [-1] * slots
    claimed = 0
    while claimed < slots:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            owner[place[i]] = i
            claimed += 1
            if claimed == slots:
                break
    return np.array(owner, dtype=np.int32)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of its MD5, modulo the number of slots; a null key is the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` (int) and ``shard`` (string) behind its own columns.

    The table has ``slots`` rows whatever the size of ``docs``, so it is always broadcast and no row is shuffled.
    Null keys share one slot, repeated keys share theirs, empty input gives no rows. If ``docs`` has a column slot or shard
    itself, that stays as it is and the new one has an underscore behind its name.
    """
    names = shards if shards is not None else [f"shard-{i:03d}" for i in range(SHARDS)]
    owner = lookup_table(names, slots)
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, names[s]) for i, s in enumerate(owner.tolist())], "__slot int, __shard string")
    rows = wrapped(docs).withColumn("__own", slot_of(F.col("__row")[key], slots))
    slot, shard = (free_name(c, docs.columns) for c in ("slot", "shard"))
    return rows.join(F.broadcast(table), rows["__own"] == table["__slot"], "left").select("__row.*", F.col("__own").alias(slot), F.col("__shard").alias(shard))


def write(docs: DataFrame, path: str, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> None:
    """Write whole rows of ``docs`` as Parquet under ``path``, a folder for each shard, without a shuffle: a task writes one file for each
    shard that it has rows of. The folders' names hold the shard, so rows read back have it as a column."""
    placed = place(docs, key, shards, slots)
    slot, shard = placed.columns[-2:]
    placed.drop(slot).write.partitionBy(shard).parquet(path)
