"""Near-duplicate groups from SimHash fingerprints, with pigeonring filtering of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_function, arrow_rows, cut, lookup, wrapped
from .components import components, forest

SHINGLE = 3
SEED = 42
BITS = 64
DISTANCE = 3
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
#: Shingles hashed at once; bounds memory for very long texts.
CHUNK = 1 << 16
#: Fingerprints of a bucket that one task compares with each other; a larger bucket is dealt out in blocks of this size.
BLOCK = 2048


def fingerprint(text: str | bytes | None) -> int:
    """Bit b is set if it is set in over half of the XXH64 values of the text's shingles of three words.

    A-Z are lowered; fewer than three words are one shingle; no words at all give 0.
    """
    b = text.encode() if isinstance(text, str) else text or b""
    words = b.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    ones = np.zeros(BITS, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for i in range(0, n, CHUNK):
        part = words[i : min(i + CHUNK, n) + SHINGLE - 1]
        hashes = np.array([digest(join(s), SEED) for s in zip(part, part[1:], part[2:])], dtype="<u8")
        # unpacked bits run from the least significant byte, in each byte from the lowest bit: bit number = column
        ones += np.add.reduce(np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS), axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long; null counts as empty."""

    def one(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(0), "fp": [signed(fingerprint(b)) for b in batch.column(1).cast(pa.large_binary()).to_pylist()]}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_rows(docs.select(id_col, text_col), one, f"`{id_col}` {kind}, fp bigint")


def segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(WIDTH * (i % SEGMENTS))) & np.uint64((1 << WIDTH) - 1)


def chains(a: np.ndarray, b: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``a`` and ``b`` whose differences along the ring from segment ``start`` stay in budget.

    Of 3 differing bits in 4 segments, some start exists from which every chain of l segments differs in at most
    3 l / 4 bits: 0, 1, 2 and 3. The full distance is taken only of pairs that pass the shorter chains.
    """
    one = np.bitwise_count(segment(a, start)[:, None] ^ segment(b, start)[None, :])
    two = one + np.bitwise_count(segment(a, start + 1)[:, None] ^ segment(b, start + 1)[None, :])
    i, j = np.nonzero((one == 0) & (two <= DISTANCE * 2 // SEGMENTS))
    three = two[i, j] + np.bitwise_count(segment(a[i], start + 2) ^ segment(b[j], start + 2))
    ok = three <= DISTANCE * 3 // SEGMENTS
    i, j = i[ok], j[ok]
    ok = np.bitwise_count(a[i] ^ b[j]) <= DISTANCE
    return i[ok], j[ok]


def _linked(nodes: np.ndarray, fps: np.ndarray, start: int, split: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of nodes) of one bucket; with ``split`` only pairs of the first ``split`` fingerprints and the rest."""
    n = len(fps)
    if split:
        links = []
        for a in range(0, split, 512):
            i, j = chains(fps[a : min(a + 512, split)], fps[split:], start)
            links.append((i + a, j + split))
    else:
        links = []
        for a in range(0, n, 512):
            i, j = chains(fps[a : a + 512], fps[a:], start)
            links.append((i[i < j] + a, j[i < j] + a))
    i, j = forest(links, n)
    return nodes[i], nodes[j]


def links(reps: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of ``reps`` (fp, node; no fp twice) that connect all within distance 3.

    A pair in budget from segment i has equal segments i, and segments i + 1 that differ in one bit at most, so one half of
    that segment is equal too. That is the key: 4 starts times 2 halves, 8 rows of a few bytes for each
    different fingerprint, whatever the number of its copies. Buckets are compared in numpy; each yields a spanning forest
    and never all pairs. Buckets over BLOCK fingerprints are dealt out in pairs of blocks, so no task gets a large one.
    """
    half = WIDTH // 2
    keys = []
    for i in range(SEGMENTS):
        seg = F.expr(f"shiftrightunsigned(fp, {WIDTH * i}) & {(1 << WIDTH) - 1}L")
        k = (i + 1) % SEGMENTS
        for h in range(2):
            part = F.expr(f"shiftrightunsigned(fp, {WIDTH * k + half * h}) & {(1 << half) - 1}L")
            keys.append((F.lit(2 * i + h).cast("long") * (1 << (WIDTH + half)) + seg * (1 << half) + part).cast("int"))
    keyed = reps.select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    sizes = cut(keyed.groupBy("key").count().where("count > 1"))
    large = sizes.where(F.col("count") > BLOCK)
    some = keyed.join(sizes.select("key", "count"), "key")
    usual = some.where(F.col("count") <= BLOCK).select("key", "fp", "node")
    found = _compare(usual.repartition("key").sortWithinPartitions("key"))
    if large.limit(1).count():
        hot = some.where(F.col("count") > BLOCK)
        blocks = F.ceil(F.col("count") / BLOCK).cast("int")
        hot = hot.withColumn("n", blocks).withColumn("own", F.expr("cast(pmod(xxhash64(fp), n) as int)"))
        # every block meets every block, itself included: (own, other) for all others, smaller number first
        hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        hot = hot.select("key", "fp", "node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("second"))
        pair = ["key", "x", "y"]
        found = found.union(_compare_blocks(hot.repartition(*pair).sortWithinPartitions(*pair, "second")))
    return found


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of each run of equal keys in sorted input, also across batches."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if rest is not None:
            now = {n: np.concatenate([rest[n], now[n]]) for n in now}
        size = len(now[keys[0]])
        new = np.zeros(size, dtype=bool)
        for k in keys:
            new[1:] |= now[k][1:] != now[k][:-1]
        edges = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield {n: v[a:b] for n, v in now.items()}
        rest = {n: v[edges[-1] :].copy() for n, v in now.items()}
    if rest is not None:
        yield rest


def _batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]) if found else np.empty(0, dtype=np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.empty(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _emit(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for pair in found:
        if len(pair[0]):
            held.append(pair)
            size += len(pair[0])
        if size > 10_000:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)


def _compare(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(_linked(r["node"], r["fp"].view(np.uint64), int(r["key"][0]) >> (WIDTH + WIDTH // 2 + 1)) for r in _runs(batches, ["key"]) if len(r["fp"]) > 1)

    return keyed.mapInArrow(run, "a bigint, b bigint")


def _compare_blocks(dealt: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for r in _runs(batches, ["key", "x", "y"]):
                first = len(r["fp"]) - int(np.count_nonzero(r["second"]))
                apart = r["x"][0] != r["y"][0]
                if not apart or 0 < first < len(r["fp"]):
                    yield _linked(r["node"], r["fp"].view(np.uint64), int(r["key"][0]) >> (WIDTH + WIDTH // 2 + 1), first if apart else 0)

        yield from _emit(each())

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _roots(prints: DataFrame, id_col: str) -> DataFrame:
    """(fp, root, component_id) for each different fingerprint: one fingerprint names its component, whose smallest id
    is component_id (null if no row of it has an id)."""
    reps = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    # nodes are fingerprints; the smallest id is found after components are known, so ids may be of any type or null
    roots = components(links(reps.select("fp", F.col("fp").alias("node"))))
    named = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(named.join(smallest, "root").select("fp", "root", "component_id"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest id reachable. Null and blank texts have
    fingerprint 0 and link like any other. Rows whose id is null take the smallest id of their group, null if there is none;
    repeated rows give repeated rows; empty input gives no rows; other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    found = lookup(prints, _roots(prints, id_col), ["fp"])
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the one with the smallest id.

    If an id repeats, one of the rows that tie stays; a group in which no row has an id keeps one row. Only rows that tie are shuffled for that.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    roots = _roots(prints, id_col)
    rows, row = wrapped(docs), F.col("__row")
    if not prints.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1).count():
        lost = cut(lookup(prints, roots, ["fp"]).where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id")))
        return lookup(rows.withColumn("__id", row[id_col]), lost, ["__id"], "left_anti").select("__row.*")
    again = arrow_function(docs, lambda texts: pa.array([signed(fingerprint(b)) for b in texts.cast(pa.large_binary()).to_pylist()], pa.int64()), "bigint")
    firsts = lookup(prints.withColumnRenamed(id_col, "__id"), roots, ["fp"]).where(F.col("__id").eqNullSafe(F.col("component_id")))
    tied = cut(firsts.groupBy("root").count().where("count > 1").select("root", F.lit(True).alias("tied")))
    roots = cut(lookup(roots, tied, ["root"]))
    rows = lookup(rows.withColumn("fp", again(row[text_col])), roots, ["fp"]).where(row[id_col].eqNullSafe(F.col("component_id")))
    return rows.where("tied is null").select("__row").unionByName(rows.where("tied").dropDuplicates(["root"]).select("__row")).select("__row.*")
