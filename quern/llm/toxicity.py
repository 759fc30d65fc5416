"""Toxicity by a factorization machine over hashed terms, trained here on labelled documents."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut

#: Whole words have the lower half of the buckets, stems the upper half.
BUCKETS = 1 << 20
WORDS = BUCKETS // 2
#: Labelled rows that training takes at most: those of the smallest hash of their id, so the choice does not depend on order.
TRAIN_ROWS = 20_000
#: Terms of one training text at most, those of the smallest hash; with TRAIN_ROWS this bounds what training holds. Scoring takes all.
TRAIN_TERMS = 4096
#: Training rows on which pairs of terms are tested: those of the rarer label first, half of this number at most.
PAIR_ROWS = 8000
#: Lengths of the prefixes that stand for a word's stem, beside the word.
STEMS = (4, 5, 6)
_TERM = re.compile(r"[^\W_]+")
#: Words that a Python worker remembers the buckets of at most, some 100 bytes each.
REMEMBERED = 500_000


class Terms:
    """Buckets of a text's terms: lowered runs of letters and digits, and their first letters; CRC-32 of the term."""

    def __init__(self, used: frozenset[int] | None = None):
        self.used = used
        self.known: dict[str, tuple[int, ...]] = {}
        self.unused: set[str] = set()  # words none of whose buckets are used

    def _of(self, word: str) -> tuple[int, ...]:
        stems = (f"{n}:{word[:n]}" for n in STEMS if len(word) > n)
        found = (zlib.crc32(word.encode()) % WORDS, *(WORDS + zlib.crc32(x.encode()) % (BUCKETS - WORDS) for x in stems))
        return found if self.used is None else tuple(b for b in found if b in self.used)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted buckets, each once: how often a term occurs says little in texts of very different lengths."""
        words = set(_TERM.findall(text.lower())) if text else set()
        if len(self.known) + len(self.unused) > REMEMBERED:
            self.known.clear()
            self.unused.clear()
        known, found = self.known, set()
        for w in words.difference(self.unused):
            b = known.get(w)
            if b is None:
                b = self._of(w)
                if not b:
                    self.unused.add(w)
                    continue
                known[w] = b
            found.update(b)
        return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


@dataclass
class Model:
    """logit = bias + sum of weights + half of (sum of factors)^2 - sum of factors^2, summed over the factors.

    Only buckets that training saw often enough have parameters; they are listed in ``buckets``, in order.
    """

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, at: np.ndarray) -> float:
        if not len(at):
            return self.bias
        v = self.factors[at]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[at].sum() + 0.5 * (s @ s - (v * v).sum()))


def _surprise(n: np.ndarray, k: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Chernoff's bound, as a negative logarithm: how unlikely a share of k in n is at this rate."""
    with np.errstate(divide="ignore", invalid="ignore"):
        x = k / n
        return n * (np.where(k > 0, x * np.log(x / rate), 0.0) + np.where(k < n, (1 - x) * np.log((1 - x) / (1 - rate)), 0.0))


def in_pairs(rows: list[tuple[np.ndarray, int]], seen: np.ndarray, toxic: np.ndarray, alone: np.ndarray, least: int, doubt: float = 0.05) -> np.ndarray:
    """Which buckets are in a pair whose rate of label 1 is not what the log-odds of both add up to.

    Tested are all pairs of whole words that each have the rows which a test at the common rate takes, with a chance of ``doubt``
    at most that any pair of no interaction passes. If both tell nothing alone (neither is in ``alone``), their pair must differ from the common
    rate too, in the same direction. Buckets in the same rows count as one. Counts are products of blocks of 0 and 1, in
    memory that does not grow with the number of pairs.
    """
    n, ones = len(rows), sum(y for _, y in rows)
    found = np.zeros(BUCKETS, dtype=bool)
    often = np.flatnonzero(seen[:WORDS] >= least)
    if not ones or ones == n or len(often) < 2:
        return found
    p = ones / n
    need = 2 * np.log(len(often)) - np.log(doubt)
    often = often[(toxic[often] * -np.log(p) >= need) | (seen[often] * -np.log1p(-p) >= need)]
    if len(often) < 2:
        return found
    marks = np.random.default_rng(0).integers(0, 1 << 63, n, dtype=np.uint64)
    support = np.zeros(BUCKETS, dtype=np.uint64)
    for (b, _), m in zip(rows, marks):
        support[b] += m
    _, first, same = np.unique(support[often], return_index=True, return_inverse=True)
    terms = often[first]  # one bucket of each set of rows
    odds = np.log((toxic[terms] + p) / (seen[terms] - toxic[terms] + 1 - p)) - np.log(p / (1 - p))
    strong = alone[terms]
    where = np.full(BUCKETS, -1, dtype=np.int32)
    where[terms] = np.arange(len(terms))
    at = [np.sort(x[x >= 0]) for x in (where[b] for b, _ in rows)]
    of = {y: [x for x, (_, z) in zip(at, rows) if z == y] for y in (0, 1)}
    hit = np.zeros(len(terms), dtype=bool)
    height = (1 << 21) // len(terms) + 64
    for a in range(0, len(terms), height):
        b = min(len(terms), a + height)
        both = np.zeros((2, b - a, len(terms) - a), dtype=np.float32)
        for y in (0, 1):
            inside = [x[np.searchsorted(x, a) :] - a for x in of[y]]
            inside = [x for x in inside if len(x) and x[0] < b - a]
            step = (1 << 23) // (len(terms) - a) + 64
            for c in range(0, len(inside), step):
                part = inside[c : c + step]
                row = np.repeat(np.arange(len(part)), [len(x) for x in part])
                block = np.zeros((len(part), len(terms) - a), dtype=np.float32)
                block[row, np.concatenate(part)] = 1
                both[y] += block[:, : b - a].T @ block
        i, j = np.nonzero(np.triu((both[1] * -np.log(p) >= need) | ((both[0] + both[1]) * -np.log1p(-p) >= need), 1))
        k = both[1][i, j].astype(np.float64)
        m = k + both[0][i, j]
        i, j = i + a, j + a
        rate = 1 / (1 + np.exp(-(odds[i] + odds[j] + np.log(p / (1 - p)))))
        plain = ~(strong[i] | strong[j])
        rate = np.where(plain, np.where(k > p * m, np.maximum(rate, p), np.minimum(rate, p)), rate)
        sure = (_surprise(m, k, rate) >= need) & (~plain | ((k > rate * m) == (k > p * m)))
        hit[i[sure]] = hit[j[sure]] = True
    found[often] = hit[same]
    return found


def _counts(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each bucket has, and how many of them have label 1."""
    seen, toxic = (np.bincount(np.concatenate([np.empty(0, dtype=np.int32), *(b for b, y in rows if y in of)]), minlength=BUCKETS) for of in ((0, 1), (1,)))
    return seen, toxic


def _for_pairs(rows: list[tuple[np.ndarray, int]], most: int) -> list[tuple[np.ndarray, int]]:
    """At most ``most`` rows: the first of the rarer label, half of them at most, filled up by the other label."""
    of = {y: [r for r in rows if r[1] == y] for y in (0, 1)}
    rare, usual = sorted(of.values(), key=len)
    rare = rare[: most // 2]
    return rare + usual[: most - len(rare)]


def fit(rows: list[tuple[np.ndarray, int]], factors: int = 4, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, least: int = 5, sure: float = 3.5, seed: int = 7) -> Model:
    """Train by AdaGrad on single rows in a shuffled order.

    A bucket needs ``least`` rows, and a rate of label 1 that is ``sure`` standard errors from the common one or a place in
    a pair that tells more than its parts (``in_pairs``, on PAIR_ROWS of the rows): the many terms that tell nothing would add up to noise in long texts. Without rows of both labels all texts get the smoothed rate.
    """
    n, ones = len(rows), sum(y for _, y in rows)
    prior = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    seen, toxic = _counts(rows)
    rate_of_ones = ones / n if n else 0.0
    apart = np.abs(toxic - seen * rate_of_ones) >= sure * np.sqrt(seen * rate_of_ones * (1 - rate_of_ones))
    alone = (seen >= least) & apart
    tested = _for_pairs(rows, PAIR_ROWS)
    buckets = np.flatnonzero(alone | in_pairs(tested, *_counts(tested), alone, least)).astype(np.int32)
    rng = np.random.default_rng(seed)
    model = Model(prior, buckets, np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), factors)))
    if not ones or ones == n or not len(buckets):
        return model
    where = np.full(BUCKETS, -1, dtype=np.int32)
    where[buckets] = np.arange(len(buckets))
    data = [(x[x >= 0], y) for x, y in ((where[b], y) for b, y in rows)]
    g_bias, g_w, g_v = 1e-8, np.full(len(buckets), 1e-8), np.full((len(buckets), factors), 1e-8)
    heavier = min(5.0, (n - ones) / ones)  # rows of the rarer label count more
    for _ in range(epochs):
        for k in rng.permutation(n):
            at, y = data[k]
            z = model.logit(at)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * (heavier if y else 1.0)
            if abs(e) < 1e-3:
                continue
            g_bias += e * e
            model.bias -= rate * e / np.sqrt(g_bias)
            if not len(at):
                continue
            v = model.factors[at]
            grad = e / np.sqrt(len(at)) + decay * model.weights[at]
            g_w[at] += grad * grad
            model.weights[at] -= rate * grad / np.sqrt(g_w[at])
            grad = e * (v.sum(axis=0) - v) / len(at) + decay * v
            g_v[at] += grad * grad
            model.factors[at] = v - 0.1 * rate * grad / np.sqrt(g_v[at])
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> list[tuple[np.ndarray, int]]:
    """Terms and label of at most ``most`` labelled rows that are not held out, one for an id; terms are found on the executors."""
    marked = labels.select(F.col(id_col).alias("__key"), F.col(label_col).cast("int").alias("__y")).where("__key is not null and __y is not null")
    marked = marked.where(F.crc32(F.col("__key").cast("string").cast("binary")) % 5 != 0)
    marked = marked.groupBy("__key").agg(F.max("__y").alias("__y"))
    chosen = marked.orderBy(F.xxhash64("__key"), "__key").limit(most)
    rows = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__key")

    def one(batch: pa.RecordBatch) -> dict:
        terms, found = Terms(), []
        for t in batch.column(1).to_pylist():
            b = terms(t)
            if len(b) > TRAIN_TERMS:
                b = np.sort(b[np.argsort(b * np.uint32(0x9E3779B1) % (1 << 32), kind="stable")[:TRAIN_TERMS]])
            found.append(b.astype("<i4").tobytes())
        return {"y": batch.column(0), "key": batch.column(2), "b": found}

    key = F.xxhash64("__key").alias("key")
    found = arrow_rows(rows.select("__y", "__text", key), one, "y int, key bigint, b binary")
    # of rows that repeat an id one stays, so there are no more than ``most``
    kept = cut(found.groupBy("key").agg(F.min(F.struct("b", "y")).alias("r")).select("key", "r.*")).toArrow().sort_by("key")
    return [(np.frombuffer(b, dtype="<i4"), y) for b, y in zip(kept["b"].to_pylist(), kept["y"].to_pylist(), strict=True)]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS, **training) -> DataFrame:
    """A row for each row of ``docs``: id, held_out, score (double), predicted (int).

    Rows whose crc32(id as text) mod 5 is 0 are held out: their labels are never read. The model has one row for each
    bucket in use, so its size is bounded by BUCKETS; it is broadcast, and scoring is one pass over whole texts without a
    shuffle. Null and empty texts score by the bias alone. A null id is not held out. Of a labelled id that repeats, the larger label counts, and one of its texts.
    Without labels of both kinds every text gets the smoothed rate. Empty input gives no rows; extra columns are ignored.
    """
    model = fit(sample(docs, labels, id_col, text_col, label_col, most), **training)
    small = Model(model.bias, model.buckets, model.weights.astype(np.float32), model.factors.astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(small)
    cache: dict[str, object] = {}

    def one(batch: pa.RecordBatch) -> dict:
        m = shared.value
        if not cache:
            cache["terms"] = Terms(frozenset(m.buckets.tolist()))
        terms, ids = cache["terms"], batch.column(0)
        logits = np.array([m.logit(np.searchsorted(m.buckets, terms(t))) for t in batch.column(1).to_pylist()], dtype=np.float64)
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        held = [x is not None and zlib.crc32(str(x).encode()) % 5 == 0 for x in ids.to_pylist()]
        return {id_col: ids, "held_out": held, "score": p, "predicted": (p >= 0.5).astype(np.int32)}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_rows(docs.select(id_col, text_col), one, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
