"""Quality rules for documents, and verdicts on whole hosts from their shrunk failure rates."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_function, cut, lookup, wrapped

STATS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_lines:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"
_SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]
_BLANKS = [bytes([c]) for c in b" \t\n\x0b\x0c\r"]
WINDOW = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Thresholds. A document is rejected if it fails a base rule or the rule of symbols, if its host is strict and it
    fails any rule, or if its host is blocked."""

    words: int = 10  #: fewer words fail the base rules
    repeat_percent: int = 20  #: more words in repeated windows fail the base rules
    symbol_percent: int = 10  #: more symbols than this part of the words fail
    dup_line_percent: int = 30  #: more repeated lines than this part of the lines fail
    short_word: int = 2  #: a mean word length below this fails
    long_word: int = 15  #: a mean word length above this fails
    strict: float = 0.35  #: a host whose shrunk failure rate reaches this is strict
    block: float = 0.9  #: a host whose shrunk failure rate reaches this is blocked


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    # equal windows have equal sums of hashes, so a text without equal sums has no equal windows; most texts end here
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    sums = hashes[: n - WINDOW + 1].copy()
    for k in range(1, WINDOW):
        sums = sums * _ODD + hashes[k : n - WINDOW + 1 + k]
    sums.sort()
    if not (sums[1:] == sums[:-1]).any():
        return 0
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.array([number[w] for w in words], dtype=np.uint64)
    v = len(number)
    if v**WINDOW < 2**64:
        key = ids[: n - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            key = key * np.uint64(v) + ids[k : n - WINDOW + 1 + k]
    else:  # rename pairs, then fours, so that numbers stay exact
        two = np.unique(ids[:-1] * np.uint64(v) + ids[1:], return_inverse=True)[1].astype(np.uint64)
        four = np.unique(two[:-2] * np.uint64(n) + two[2:], return_inverse=True)[1].astype(np.uint64)
        key = four[:-1] * np.uint64(v) + ids[4:]
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    at = np.argsort(key, kind="stable")
    equal = key[at][1:] == key[at][:-1]
    edge = np.zeros(n + 1, dtype=np.int64)
    hit = np.zeros(len(key), dtype=bool)
    hit[at[1:][equal]] = True
    hit[at[:-1][equal]] = True
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def _stats(texts: pa.Array) -> pa.Array:
    rows = []
    points = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    for b, n_points in zip(texts.cast(pa.large_binary()).to_pylist(), points, strict=True):
        b = b or b""
        words = b.split()
        lines = [x for x in b.split(b"\n") if x.strip()]
        rows.append((len(words), n_points - sum(map(b.count, _BLANKS)), sum(map(b.count, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], list(names))


def with_stats(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` and the struct ``__s`` of counts over the whole text. Texts alone go to Python, in bounded batches."""
    return docs.withColumn("__s", arrow_function(docs, _stats, STATS)(text))


def rules(limits: Limits) -> dict[str, Column]:
    """Name of a rule: whether a document fails it."""
    c = {k: F.col(f"__s.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    return {
        "base": (c["n_words"] < limits.words) | (100 * c["n_repeat_words"] > limits.repeat_percent * c["n_words"]),
        "symbols": 100 * c["n_symbols"] > limits.symbol_percent * c["n_words"],
        "dup_lines": 100 * c["n_dup_lines"] > limits.dup_line_percent * c["n_lines"],
        "word_length": (c["word_chars"] < limits.short_word * c["n_words"]) | (c["word_chars"] > limits.long_word * c["n_words"]),
    }


def any_rule(limits: Limits) -> Column:
    failed = F.lit(False)
    for c in rules(limits).values():
        failed = failed | c
    return failed


def hosts(docs: DataFrame, host_col: str = "source", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """A row for each host: __host, its documents, those that fail a rule, the shrunk rate, strict and blocked.

    The prior is a beta distribution whose mean is the rate of the whole corpus and whose weight follows, by the method
    of moments, from how far the hosts' rates differ beyond chance. A host of few documents so stays near the mean. A
    null host is a host of its own. Counters are added up before the shuffle, so a hot host costs nothing extra. Sums
    are of whole numbers and decimals, so they do not depend on the order of partitions.
    """
    return _verdicts(with_stats(docs.select(F.col(host_col).alias("__host"), F.col(text_col).alias("__text")), "__text").select("__host", "__s"), limits)


def _verdicts(counted: DataFrame, limits: Limits) -> DataFrame:
    """``hosts`` from (__host, __s)."""
    failed = counted.select("__host", any_rule(limits).cast("long").alias("__failed"))
    rates = cut(failed.groupBy("__host").agg(F.count("*").alias("__docs"), F.sum("__failed").alias("__failures")))
    squares = (F.col("__failures") * F.col("__failures") / F.col("__docs")).cast("decimal(38,9)")
    n, f, h, sq = rates.agg(F.sum("__docs"), F.sum("__failures"), F.count("*"), F.sum(squares).cast("double")).first()
    mean = f / n if n else 0.0
    chance = mean * (1 - mean)
    between = sq / n - mean * mean - chance * h / n if n else 0.0
    weight = min(max(chance / between - 1, 1.0), 1e6) if between > 0 else 1e6
    rate = (F.col("__failures") + mean * weight) / (F.col("__docs") + weight)
    return rates.withColumn("__rate", rate).withColumns({"__strict": F.col("__rate") >= limits.strict, "__blocked": F.col("__rate") >= limits.block})


def _judged(counted: DataFrame, verdicts: DataFrame, limits: Limits) -> DataFrame:
    """Add __base_failed, __kept and the verdict's columns to rows with __host and __s; a host without a verdict is neither strict nor blocked."""
    rows = lookup(counted, verdicts.drop("__docs", "__failures"), ["__host"])
    rule = rules(limits)
    host = F.coalesce("__blocked", F.lit(False)) | (F.coalesce("__strict", F.lit(False)) & any_rule(limits))
    return rows.withColumns({"__base_failed": rule["base"], "__kept": ~(rule["base"] | rule["symbols"] | host)})


def table_of(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """A row for each row of ``docs``: id, the counts, base_failed, host_rate, kept.

    Texts are read once; their counts are cut to the shared folder. Null and empty texts have no words and fail. Repeated rows count each. Empty input gives no rows.
    """
    own = docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), F.col(text_col).alias("__text"))
    counted = cut(with_stats(own, "__text").select("__id", "__host", "__s"))
    rows = _judged(counted, _verdicts(counted, limits), limits)
    return rows.select(F.col("__id").alias(id_col), "__s.*", F.col("__base_failed").alias("base_failed"), F.round("__rate", 6).alias("host_rate"), F.col("__kept").alias("kept"))


def keep(docs: DataFrame, host_col: str = "source", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns, whatever their names.

    Only strict and blocked hosts are joined to the rows: by broadcast up to the limit of ``lookup``, beyond it by a shuffle.
    """
    verdicts = cut(hosts(docs, host_col, text_col, limits).where("__strict or __blocked"))
    row = F.col("__row")
    rows = wrapped(docs).select("__row", row[host_col].alias("__host"), row[text_col].alias("__text"))
    return _judged(with_stats(rows, "__text").drop("__text"), verdicts, limits).where("__kept").select("__row.*")
