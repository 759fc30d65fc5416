"""Packing token sequences: dominance reduction on counts of sizes, then best fit for the rest."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_function, arrow_rows, cut, prefix_sums, range_starts

CAPACITY = 2048
END = (0).to_bytes(4, "little")
#: Strings that the vocabulary may hold as added tokens, which ``tokenizers`` looks for before anything else, begin so.
_ADDED = "<|"
#: Characters that are encoded at once.
PART = 1 << 18
_BLANK = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


@cache
def _settled() -> re.Pattern[str]:
    """Text in which every character is of the same kind (letter, number, blank, other) in Unicode 3.2 and today, so that
    libraries which follow different versions of Unicode split it alike. Of the control characters only blanks belong."""
    kinds = {"L": "L", "N": "N", "Z": "Z"}
    kind = lambda category: kinds.get(category[0], "other") if category[0] != "C" else None
    keep = [c in (9, 10, 11, 12, 13) or (k := kind(unicodedata.category(chr(c)))) is not None and k == kind(unicodedata.ucd_3_2_0.category(chr(c))) for c in range(0x110000)]
    edges = [c for c in range(0x110001) if (c < 0x110000 and keep[c]) != (c > 0 and keep[c - 1])]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2])) + "]+")


def _parts(text: str) -> Iterator[str]:
    """``text`` cut before single blanks between letters or figures, into parts of somewhat over PART characters where there are such blanks."""
    at = 0
    while len(text) - at > PART and (m := _BLANK.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Encoder:
    """Ids of texts under a ``tokenizers`` file, as little-endian unsigned 32-bit numbers.

    A byte-level vocabulary whose merges are in the order of their tokens' ids has the same ids under ``tiktoken``, which needs a
    sixth of the time and keeps no words. Its ranks are read from the tokenizer itself. Texts with characters that versions of Unicode may
    class differently, or with an added token, and all texts under any other tokenizer, go through ``tokenizers`` as they stand.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._ranked()

    def _ranked(self):
        """The same vocabulary under ``tiktoken``, or None if it is of another kind."""
        import public_tokenizers
        import tiktoken

        told = json.loads(self.tokenizer.to_str())
        model, before = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges"))
        if not plain or told["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        vocabulary = model["vocab"]
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in pairwise(made)):
            return None
        # the vocabulary writes printable bytes as themselves and the others, in order, as letters from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        added = {t["content"] for t in told["added_tokens"]}
        if not all(t.startswith(_ADDED) for t in added):
            return None
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items() if t not in added}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order. A byte-level vocabulary joins a blank to what follows it, so very long texts are encoded in parts
        that start at blanks, which bounds memory."""
        for text in texts:
            if not self.fast or text is None or len(text) <= PART:
                yield self._ids(text or "")
            else:
                yield b"".join(map(self._ids, _parts(text)))

    def _ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast and _ADDED not in text and _settled().fullmatch(text):
            return array("I", self.fast(text)).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@cache
def encoder(path: str | None) -> Encoder:
    """One for each Python worker and file, kept from task to task; by default the public 50k byte-level vocabulary."""
    import public_tokenizers

    return Encoder(path or public_tokenizers.path("byte_bpe_50k.json"))


def spans(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences but for the first, which has what is left over."""
    first = n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in pairwise(edges)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each row of ``docs``: id, piece (int), start, length, ids_crc32 (long), and with ``with_ids`` the ids as binary."""

    def one(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in ("row", "piece", "start", "length", "ids_crc32", "ids")}
        for row, ids in enumerate(encoder(tokenizer).many(batch.column(1).to_pylist())):
            ids += END
            for i, (start, length) in enumerate(spans(len(ids) // 4, capacity)):
                part = ids[4 * start : 4 * (start + length)]
                for c, v in zip(out, (row, i, start, length, zlib.crc32(part), part if with_ids else None), strict=True):
                    out[c].append(v)
        return {id_col: batch.column(0).take(pa.array(out.pop("row"), pa.int64())), **out}

    kind = docs.schema[id_col].dataType.simpleString()
    found = arrow_rows(docs.select(id_col, text_col), one, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")
    return found if with_ids else found.drop("ids")


class Plan:
    """Places for items of equal size by their rank: runs (size, first rank, how many, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.rank, self.sequences = capacity, Counter({k: v for k, v in counts.items() if v}), Counter(), 0
        self.runs: list[tuple[int, int, int, int, int]] = []

    def put(self, size: int, n: int, sequence: int, offset: int) -> None:
        self.runs.append((size, self.rank[size], n, sequence, offset))
        self.rank[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]

    def fix(self, sizes: list[int], n: int) -> None:
        """``n`` new sequences, each with one item of each of ``sizes``."""
        offset = 0
        for size in sizes:
            self.put(size, n, self.sequences, offset)
            offset += size
        self.sequences += n

    def available(self, *sizes: int) -> int:
        """How many sets with these sizes there are."""
        return min(self.left[k] // n for k, n in Counter(sizes).items())

    def smallest(self, but: int, most: int) -> list[int]:
        """The ``most`` smallest items beside one of size ``but``."""
        found: list[int] = []
        for k in sorted(self.left):
            found += [k] * min(most - len(found), self.left[k] - (k == but))
            if len(found) == most:
                break
        return found

    def reduce(self) -> None:
        """Fix what provably belongs to a best packing.

        A set of items for a sequence with item j may be fixed if it dominates every other feasible set with j: the
        other set's items can be dealt out to the fixed set's items, each no smaller than the sum dealt to it.
        - Two sizes that fill a sequence exactly dominate all others.
        - If at most one more item fits beside j, the largest that fits dominates.
        - If at most two fit, the largest single dominates when it is no smaller than the best pair; the best pair (a, b)
          dominates when a is the largest single that fits and no pair fits of which both are larger than b.
        Items of equal size are alike, so a set is fixed as often as its sizes last.
        """
        c = self.capacity
        for size in sorted(self.left, reverse=True):
            if not self.left[size]:
                continue
            if size == c:
                self.fix([c], self.left[c])
            elif self.left[c - size] and (n := self.available(size, c - size)):
                self.fix([size, c - size], n)
        for size in sorted(self.left, reverse=True):
            while self.left[size]:
                small = self.smallest(size, 3)
                room = c - size
                if not small or small[0] > room:
                    self.fix([size], self.left[size])
                    continue
                one = max(k for k in self.left if k <= room and (k != size or self.left[k] > 1))
                if len(small) < 2 or small[0] + small[1] > room:
                    self.fix([size, one], self.available(size, one))
                    continue
                if len(small) == 3 and sum(small) <= room:
                    return  # three fit beside this and so beside any smaller item
                a, b = self._pair(size, room)
                if one >= a + b:
                    self.fix([size, one], self.available(size, one))
                elif a == one and self._no_larger_pair(size, b, room):
                    self.fix([size, a, b], self.available(size, a, b))
                else:
                    break

    def _pair(self, but: int, room: int) -> tuple[int, int]:
        """The two items (larger first) of the largest sum in ``room``, beside one of size ``but``."""
        sizes = [k for k in sorted(self.left) if self.left[k] - (k == but)]
        best, low, high = (0, 0), 0, len(sizes) - 1
        while low <= high:
            a, b = sizes[high], sizes[low]
            if a + b > room or low == high and self.left[a] - (a == but) < 2:
                high -= 1
                continue
            if a + b > sum(best):
                best = (a, b)
            low += 1
        return best

    def _no_larger_pair(self, but: int, b: int, room: int) -> bool:
        larger: list[int] = []
        for k in sorted(self.left):
            if k > b:
                larger += [k] * min(2 - len(larger), self.left[k] - (k == but))
                if len(larger) == 2:
                    return sum(larger) > room
        return True

    def best_fit(self) -> None:
        """Largest size first, each item into the fullest sequence that has room; sequences of equal room are one run."""
        room: dict[int, list[tuple[int, int]]] = {}
        marks = 0  # bit r: there are sequences with room r
        for size in sorted(self.left, reverse=True):
            while n := self.left[size]:
                fits = marks >> size
                if fits:
                    r = size + (fits & -fits).bit_length() - 1
                    first, many = room[r].pop()
                    m = min(n, many)
                    if many > m:
                        room[r].append((first + m, many - m))
                    if not room[r]:
                        marks &= ~(1 << r)
                    self.put(size, m, first, self.capacity - r)
                    rest = r - size
                else:
                    each = min(n, self.capacity // size)
                    m, first = n // each, self.sequences
                    self.sequences += m
                    for k in range(each):
                        self.put(size, m, first, k * size)
                    rest = self.capacity - each * size
                if rest:
                    room.setdefault(rest, []).append((first, m))
                    marks |= 1 << rest


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``counts`` (size: how many). Work and result depend on the number of sizes, at most ``capacity``, not of items."""
    found = Plan(counts, capacity)
    found.reduce()
    found.best_fit()
    return found


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset (long).

    Each document ends with id 0, so an empty or null text is a piece of one id. The driver gets one counter for
    each size (``capacity`` of them at most), plans for whole sizes at once and broadcasts the runs, whose number ``capacity``
    bounds too. Pieces take the place of their rank among those of their size, in an order by hash, and ranks are dealt out
    in ranges, so that the most frequent size is spread over many tasks. Repeated rows are packed each; empty input
    gives no rows; other columns are ignored.
    """
    parts = cut(pieces(docs, id_col, text_col, tokenizer, capacity).withColumns({
        "__u": F.expr(f"shiftrightunsigned(xxhash64(`{id_col}`, piece, ids_crc32), 32)"), "__one": F.lit(1).cast("long"),
    }))
    counts = dict(parts.groupBy("length").count().collect())
    found = plan(counts, capacity)
    runs = sorted(found.runs)
    key = np.array([(r[0] << 40) + r[1] for r in runs], dtype=np.int64)
    where = np.array([(r[1], r[3], r[4]) for r in runs], dtype=np.int64).reshape(-1, 3)
    shared = docs.sparkSession.sparkContext.broadcast((key, where))
    n = sum(counts.values())
    starts = range_starts(parts, ["length"], "__u", "__one", n)
    ranked = prefix_sums(parts, starts, ["length"], "__u", [id_col, "piece", "ids_crc32"], "__one", "__rank", n)

    def places(length: pa.Array, rank: pa.Array) -> pa.Array:
        keys, rows = shared.value
        ranks = np.asarray(rank, dtype=np.int64) - 1
        at = np.searchsorted(keys, (np.asarray(length, dtype=np.int64) << 40) + ranks, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(rows[at, 1] + ranks - rows[at, 0]), pa.array(rows[at, 2])], ["sequence_id", "offset"])

    place = arrow_function(docs, places, "struct<sequence_id:bigint,offset:bigint>")
    return ranked.withColumn("__p", place("length", "__rank")).select(id_col, "piece", "start", "length", "ids_crc32", "__p.*")
