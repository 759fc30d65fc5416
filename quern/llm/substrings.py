"""Removal of repeated 50-byte strings: suffix arrays of shards, common prefixes, merging across shards by binary search.

Comparing whole suffix arrays of all shards with each other would grow with the square of the shards, so what can't be shared is
left out first, and equal strings are led to one place:

1. In every window of 50 bytes the 24-byte substring of least hash is its anchor. Equal windows have equal anchors, and one
   anchor serves some 14 windows in a row, whose bytes together are a piece of 50 to 76 bytes.
2. Hashes of anchors, five bytes each, are dealt out by group of buckets, and each group tells which of them occur in
   two or more documents. A block and a group exchange one row a step, so rows are as many as blocks times groups, not times buckets. Only pieces of those go on, each different piece of a block of documents once. Anchors of very
   many documents send single windows instead, dealt out by a hash of the window, so that no bucket gets all their pieces.
3. In a bucket the pieces of each run of document blocks are a shard; a piece that an earlier shard has too stays with that one. Each
   shard gets a suffix array by Larsson-Sadakane refinement, and equal windows inside it are found by Kasai's common prefixes.
   The sorted windows of all shards are cut at the same places into ranges, and in each range merged by binary search, which tells the
   smallest document of each window over all shards.
4. Blocks of documents mark the windows that a smaller document has, and cut the bytes these cover.

False equalities of hashes only send more pieces to step 3, which compares bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

LENGTH = 50
ANCHOR = 24
SPAN = LENGTH - ANCHOR + 1
#: Bytes of text of a block of documents, on average: from this on up to BLOCK_GROWS times it, where there would be more than BLOCKS.
BLOCK_BYTES = 2 << 20
BLOCK_GROWS = 4
BLOCKS = 1 << 11
#: Bytes of text for which there is one bucket, so that its suffix array mostly stays in the processor's cache.
BUCKET_TEXT = 1 << 20
MOST_BUCKETS = 1 << 20
#: Buckets come in groups of up to 2**GROUP_BITS, where there would be more than 2**LEAST_GROUPS of them.
GROUP_BITS = 4
LEAST_GROUPS = 9
#: Bytes of pieces in one suffix array: what stays in the processor's cache. A usual bucket has several.
SHARD_BYTES = 128 << 10
#: Windows of all shards of a bucket that are merged at once, 51 bytes each.
MERGED = 1 << 18
DEPTH = 64
#: An anchor that so many documents have sends single windows: they take ten times the bytes of pieces, but are spread.
HOT_DOCS = 200_000
CHUNK = 1 << 16
_LAST = np.int64(2**63 - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_U32 = np.uint64(32)


def suffix_array(data: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``data`` (uint8) in the order of their suffixes' first ``depth`` bytes, and for each a lower bound
    of the prefix it shares with the one before: 0, 8, 16, ...; at least ``depth`` for suffixes not told apart.

    Larsson and Sadakane's refinement: suffixes are sorted by 8 bytes, then groups still together are sorted by the
    rank of the suffix h bytes on, h = 8, 16, ..., while sorted groups are left alone. One numpy sort serves all groups.
    """
    n = len(data)
    low = np.zeros(n, dtype=np.int32)
    if not n:
        return np.empty(0, dtype=np.int64), low
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    key = np.ndarray((n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    sa = np.argsort(key)
    new = np.empty(n, dtype=bool)
    new[0] = True
    ordered = key[sa]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    del key, ordered
    low[~new] = 8
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while h < depth:
        open_ = ~new
        open_[:-1] |= ~new[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        p = sa[at]
        ahead = p + h
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, n - ahead) + h  # of suffixes that end, the shorter first
        key = rank[p] * np.int64(n + 1 + h) + then
        order = np.argsort(key)
        p, key = p[order], key[order]
        sa[at] = p
        fresh = np.ones(len(at), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        new[at] = fresh
        low[at[~fresh]] = 2 * h
        rank[p] = np.maximum.accumulate(np.where(fresh, at, 0))
        h *= 2
    low[1:] = np.minimum(low[1:], n - np.maximum(sa[1:], sa[:-1]))  # zeros behind the end are no common bytes
    return sa, low


def common_prefixes(data: np.ndarray, sa: np.ndarray, low: np.ndarray, least: int = 0, most: int = DEPTH) -> np.ndarray:
    """lcp[k]: how many bytes the suffixes sa[k - 1] and sa[k] share, ``most`` at most; where ``low`` is below
    ``least``, the bound itself is given back.

    Kasai's step without a loop: in the order of the text, the suffix behind i has one byte less in common with the suffix
    behind i's neighbour. So positions i, i + 1, ... whose neighbours follow each other too form a run; bytes are compared for its
    last position only, and each position before it has one more.
    """
    lcp = np.minimum(low, most).astype(np.int64)
    k = np.flatnonzero((low >= least) & (low < most))
    k = k[k > 0]
    if not len(k):
        return lcp
    order = np.argsort(sa[k])
    k = k[order]
    i, j = sa[k], sa[k - 1]
    go_on = np.zeros(len(k), dtype=bool)  # the next position continues the run
    go_on[:-1] = (i[1:] == i[:-1] + 1) & (j[1:] == j[:-1] + 1) & (data[i] == data[j])[:-1]
    last = np.flatnonzero(~go_on)
    a, b, same = i[last], j[last], low[k[last]].astype(np.int64)
    n = len(data)
    alive = np.arange(len(last))
    while len(alive):
        x, y = a[alive] + same[alive], b[alive] + same[alive]
        ok = (same[alive] < most) & (x < n) & (y < n)
        ok[ok] = data[x[ok]] == data[y[ok]]
        alive = alive[ok]
        same[alive] += 1
    run = np.searchsorted(last, np.arange(len(k)))
    lcp[k] = np.minimum(same[run] + (last[run] - np.arange(len(k))), most)
    return lcp


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for each i where that fits, by doubling."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last) for each anchor of the texts that lie one after another in ``data`` and end at ``ends``: a hash of its
    bytes, and the first and last window whose anchor it is. Windows lie inside one text. A window in which the least
    hash occurs twice has both anchors. Work goes in pieces of CHUNK windows, which stay in the processor's cache; an
    anchor whose windows lie on both sides of such a border is there twice, each time with its part of them."""
    found = []
    for start in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        stop = min(start + CHUNK + LENGTH - 1, len(data))
        inner = ends[np.searchsorted(ends, start, side="right") : np.searchsorted(ends, stop, side="left")]
        key, first, last = _anchors(data[start:stop], inner - start)
        found.append((key, first + start, last + start))
    if not found:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(data: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``inner``: where texts end inside ``data``."""
    n = len(data)
    word = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,)).copy()
    m = n - ANCHOR + 1
    h = word[:m] * _C[0]
    h ^= h >> np.uint64(29)
    for k in range(8, ANCHOR, 8):
        h += word[k : k + m] * _C[1]
        h ^= h >> _U32
        h *= _C[2]
    h ^= h >> np.uint64(31)
    h |= np.uint64(1)  # never 0
    least = _slide(h, SPAN, np.minimum)  # of n - 49 windows
    for e in inner.tolist():  # windows that reach into the next text
        least[max(0, e - LENGTH + 1) : e] = 0
    w = len(least)
    border = np.zeros(SPAN - 1, dtype=np.uint64)
    most = _slide(np.concatenate([border, least, border]), SPAN, np.maximum)  # of the windows around each anchor
    at = np.flatnonzero(most == h)
    if not len(at):
        return np.empty(0, dtype=np.uint64), at, at
    key = h[at]
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])  # runs of windows with equal least hash
    value = least[starts]
    stops = np.concatenate([starts[1:] - 1, [w - 1]])
    run = np.searchsorted(starts, np.maximum(at - SPAN + 1, 0), side="right") - 1
    wrong = np.flatnonzero(value[run] != key)
    while len(wrong):  # a run in reach has this anchor's hash, as it was found
        run[wrong] += 1
        wrong = wrong[value[run[wrong]] != key[wrong]]
    return key * _C[3], np.maximum(starts[run], at - SPAN + 1), np.minimum(stops[run], at)


class Shared(NamedTuple):
    pieces: list[bytes]  #: in the order of their buckets
    least: np.ndarray  #: the smallest document of each piece in this block
    start: np.ndarray  #: where in the block pieces occur
    doc: np.ndarray  #: the document of each occurrence
    which: np.ndarray  #: the piece of each occurrence
    inner: np.ndarray  #: the pieces of each bucket of the group


class Layout(NamedTuple):
    blocks: int
    bits: int  #: of the number of groups of buckets
    inner: int  #: bits of the number of buckets in a group


def layout(size: int) -> Layout:
    """For texts of ``size`` bytes. Rows between blocks and groups are ``blocks << bits`` a step. Up to 16 GB these stay in proportion to the text, as
    blocks or groups grow; beyond, where memory bounds both, they are a row for some 128 MB**2 of the text's square."""
    block = min(max(BLOCK_BYTES, size // BLOCKS), BLOCK_BYTES * BLOCK_GROWS)
    bits = max(0, (min(-(-size // BUCKET_TEXT), MOST_BUCKETS) - 1).bit_length())
    inner = min(max(0, bits - LEAST_GROUPS), GROUP_BITS)
    return Layout(max(1, -(-size // block)), bits - inner, inner)


class Block:
    """The texts of a block of documents, in an order that does not depend on how they came: by id, then bytes. Rows of equal id and text are
    one, and ``times`` says how many they were."""

    def __init__(self, ids: list, texts: list[bytes | None]):
        found = Counter((_LAST if i is None else i, t or b"", i is None) for i, t in zip(ids, texts, strict=True))
        rows = sorted(found)
        self.times = [found[r] for r in rows]
        self.ids = [None if null else int(i) for i, _, null in rows]
        self.texts = [t for _, t, _ in rows]
        self.order = np.array([i for i, _, _ in rows], dtype=np.int64)
        self.ends = np.cumsum([len(t) for t in self.texts]) if rows else np.empty(0, dtype=np.int64)
        self.raw = b"".join(self.texts)
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        self.key, self.first, self.last = anchors(self.data, self.ends)
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def shared(self, keys: np.ndarray, hot: np.ndarray, bits: int, inner: int = 0) -> dict[int, Shared]:
        """The different pieces of anchors in ``keys`` by group of 2**inner buckets, and the windows of anchors in ``hot`` by groups of their own
        (negative numbers); ``keys`` and ``hot`` are sorted."""
        short = self.key >> np.uint64(32 - bits)
        at = np.flatnonzero(_among(short, keys))
        bucket, start, stop = (short[at] >> np.uint64(32 - inner)).astype(np.int64), self.first[at], self.last[at] + LENGTH
        at = np.flatnonzero(_among(short, hot))
        if len(at):
            windows = _windows(self.last[at] - self.first[at] + LENGTH, self.first[at])
            spread = np.array([-1 - (zlib.crc32(self.raw[i : i + LENGTH]) & ((1 << bits + inner) - 1)) for i in windows.tolist()], dtype=np.int64)
            bucket, start, stop = np.concatenate([bucket, spread]), np.concatenate([start, windows]), np.concatenate([stop, windows + LENGTH])
        order = np.lexsort((start, bucket))
        bucket, start, stop = bucket[order], start[order], stop[order]
        doc = self.order[np.searchsorted(self.ends, start, side="right")] if len(start) else start
        group, place = bucket >> inner, bucket & ((1 << inner) - 1)
        edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)] if len(group) else [0]
        found, raw = {}, self.raw
        for a, b in zip(edges, edges[1:]):
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(raw[i:j], len(number)) for i, j in zip(start[a:b].tolist(), stop[a:b].tolist(), strict=True)])
            least = np.empty(len(number), dtype=np.int64)
            least[which[::-1]] = doc[a:b][::-1]  # a piece's occurrences are in the order of documents, so its first has the smallest
            of = np.empty(len(number), dtype=np.int64)
            of[which] = place[a:b]
            found[int(group[a])] = Shared(list(number), least, start[a:b], doc[a:b], which, np.bincount(of, minlength=1 << inner))
        return found


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``keys``."""
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x if len(keys) else np.zeros(len(x), dtype=bool)


def outline(block: Block, bits: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, hashes, counts): the block's different anchors, and how many of its documents have each (255 stands for
    more; rows that repeat an id count once)."""
    if not len(block.key):
        return []
    short = block.key >> np.uint64(32 - bits)
    order = np.argsort(short, kind="stable")
    short, doc = short[order], block.order[block.doc[order]]
    start = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
    fresh = np.ones(len(doc), dtype=np.int64)  # anchors of equal hash come in the order of documents
    fresh[1:] = doc[1:] != doc[:-1]
    fresh[start] = 1
    many = np.minimum(np.add.reduceat(fresh, start), 255).astype(np.uint8)
    short = short[start]
    bucket = (short >> _U32).astype(np.int64)
    low = (short & np.uint64(0xFFFFFFFF)).astype("<u4")
    edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(short)]
    return [(int(bucket[a]), low[a:b].tobytes(), many[a:b].tobytes()) for a, b in zip(edges, edges[1:])]


def in_common(hashes: list[bytes], counts: list[bytes], hot_docs: int = HOT_DOCS) -> list[tuple[bytes, bytes]]:
    """Of each block's hashes those that two documents have, in any blocks: usual ones, and those of ``hot_docs`` documents or more."""
    own = [np.frombuffer(h, dtype="<u4") for h in hashes]
    every = np.concatenate(own)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    docs = np.add.reduceat(np.concatenate([np.frombuffer(c, dtype=np.uint8) for c in counts]).astype(np.int64)[order], start)
    usual, hot = ordered[start[(docs > 1) & (docs < hot_docs)]], ordered[start[docs >= hot_docs]]
    return [(h[_among(h, usual)].tobytes(), h[_among(h, hot)].tobytes()) for h in own]


def full_keys(buckets: list[int], hashes: list[bytes]) -> np.ndarray:
    """Sorted keys from hashes and their buckets."""
    keys = [(np.uint64(b) << _U32) | np.frombuffer(h, dtype="<u4").astype(np.uint64) for b, h in sorted(zip(buckets, hashes, strict=True))]
    return np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)


def _windows(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[i] + 0, 1, ... for each of the windows of piece i, piece after piece."""
    n = lengths - LENGTH + 1
    return np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)


def _shard(raw: bytes, lengths: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one suffix array: the class of each window (windows in the order of pieces), and per class a place in ``raw`` and
    the smallest document; classes are in the order of their bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    sa, low = suffix_array(data)
    group = np.cumsum(common_prefixes(data, sa, low, DEPTH // 2) < LENGTH)
    at = _windows(lengths, np.cumsum(lengths) - lengths)
    starts = np.zeros(len(data), dtype=bool)
    starts[at] = True
    keep = starts[sa]
    sa, group = sa[keep], group[keep]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.flatnonzero(new)
    owner = np.repeat(docs, lengths)
    number = np.empty(len(data), dtype=np.int64)
    number[sa] = np.cumsum(new) - 1
    return number[at], sa[first], np.minimum.reduceat(owner[sa], first)


def _strings(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The windows at ``at`` as fixed strings. A last byte of 1 keeps numpy from dropping zeros at their ends."""
    data = np.frombuffer(raw, dtype=np.uint8)
    out = np.ones((len(at), LENGTH + 1), dtype=np.uint8)
    out[:, :LENGTH] = data[at[:, None] + np.arange(LENGTH)]
    return out.reshape(-1).view(f"S{LENGTH + 1}")


def _union(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted sets of strings with a number each as one, with the least number of each string. Strings of the second are looked up in the
    first by binary search; those not found are put in between."""
    (x, m), (y, n) = a, b
    at = np.searchsorted(x, y)
    known = x[np.minimum(at, len(x) - 1)] == y
    least = m.copy()
    least[at[known]] = np.minimum(least[at[known]], n[known])
    return np.insert(x, at[~known], y[~known]), np.insert(least, at[~known], n[~known])


def merge(sides: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of sorted sets of strings with a number each: the least number of each string over all sets, set by set. Sets are merged in pairs."""
    level = [s for s in sides if len(s[0])]
    if not level:
        return [m for _, m in sides]
    while len(level) > 1:
        level = [_union(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    strings, least = level[0]
    return [least[np.searchsorted(strings, s)] for s, _ in sides]


def _merged(shards: list[tuple[bytes, np.ndarray, np.ndarray]], merged: int) -> list[np.ndarray]:
    """The smallest document of each class of each shard (text, places of the classes in their order, smallest documents) over all shards. Ranges of
    strings, the same in all shards, are merged one after another, so memory is bounded by ``merged`` windows."""
    if len(shards) == 1:
        return [shards[0][2]]
    heads = []
    for raw, at, _ in shards:
        words = np.ndarray((len(raw) - 7,), dtype=">u8", buffer=raw, strides=(1,))
        heads.append(words[at].astype(np.uint64))  # the first eight bytes, in order
    every = np.sort(np.concatenate(heads))
    edges = np.unique(every[::merged])[1:]
    cuts = [[0, *np.searchsorted(h, edges).tolist(), len(h)] for h in heads]
    parts: list[list[np.ndarray]] = [[] for _ in shards]
    for k in range(len(edges) + 1):
        found = merge([(_strings(raw, at[c[k] : c[k + 1]]), m[c[k] : c[k + 1]]) for (raw, at, m), c in zip(shards, cuts, strict=True)])
        for p, f in zip(parts, found, strict=True):
            p.append(f)
    return [np.concatenate(p) for p in parts]


def repeated(raws: list[bytes], lengths: list[np.ndarray], docs: list[np.ndarray], shard_bytes: int = SHARD_BYTES, merged: int = MERGED, inner: list[np.ndarray] | None = None) -> list[bytes]:
    """For each block's pieces a bit for each window: whether a smaller document has it. Blocks come in order. ``inner`` has the number of each
    block's pieces in each bucket of the group, one bucket if there is none. Buckets are worked on one after another, each over all blocks."""
    raw, size, own = b"".join(raws), np.concatenate(lengths), np.concatenate(docs)
    per_block = np.array([len(x) for x in lengths])
    many = per_block[:, None] if inner is None else np.array(inner)
    bucket = np.repeat(np.tile(np.arange(many.shape[1]), len(many)), many.reshape(-1))
    ends = np.cumsum(size)
    n = size - LENGTH + 1
    stops = np.cumsum(n)
    removed = np.empty(int(stops[-1]), dtype=bool)
    for at in np.split(np.argsort(bucket, kind="stable"), np.cumsum(many.sum(axis=0))[:-1]):
        if len(at):
            pieces = [raw[a:b] for a, b in zip((ends[at] - size[at]).tolist(), ends[at].tolist(), strict=True)]
            removed[_windows(size[at], (stops - n)[at])] = _removed(pieces, own[at], shard_bytes, merged)
    return [np.packbits(x).tobytes() for x in np.split(removed, stops[np.cumsum(per_block) - 1][:-1])]


def _removed(found: list[bytes], own: np.ndarray, shard_bytes: int, merged: int) -> np.ndarray:
    """For each window of the pieces of a bucket, with the document of each: whether a smaller document has it. A piece that is found several
    times stays with the first, with the smallest of its documents; runs of different pieces of ``shard_bytes`` are the shards."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(p, len(number)) for p in found])
    smallest = np.full(len(number), _LAST)
    np.minimum.at(smallest, which, own)
    pieces = list(number)
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    edges = np.unique(np.searchsorted(np.cumsum(size), np.arange(shard_bytes, int(size.sum()) + shard_bytes, shard_bytes), side="right").clip(1)).tolist()
    edges = [0, *edges] if edges[-1] == len(pieces) else [0, *edges, len(pieces)]
    raws = [b"".join(pieces[a:b]) for a, b in zip(edges, edges[1:])]
    parts = [_shard(raw, size[a:b], smallest[a:b]) for raw, a, b in zip(raws, edges, edges[1:])]
    least = _merged([(raw, at, m) for raw, (_, at, m) in zip(raws, parts, strict=True)], merged)
    of_window = np.concatenate([m[p[0]] for p, m in zip(parts, least, strict=True)])
    n = size - LENGTH + 1
    begin = np.cumsum(n) - n
    return of_window[_windows(size[which], begin[which])] < np.repeat(own, n[which])


def marks(block: Block, found: dict[int, Shared], answers: dict[int, bytes]) -> np.ndarray:
    """Windows of the block that a smaller document has, as a boolean for each byte of the block."""
    gone = np.zeros(len(block.data) + 1, dtype=bool)
    for bucket, s in found.items():
        bits = np.unpackbits(np.frombuffer(answers[bucket], dtype=np.uint8))
        size = np.array([len(p) for p in s.pieces], dtype=np.int64)
        n = size - LENGTH + 1
        begin = np.cumsum(n) - n
        smaller = s.doc > s.least[s.which]
        hit = (bits[_windows(size[s.which], begin[s.which])] > 0) | np.repeat(smaller, n[s.which])
        gone[_windows(size[s.which], s.start)[hit]] = True
    return gone


def cut_out(block: Block, gone: np.ndarray) -> dict[str, list]:
    """The result of each text of the block, and with it what is left of the text."""
    edge = np.zeros(len(gone) + LENGTH, dtype=np.int8)
    edge[: len(gone)] = gone
    edge[LENGTH:] -= gone
    covered = np.cumsum(edge, dtype=np.int8)[: len(block.data)] > 0  # by LENGTH windows at most
    out: dict[str, list] = {c: [] for c in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
    start = 0
    for i, text, end, times in zip(block.ids, block.texts, block.ends.tolist(), block.times, strict=True):
        mask = covered[start:end]
        n = int(np.count_nonzero(mask))
        spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0]) if n else 0
        kept = block.data[start:end][~mask].tobytes() if n else text
        for c, v in zip(out, (i, len(text), n, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
            out[c] += [v] * times
        start = end
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot_docs: int = HOT_DOCS) -> DataFrame:
    """A row for each row of ``docs``: id, n_bytes, n_removed, n_spans (long), kept_sha256; with ``with_text`` also ``kept``,
    the bytes left over (binary: cuts can fall inside a character).

    Removed is each byte covered by a string of 50 bytes that also starts in a text with a smaller id, judged on the input.
    Ids must be integers. Null ids come last and take nothing from each other, nor do rows that repeat an id. Null texts
    are empty; texts under 50 bytes stay whole; empty input gives no rows; other columns are ignored.
    Blocks and groups of buckets have a bounded average size in bytes, so their numbers grow with the text, and the memory of a task does not. Rows that
    repeat an id and a text are dealt out by task, and are worked on once in a block.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}; ids must be integers, as the order of texts is theirs")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, bits, inner = layout(size)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.expr(f"cast(pmod(xxhash64(`{id_col}`, crc32(coalesce(cast(`{text_col}` as binary), cast('' as binary))), spark_partition_id()), {blocks}) as int)").alias("block"))
    own = own.repartition("block")
    message = "block int, bucket int, a binary, b binary, c binary, d binary"  # bucket: the group of buckets
    schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in "abcd")])

    def load(table: pa.Table) -> Block:
        return Block(table.column("id").to_pylist(), table.column("text").to_pylist())

    def rows(found: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types)], schema=schema)

    def first(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        return rows([(number, bucket, h, f, None, None) for bucket, h, f in outline(load(table), bits)])

    def second(table: pa.Table) -> pa.Table:
        common = in_common(table.column("a").to_pylist(), table.column("b").to_pylist(), hot_docs)
        return rows([(block, bucket, *h, None, None) for block, bucket, h in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), common, strict=True) if any(h)])

    def common_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return tuple(full_keys(table.column("bucket").to_pylist(), table.column(c).to_pylist()) for c in "ab")

    def third(texts: pa.Table, common: pa.Table) -> pa.Table:
        if not texts.num_rows or not common.num_rows:
            return rows([])
        number = texts.column("block")[0].as_py()
        found = load(texts).shared(*common_keys(common), bits, inner)
        return rows([(number, bucket, b"".join(s.pieces), np.array([len(x) for x in s.pieces], dtype=np.uint8).tobytes(), s.least.tobytes(), s.inner.astype("<u4").tobytes()) for bucket, s in found.items()])

    def fourth(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        n = [np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in table.column("b").to_pylist()]
        least, each = ([np.frombuffer(x, dtype=t) for x in table.column(c).to_pylist()] for c, t in (("c", np.int64), ("d", "<u4")))
        answers = repeated([x.as_buffer() for x in table.column("a")], n, least, inner=each)
        return rows([(block, bucket, None, x, None, None) for block, bucket, x in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), answers, strict=True)])

    def fifth(texts: pa.Table, facts: pa.Table) -> pa.Table:
        block = load(texts) if texts.num_rows else Block([], [])
        asked = facts.filter(pa.compute.is_valid(facts.column("a")))
        told = facts.filter(pa.compute.is_null(facts.column("a")))
        found = block.shared(*common_keys(asked), bits, inner)
        gone = marks(block, found, dict(zip(told.column("bucket").to_pylist(), told.column("b").to_pylist(), strict=True)))
        out = cut_out(block, gone)
        if not with_text:
            out["kept"] = [None] * len(out["id"])
        return pa.table({"id": pa.array(out["id"], pa.int64()), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.binary())})

    outlines = own.groupBy("block").applyInArrow(first, message)
    common = outlines.groupBy("bucket").applyInArrow(second, message)
    pieces = own.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(third, message)
    answers = pieces.groupBy("bucket").applyInArrow(fourth, message)
    facts = common.unionByName(answers)
    done = own.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(fifth, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    done = done.withColumnRenamed("id", id_col)
    return done if with_text else done.drop("kept")
