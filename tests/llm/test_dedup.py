"""Exact, near and substring deduplication against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash

from quern.llm import components, exact, simhash, substrings


def plain_exact(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        t = t or ""
        groups[b"".join(t.encode().split())].append((-len(t), d is None, d if d is not None else 0, i))
    out = []
    for i, (d, t) in enumerate(rows):
        norm = b"".join((t or "").encode().split())
        best = min(groups[norm])
        out.append((d, None if best[1] else best[2], len(groups[norm]), best[3] == i, hashlib.sha256(norm).hexdigest()))
    return out


def shown(rows):
    return sorted(map(repr, rows))


def test_exact_against_plain(spark, documents, odd, empty):
    for df in (documents, odd, empty):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = [tuple(r) for r in exact.decisions(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
        want = plain_exact(rows)
        # of rows that tie in all they have, it is open which one stays
        assert shown(got) == shown(want)
        kept = exact.dedup(df)
        assert kept.columns == df.columns
        assert sorted(map(repr, (r.doc_id for r in kept.select("doc_id").collect()))) == sorted(repr(d) for d, _, _, k, _ in want if k)


def test_many_survivors_go_through_a_bitmap_and_no_text_is_shuffled(documents, odd, monkeypatch):
    docs = documents.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = exact.outlined(docs.select("doc_id", "text"), docs["text"])
    alive = exact.survivors(rows)
    few = sorted(map(repr, exact.groups(docs).collect()))
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 1)
    passed = exact.among(rows, alive)
    assert "hashpartitioning" not in passed._jdf.queryExecution().executedPlan().toString()
    assert passed.join(alive, ["__len", "__prefix"], "left_semi").count() == rows.join(alive, ["__len", "__prefix"], "left_semi").count()
    assert sorted(map(repr, exact.groups(docs).collect())) == few


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_plain(documents, odd, empty):
    for df in (documents, odd, empty):
        rows = df.select("doc_id", "text").collect()
        fps = [plain_fingerprint(r.text) for r in rows]
        root = plain_components(fps)
        least = {}
        for r, c in zip(rows, root, strict=True):
            if r.doc_id is not None:
                least[c] = min(least.get(c, r.doc_id), r.doc_id)
        want = [(r.doc_id, f"{f:016x}", least.get(c)) for r, f, c in zip(rows, fps, root, strict=True)]
        got = [tuple(r) for r in simhash.groups(df).select("doc_id", "fingerprint", "component_id").collect()]
        assert shown(got) == shown(want)
        kept = simhash.dedup(df)
        assert kept.columns == df.columns
        assert sorted(map(repr, (r.doc_id for r in kept.select("doc_id").collect()))) == sorted(repr(least.get(c)) for c in set(root))


def test_links_of_clusters_and_large_buckets(spark, monkeypatch):
    """Many fingerprints that share a bucket are dealt out in blocks and lose no link."""
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randint(40, 63)
            fps.add(x)
    base = rng.getrandbits(16)
    fps |= {base | rng.getrandbits(8) << 16 | rng.getrandbits(40) << 24 for _ in range(300)}
    fps = sorted(fps)
    root = plain_components(fps)
    want = defaultdict(set)
    for f, c in zip(fps, root, strict=True):
        want[c].add(simhash.signed(f))
    df = spark.createDataFrame([(simhash.signed(f), simhash.signed(f)) for f in fps], "fp bigint, node bigint")
    for block in (2048, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = {r.node: r.root for r in components.components(simhash.links(df), 0 if block == 16 else components.FEW).collect()}
        got = defaultdict(set)
        for f in fps:
            f = simhash.signed(f)
            got[found.get(f, f)].add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_chains_pass_all_pairs_within_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for k in range(300):
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    found = set()
    for start in range(4):
        i, j = simhash.chains(a, b, start)
        found |= set(zip(i.tolist(), j.tolist()))
    want = {(i, j) for i in range(300) for j in range(300) if (int(a[i]) ^ int(b[j])).bit_count() <= 3}
    assert found == want


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 200), (7, 7), (400, 401), (401, 402), (402, 400)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    for few in (components.FEW, 0):
        got = {r.node: r.root for r in components.components(df, few).collect()}
        assert got == {**{i: 0 for i in range(1, 101)}, 300: 200, 401: 400, 402: 400}
        assert components.components(df.limit(0), few).count() == 0


def plain_substrings(rows):
    key = lambda i: 1 << 63 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                mask[p : p + 50] = True
        mask = mask[: len(b)]
        spans = int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def test_substrings_against_plain(documents, odd, empty, monkeypatch):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for df, block, hot in ((documents, 2 << 20, 200_000), (odd, 5000, 200_000), (empty, 5000, 2), (documents, 20_000, 200_000), (documents, 20_000, 2), (odd, 5000, 3)):
        monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
        monkeypatch.setattr(substrings, "BUCKET_TEXT", block)
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = [tuple(r) for r in substrings.dedup(df, hot_docs=hot).select(*columns).collect()]
        assert shown(got) == shown(plain_substrings(rows))
    kept = substrings.dedup(documents, with_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in kept)


def test_substrings_by_groups_of_buckets(documents, odd, monkeypatch):
    """Several buckets in a group, of usual pieces and of single windows, and blocks that grow."""
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for df, block, text, hot in ((documents, 20_000, 5_000, 200_000), (documents, 20_000, 5_000, 3), (odd, 5_000, 1_000, 2)):
        for name, value in (("BLOCK_BYTES", block), ("BUCKET_TEXT", text), ("LEAST_GROUPS", 1), ("GROUP_BITS", 3), ("BLOCKS", 4)):
            monkeypatch.setattr(substrings, name, value)
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        size = sum(len((t or "").encode()) for _, t in rows)
        assert substrings.layout(size).inner == 3 and substrings.layout(size).blocks < -(-size // block)
        got = [tuple(r) for r in substrings.dedup(df, hot_docs=hot).select(*columns).collect()]
        assert shown(got) == shown(plain_substrings(rows))


def test_substrings_rows_follow_the_text():
    """Rows that blocks send, by the settings for 1, 10 and 51 GB of text, on a block of that size: as many for each GB."""
    rng = np.random.default_rng(5)
    sent = []
    for size in (1 << 30, 10 << 30, 51 << 30):
        blocks, bits, inner = substrings.layout(size)
        found = substrings.outline(substrings.Block([1], [rng.bytes(size // blocks)]), bits)
        assert size >> bits + inner <= substrings.BUCKET_TEXT and size / blocks <= 8 << 20 and size >> bits <= 16 << 20
        sent.append(len(found) * blocks / (size >> 30))
    assert max(sent) <= 600_000


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    for alphabet in (b"ab", b"\0a", bytes(range(256)), b"a"):
        data = bytes(rng.choice(alphabet) for _ in range(700)) + b"ab" * 50
        array = np.frombuffer(data, dtype=np.uint8)
        sa, low = substrings.suffix_array(array)
        assert sorted(sa.tolist()) == list(range(len(data)))
        assert [data[i : i + 64] for i in sa] == sorted(data[i : i + 64] for i in range(len(data)))
        lcp = substrings.common_prefixes(array, sa, low)
        for k in range(1, len(sa)):
            a, b = data[sa[k - 1] :][:64], data[sa[k] :][:64]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_shards_merge_by_binary_search():
    """Pieces dealt to many small suffix arrays give the answer of one; windows that differ only in zeros at their ends differ."""
    rng = random.Random(4)
    pieces = [[bytes(rng.choice(b"\0a") for _ in range(rng.randint(50, 60))) for _ in range(30)] for _ in range(6)]
    for p in pieces[1:]:
        p[:10] = pieces[0][5:15]
    pieces[2][11], pieces[3][11] = b"a" * 48 + b"\0\0", b"a" * 48 + b"\0a"
    raws = [b"".join(p) for p in pieces]
    lengths = [np.array([len(x) for x in p]) for p in pieces]
    docs = [np.array([rng.randint(0, 99) for _ in p]) for p in pieces]
    one = substrings.repeated(raws, lengths, docs, shard_bytes=1 << 30)
    for shard_bytes, merged in ((1, 1 << 18), (1, 7), (400, 50), (400, 1)):
        assert substrings.repeated(raws, lengths, docs, shard_bytes, merged) == one


def test_shards_of_the_test_data_are_merged(spark, monkeypatch):
    """The operator's steps without Spark, with the settings it uses itself: buckets have several suffix arrays, and merging decides."""
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    size = sum(len(t) for _, t in rows)
    n = -(-size // substrings.BLOCK_BYTES)
    bits = (-(-size // substrings.BUCKET_TEXT) - 1).bit_length()
    blocks = [substrings.Block([i for i, _ in rows[k::n]], [t for _, t in rows[k::n]]) for k in range(n)]
    told = [(k, *x) for k, b in enumerate(blocks) for x in substrings.outline(b, bits)]
    keys = defaultdict(lambda: ([], [], []))
    for bucket in {x[1] for x in told}:
        own = [x for x in told if x[1] == bucket]
        for (k, *_), (usual, hot) in zip(own, substrings.in_common([x[2] for x in own], [x[3] for x in own]), strict=True):
            for list_, x in zip(keys[k], (bucket, usual, hot), strict=True):
                list_.append(x)
    shared = [b.shared(substrings.full_keys(keys[k][0], keys[k][1]), substrings.full_keys(keys[k][0], keys[k][2]), bits) for k, b in enumerate(blocks)]
    merges, changed = [], []
    merge = substrings.merge

    def counted(sides):
        found = merge(sides)
        merges.append(len(sides))
        changed.append(sum(int((f != m).sum()) for f, (_, m) in zip(found, sides, strict=True)))
        return found

    monkeypatch.setattr(substrings, "merge", counted)
    answers = [{} for _ in blocks]
    for bucket in set().union(*shared):
        of = [k for k, s in enumerate(shared) if bucket in s]
        found = substrings.repeated([b"".join(shared[k][bucket].pieces) for k in of], [np.array([len(p) for p in shared[k][bucket].pieces]) for k in of], [shared[k][bucket].least for k in of])
        for k, x in zip(of, found, strict=True):
            answers[k][bucket] = x
    assert len(merges) > 0 and min(merges) > 1 and sum(changed) > 0
    got = [(i, n, r, s, h) for b, s_, a in zip(blocks, shared, answers, strict=True) for i, n, r, s, h, _ in zip(*substrings.cut_out(b, substrings.marks(b, s_, a)).values(), strict=True)]
    assert shown(got) == shown(plain_substrings([(i, t.decode()) for i, t in rows]))


def test_substrings_refuse_other_ids(spark):
    import pytest

    with pytest.raises(TypeError, match="integers"):
        substrings.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
