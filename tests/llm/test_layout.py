"""Mixing, packing, sharding and the pipeline against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import common, exact, mixing, packing, quality, sharding, simhash

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full, goal = share * sum(sizes.values()), set(), {}
    while True:
        rest = budget - sum(cap * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        goal = {s: cap * sizes[s] if s in full else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in full and goal[s] > cap * sizes[s]}
        if not over:
            return goal
        full |= over


def test_mixing_targets_and_reruns(documents, odd, empty, monkeypatch):
    for df, bucket in ((documents, 20_000), (documents, 7), (odd, 2)):
        monkeypatch.setattr(common, "BUCKET_ROWS", bucket)
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
        sizes = defaultdict(int)
        for r in df.select("source", "text").collect():
            sizes[r.source] += len((r.text or "").encode().split())
        goal = plain_targets(sizes)
        rows = mixing.table_of(df.select("doc_id", "source", "text")).collect()
        assert len(rows) == df.count()
        named = mixing.mixed(df).collect()
        taken, largest = defaultdict(int), max(r.size for r in rows)
        for r in named:
            assert r["__target"] == pytest.approx(goal[r.source]) and r["__source_size"] == sizes[r.source]
            taken[r.source] += r["__size"] * r["__copies"]
        assert sum(taken.values()) <= 1.5 * sum(sizes.values())
        for s in sizes:
            assert abs(taken[s] - goal[s]) <= largest
        assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
        again = mixing.table_of(df.repartition(5)).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))
        mix = mixing.mix(df)
        assert mix.columns == df.columns and mix.count() == sum(r["__copies"] for r in named)
    assert mixing.table_of(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_ranges_do_not_change_the_mix(documents, monkeypatch):
    found = []
    for bucket in (20_000, 11):
        monkeypatch.setattr(common, "BUCKET_ROWS", bucket)
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
        found.append(sorted(map(repr, mixing.table_of(documents).collect())))
    assert found[0] == found[1]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_tokenizer(spark):
    path, plain = tokenizer()
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "'", " re", "é", "12", ".", "!!", "<|endoftext|>", "\r", "日本", "\0", " ", "Ünïcödé", "’"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    own = packing.Encoder(path)
    assert own.fast and list(own.many(texts)) == want


def test_encoder_equals_the_tokenizer_on_all_characters():
    """Characters that every version of Unicode classes alike take the fast way, all others the tokenizer's; the ids are its own."""
    path, plain = tokenizer()
    rng = random.Random(2)
    settled = packing._settled()
    kinds = {True: [], False: []}
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            kinds[bool(settled.fullmatch(chr(c)))].append(chr(c))
    usual = [" ", "  ", "\n", "a", "the", "'s", "12", ".", "\x0b", "\x85"]
    texts = ["".join(rng.choice(usual) if rng.random() < 0.5 else rng.choice(kinds[k]) for _ in range(rng.randint(0, 30))) for k in (True, False) for _ in range(10_000)]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert list(packing.Encoder(path).many(texts)) == want


def test_long_texts_are_encoded_in_parts(monkeypatch):
    path, plain = tokenizer()
    rng = random.Random(3)
    usual = [" ", " ", "  ", "\n", "a", "the", "'s", "12", "7 ", ".", "é", "ß", "ꟑ", "<|endoftext|>", "日本", " x"]
    texts = ["".join(rng.choice(usual) for _ in range(2000)) for _ in range(300)] + ["a" * 5000, " " * 5000, "word " * 2000]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    own = packing.Encoder(path)
    for part in (1 << 18, 50, 1):
        monkeypatch.setattr(packing, "PART", part)
        assert list(own.many(texts)) == want
        assert all("".join(packing._parts(t)) == t for t in texts)


def test_encoder_of_another_kind():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, texts = Tokenizer.from_file(path), ["Some words, and 12 more", "", "a<|b"]
    own = packing.Encoder(path)
    assert own.fast is None
    assert list(own.many(texts)) == [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def packed(rows, want):
    """Checks a packing against the ids it must hold."""
    found, places = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    need = defaultdict(list)
    for d, ids in want:
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        need[d] += [(i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in need.items()}
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places)


def test_packing_against_plain(documents, odd, empty, monkeypatch):
    _, plain = tokenizer()
    for df in (documents, odd):
        for bucket in (20_000, 3):
            monkeypatch.setattr(common, "BUCKET_ROWS", bucket)
            want = [(r.doc_id, plain.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in df.select("doc_id", "text").collect()]
            n = packed(packing.pack(df).collect(), want)
            assert n <= -(-sum(len(x) for _, x in want) // 2048) * 1.02 + 1
    assert packing.pack(empty).count() == 0


def least_bins(sizes, capacity):
    """Exact, for few items."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                bins[i] += sizes[k]
                go(k + 1, bins)
                bins[i] -= sizes[k]
        go(k + 1, [*bins, sizes[k]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_reduction_keeps_a_best_packing():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.randint(8, 40)
        sizes = [rng.randint(max(1, capacity // 5), capacity) for _ in range(rng.randint(1, 11))]
        plan = packing.Plan(Counter(sizes), capacity)
        plan.reduce()
        rest = [s for s, n in plan.left.items() for _ in range(n)]
        assert plan.sequences + (least_bins(rest, capacity) if rest else 0) == least_bins(sizes, capacity)


def test_plans_place_every_item_once():
    rng = random.Random(9)
    for capacity in (10, 100, 2048):
        counts = Counter(rng.randint(1, capacity) for _ in range(5000))
        plan = packing.plan(counts, capacity)
        ranks, fill = defaultdict(list), defaultdict(list)
        for size, first, n, sequence, offset in plan.runs:
            ranks[size] += range(first, first + n)
            for k in range(n):
                fill[sequence + k].append((offset, size))
        assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
        assert sorted(fill) == list(range(plan.sequences))
        for parts in fill.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= capacity


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(13)]
    a = sharding.lookup_table(names, 1009)
    assert set(Counter(a.tolist()).values()) <= {1009 // 13, 1009 // 13 + 1}
    b = sharding.lookup_table(names[:-1], 1009)
    moved = sum(names[x] != names[y] for x, y in zip(a, b) if x != 12)
    assert moved < 0.2 * 1009
    # the same turns, played slot by slot
    import hashlib

    digest = [hashlib.sha256(n.encode()).digest() for n in names]
    order = [[(int.from_bytes(d[:8], "big") + i * (int.from_bytes(d[8:16], "big") % 1008 + 1)) % 1009 for i in range(1009)] for d in digest]
    owner = {}
    while len(owner) < 1009:
        for s in range(13):
            if len(owner) < 1009:
                owner[next(x for x in order[s] if x not in owner)] = s
    assert [owner[i] for i in range(1009)] == a.tolist()
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1008)


def test_sharding_against_plain(documents, odd, empty):
    import hashlib

    names = [f"shard-{i:03d}" for i in range(64)]
    table = sharding.lookup_table(names)
    for df in (documents, odd, empty):
        for r in sharding.place(df).collect():
            key = "" if r.doc_id is None else str(r.doc_id)
            slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
            assert r["slot_" if "slot" in df.columns else "slot"] == slot and r.shard == names[table[slot]]
    assert sharding.place(odd).count() == odd.count()


def test_shards_are_written_whole(spark, odd, tmp_path):
    sharding.write(odd, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.columns == [*odd.columns, "shard"]
    assert sorted(map(repr, back.drop("shard").collect())) == sorted(map(repr, odd.collect()))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in sharding.place(odd).collect()}


def test_no_operator_changes_or_loses_a_column(spark, documents):
    """Rows come back as they were, in columns of every name that the operators use themselves."""
    import pathlib
    import re

    import quern.llm

    names = {n for f in pathlib.Path(quern.llm.__path__[0]).glob("*.py") for n in re.findall(r"""["'](__[a-z_0-9]+|[a-z][a-z_0-9]*)["']""", f.read_text())} - set(documents.columns)
    assert names >= {"__row", "__s", "__kept", "__size", "__sha", "slot", "shard", "keep_id", "fp", "root"}
    docs = documents.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in sorted(names | {"__key", "__fp"}))).cache()
    docs = docs.union(docs.where("doc_id % 7 = 0"))
    own = {repr(r) for r in docs.collect()}
    for f in (quality.keep, exact.dedup, simhash.dedup, mixing.mix):
        got = f(docs)
        assert got.columns == docs.columns
        rows = [repr(r) for r in got.collect()]
        assert rows and own.issuperset(rows)
    placed = sharding.place(docs)
    assert placed.columns[:-2] == docs.columns and {repr(r) for r in placed.select(docs.columns).collect()} == own


def test_lookup_is_the_same_by_broadcast_and_by_shuffle(spark):
    big = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (1, "d")], "k int, v string")
    small = spark.createDataFrame([(1, 10), (None, 20)], "k int, w int")
    a, b = (sorted(map(repr, common.lookup(big, small, ["k"], most=n).collect())) for n in (100, 1))
    assert a == b and len(a) == 4
    assert common.lookup(big, small, ["k"], "left_anti").collect()[0].v == "c"


def plain_keep(rows):
    """Rows of (id, text, source) that the quality rules keep."""
    from test_text import plain_stats

    facts = []
    for d, t, s in rows:
        n, chars, symbols, dups, repeats = plain_stats(t)
        lines = sum(bool(x.split()) for x in (t or "").encode().split(b"\n"))
        base, symbol = n < 10 or 100 * repeats > 20 * n, 100 * symbols > 10 * n
        facts.append((d, t, s, base or symbol, base or symbol or 100 * dups > 30 * lines or chars < 2 * n or chars > 15 * n))
    docs, failed = Counter(f[2] for f in facts), Counter(f[2] for f in facts if f[4])
    n = len(facts)
    mean = sum(failed.values()) / n
    between = sum(failed[s] ** 2 / docs[s] for s in docs) / n - mean**2 - mean * (1 - mean) * len(docs) / n
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    rate = {s: (failed[s] + mean * weight) / (docs[s] + weight) for s in docs}
    return [(d, t, s) for d, t, s, reject, soft in facts if not (reject or rate[s] >= 0.9 or rate[s] >= 0.35 and soft)]


def plain_mix(rows):
    """How often the mix takes each of the rows (id, text, source)."""
    import hashlib

    size = [len((t or "").encode().split()) for _, t, _ in rows]
    order = [hashlib.md5(f"mix-1:{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest() for d, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    goal = plain_targets(total)
    rank = {s: i for i, s in enumerate(sorted(total, key=lambda s: (s is None, (s or "").encode())))}
    queue, reached = [], Counter()
    for i in sorted(range(len(rows)), key=order.__getitem__):
        s = rows[i][2]
        reached[s] += size[i]
        if size[i] and goal[s]:
            queue.append((reached[s] / goal[s], rank[s], 1, order[i], i))
            if goal[s] > total[s]:
                queue.append(((total[s] + reached[s]) / goal[s], rank[s], 2, order[i], i))
    taken, spent = Counter(), 0
    for *_, i in sorted(queue):
        spent += size[i]
        if spent > 1.5 * sum(size):
            break
        taken[i] += 1
    return taken


def test_mixing_against_a_plain_queue(spark, documents, odd, monkeypatch):
    docs = documents.select("doc_id", "text", "source")
    copies = docs.where("doc_id in (3, 8)").crossJoin(spark.range(60)).drop("id")  # rows of equal id and text, of which some are taken
    for df, bucket in ((docs, 20_000), (odd, 20_000), (docs.union(copies).repartition(5), 20_000), (docs.union(copies).repartition(3), 9)):
        monkeypatch.setattr(common, "BUCKET_ROWS", bucket)
        monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
        rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
        taken = plain_mix(rows)
        want = Counter((d, len((t or "").encode().split()) * taken[i]) for i, (d, t, _) in enumerate(rows))
        assert Counter((r.doc_id, r.taken) for r in mixing.table_of(df).collect()) == want
        assert Counter(r.doc_id for r in mixing.mix(df).collect()) == sum((Counter({rows[i][0]: n}) for i, n in taken.items()), Counter())


def test_the_mix_shuffles_no_row_of_the_documents(documents):
    plan = mixing.mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan


def test_pipeline_against_a_plain_version(spark):
    from test_dedup import plain_components, plain_exact, plain_fingerprint

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = plain_keep(rows)
    rows = [r for r, (*_, stays, _) in zip(rows, plain_exact([(d, t) for d, t, _ in rows]), strict=True) if stays]
    root = plain_components([plain_fingerprint(t) for _, t, _ in rows])
    least = {}
    for (d, _, _), c in zip(rows, root, strict=True):
        least[c] = min(least.get(c, d), d)
    rows = [r for r, c in zip(rows, root, strict=True) if least[c] == r[0]]
    _, plain = tokenizer()
    want = [(rows[i][0], plain.encode(rows[i][1], add_special_tokens=False).ids + [0]) for i, n in plain_mix(rows).items() for _ in range(n)]
    assert want
    n = packed(corpus_pipeline.run(spark, SF).collect(), want)
    assert n <= -(-sum(len(x) for _, x in want) // 2048) * 1.02 + 1


def test_pipeline_against_its_stages(spark):
    """Each stage on what the one before kept, and the whole run."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix", "pack"]
    good = quality.keep(docs).cache()
    ids = {r.doc_id for r in quality.table_of(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == ids
    single = exact.dedup(good).cache()
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in exact.decisions(good).where("kept").collect()}
    apart = simhash.dedup(single).cache()
    assert {r.doc_id for r in apart.collect()} == {r.component_id for r in simhash.groups(single).collect()}
    mixed = mixing.mix(apart).cache()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r["__copies"] for r in mixing.mixed(apart).where("__copies > 0").collect()})
    _, plain = tokenizer()
    rows = corpus_pipeline.run(spark, SF).collect()
    packed(rows, [(r.doc_id, plain.encode(r.text, add_special_tokens=False).ids + [0]) for r in mixed.collect()])
    assert all(f(spark, docs, SF).columns == docs.columns for _, f in corpus_pipeline.STAGES[:-1])
