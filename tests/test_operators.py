"""Filters, merges, lifecycle, SPMD runs, and the queries against DuckDB."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern.operators import lifecycle, relational, spmd
from quern.plans import engine, reference

SF = "/root/testdata/sf0.001"


def norm(rows, columns):
    def value(v):
        return None if v is None or v != v else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(repr(tuple(value(r[c]) for c in columns)) for r in rows)


@pytest.mark.parametrize("name", [*reference.QUERIES, *engine.QUERIES])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = [dict(zip(columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(got.columns) == sorted(columns)
    assert norm([r.asDict() for r in got.collect()], sorted(columns)) == norm(rows, sorted(columns))


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, s string")
    assert relational.where(df).count() == 3 and relational.where(df, s=None).count() == 3
    assert relational.where(df, s=["a", "b"], k=2).collect()[0].k == 2
    assert relational.one(df, k=1).s == "a"
    with pytest.raises(KeyError):
        relational.one(df, k=9)
    for limit in (0, -1):
        assert relational.latest(df, limit, "k", "k").count() == 3
    assert [r.k for r in relational.latest(df, 2, "k", "k").collect()] == [3, 2]


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    plan = relational.where(df, o_orderstatus=["O", "P"], o_custkey=7).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(o_orderstatus" in plan and "EqualTo(o_custkey,7)" in plan
    assert "o_totalprice" not in plan


def test_merges(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, "z"), ("b", 1, 5, None)], "k string, page int, n int, v string")
    assert {r.k: r.v for r in relational.merge_pages(df, "k", "page", "n").collect()} == {"a": "z", "b": None}
    m = spark.range(1).select(relational.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2))).alias("m")).first().m
    assert m == {"a": 1, "b": 2}


def test_row_numbers_have_no_gaps(spark):
    rows = relational.row_numbers(spark.range(1000).repartition(7), "id").collect()
    assert all(int(r.message_id) == r.id + 1 for r in rows) and len(rows) == 1000


def test_status(spark):
    rows = [("s", 1, "creating"), ("s", 2, "running"), ("s", 3, "completed"), ("t", 1, "running"), ("u", 1, "creating"), ("u", 2, "failed"), ("u", 3, "running")]
    df = spark.createDataFrame(rows, "id string, n int, status string")
    assert {r.id: r.status for r in lifecycle.last_status(df, "id", "status", "n").collect()} == {"s": "completed", "t": "running", "u": "running"}
    assert {(r.id, r.n) for r in lifecycle.illegal_steps(df, "id", "status", "n").collect()} == {("t", 1), ("u", 3)}


def test_reuse(spark):
    start = datetime(2024, 1, 1)
    rows = [(2, start + timedelta(minutes=m)) for m in (0, 20, 41, 41)] + [(4, start)]
    got = lifecycle.reuse_groups(spark.createDataFrame(rows, "n int, ts timestamp_ntz"), "n", "ts").collect()
    assert sorted((r.n, r.resource) for r in got) == [(2, 1), (2, 1), (2, 2), (2, 2), (4, 1)]


def test_gather(spark):
    found = spmd.run(spark, lambda w: w.gather((w.rank + 1) ** 2), 2)
    assert found == [[1, 4], None]
    assert spmd.run(spark, lambda w: (w.rank, w.size, w.values["x"]), 3, {"x": 7}) == [(0, 3, 7), (1, 3, 7), (2, 3, 7)]
    assert spmd.run_files(spark, ["a = 1", "result = worker.gather(worker.rank)"], 2) == [[0, 1], None]


def test_worker_failure_reaches_the_caller(spark):
    def fail(w):
        raise ValueError(f"Error on worker {w.rank}")

    with pytest.raises(Exception, match="Error on worker"):
        spmd.run(spark, fail, 2)


def test_too_many_workers_are_refused(spark):
    with pytest.raises(Exception, match="SPARK-24819|SPARK-24820|slots|barrier"):
        spmd.run(spark, lambda w: w.rank, 64)


def test_threshold_comes_through_scatter(spark, monkeypatch):
    sf, run = "/root/testdata/sf0.001", spmd.run
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert reference.scatter_threshold(spark, sf).count() == rows.where("l_quantity > 30").count()
    monkeypatch.setattr(spmd, "run", lambda spark, fn, n, scatter: run(spark, fn, n, {"threshold": scatter["threshold"] + 15}))
    assert reference.scatter_threshold(spark, sf).count() == rows.where("l_quantity > 45").count()


def test_places_and_order_of_a_hot_group(spark):
    from quern.streaming import messages

    rows = [(k, "hot" if k % 10 else f"g{k % 3}", f"d{k // 2}", k * 7919 % 10_007) for k in range(5000)] + [(9999, None, "n", 20_000)]
    df = spark.createDataFrame(rows, "id bigint, group_id string, dedup_id string, seq bigint").repartition(7)
    got = sorted((r.seq, r["__place"]) for r in relational.places(df, "seq").collect())
    assert [p for _, p in got] == list(range(5001))
    assert [r.message_id for r in relational.row_numbers(df, "seq").orderBy("seq").collect()] == [str(k + 1) for k in range(5001)]
    want, first = {}, {}
    for id, g, d, seq in sorted(rows, key=lambda r: r[3]):
        if (g, d) not in first:
            first[g, d] = id
            want[id] = want.get(("n", g), 0) + 1
            want["n", g] = want[id]
    assert {r.id: r.position for r in messages.in_order(df).collect()} == {k: v for k, v in want.items() if not isinstance(k, tuple)}
    empty = df.limit(0)
    assert messages.in_order(empty).count() == 0 and relational.row_numbers(empty, "seq").count() == 0


def test_lifecycle_of_a_hot_key_over_many_ranges(spark, monkeypatch):
    import random

    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), start + timedelta(minutes=rng.randrange(9000)), k, rng.choice(["creating", "running", "failed", "completed"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, at timestamp_ntz, id bigint, status string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # no ranges are put together
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert relational.ranged(df.where("key = 'hot'"), "key", "at", "id").select("__part").distinct().count() == 13
        got = {r.id: r.resource for r in lifecycle.reuse_groups(df, "key", "at", "id", minutes=5).collect()}
        bad = {(r.id, r.previous) for r in lifecycle.illegal_steps(df, "key", "status", "at", "id").collect()}
        assert lifecycle.reuse_groups(df.limit(0), "key", "at", "id").count() == 0 and lifecycle.illegal_steps(df.limit(0), "key", "status", "at", "id").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, wrong, last, number = {}, set(), {}, {}
    for key, at, id, status in sorted(rows, key=lambda r: (r[1], r[2])):
        before = last.get(key)
        if before is None or at > before[0] + timedelta(minutes=5):
            number[key] = number.get(key, 0) + 1
        want[id] = number[key]
        if status not in lifecycle.SESSION.get(before[1] if before else None, ()):
            wrong.add((id, before[1] if before else None))
        last[key] = (at, status)
    assert got == want and bad == wrong and bad
