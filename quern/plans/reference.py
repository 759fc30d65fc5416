"""Queries that apply the engine's own operators to the driver's tables, each with equivalent SQL.

The tables hold no sessions or clusters, so each query uses a stand-in: orders for sessions, events for messages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import lifecycle, relational, spmd
from quern.streaming import messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(table: str | None, sql: str | None):
    """Register a query over one table; its SQL beside it."""

    def register(fn):
        name = fn.__name__
        QUERIES[name] = (lambda spark, sf_dir: fn(_t(spark, sf_dir, table))) if table else (lambda spark, sf_dir: fn(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


ORDER = ["o_orderkey", "o_orderstatus", "o_orderdate"]


@query("orders", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'O'")
def filter_eq(df):
    return relational.where(df, o_orderstatus="O").select(ORDER)


@query("orders", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P')")
def filter_in(df):
    return relational.where(df, o_orderstatus=["O", "P"]).select(ORDER)


@query("orders", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '1-URGENT'")
def filter_conj(df):
    return relational.where(df, o_orderstatus=["O", "P"], o_orderpriority="1-URGENT", o_custkey=None).select(ORDER)


@query("orders", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders")
def filter_none(df):
    return relational.where(df, o_orderstatus=None).select(ORDER)


@query("nation", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 3")
def point_lookup(df):
    return relational.where(df, n_nationkey=3).select("n_nationkey", "n_name")


@query("part", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small') OR starts_with(p_name, 'hot ')")
def prefix_filter(df):
    return relational.with_prefix(df, "p_name", "small").union(relational.with_prefix(df, "p_name", "hot ")).select("p_partkey", "p_name")


@query("orders", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def latest_n(df):
    return relational.latest(relational.where(df, o_orderstatus=["O", "P"]), 50, "o_orderdate", "o_orderkey").select(ORDER)


@query("events", """SELECT event_id, try_cast(nullif(CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'no time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END, '') AS TIMESTAMP) AS end_time FROM events""")
def empty_to_null_ts(df):
    text = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 7 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return df.select("event_id", S.parse_time(text).alias("end_time"))


@query("events", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.none'), '') AS none FROM events")
def default_projection(df):
    return df.select("event_id", S.default(F.get_json_object("props", "$.k").cast("long"), 0).alias("k"), S.default(F.get_json_object("props", "$.none"), "").alias("none"))


@query("events", "SELECT user_id, arg_max(event_type, (event_id % 4, ts, event_id)) AS event_type, arg_max(event_id, (event_id % 4, ts, event_id)) AS event_id FROM events GROUP BY user_id")
def page_merge(df):
    pages = df.select("user_id", "event_type", "event_id", "ts", (F.col("event_id") % 4).alias("page"))
    return relational.merge_pages(pages, "user_id", "page", "ts", "event_id").select("user_id", "event_type", "event_id")


@query("orders", "SELECT coalesce(bool_and(o_orderstatus IN ('O', 'P', 'F')), true) AS all_known, coalesce(bool_and(o_orderstatus = 'O') FILTER (WHERE o_orderkey < 0), true) AS all_of_none FROM orders")
def all_match(df):
    known, none = F.col("o_orderstatus").isin("O", "P", "F"), (F.col("o_orderkey") >= 0) | (F.col("o_orderstatus") == "O")  # of no rows, all match
    return relational.all_match(df, all_known=known, all_of_none=none)


@query("customer", "SELECT count(*) AS n FROM customer")
def count_rows(df):
    return relational.count(df)


@query("customer", "SELECT c_name, c_custkey FROM customer ORDER BY c_name, c_custkey LIMIT 1")
def first_by_name(df):
    return relational.first_by(df, "c_name", "c_custkey").select("c_name", "c_custkey")


@query(None, """SELECT r_regionkey, e.key AS key, e.value AS value FROM (
    SELECT r_regionkey, unnest(map_entries(map_concat(MAP {'name': r_name, 'kind': 'region'}, MAP {'kind': 'area', 'number': CAST(r_regionkey AS VARCHAR)}))) AS e FROM region)""")
def map_merge(spark, sf_dir):
    a = F.create_map(F.lit("name"), F.col("r_name"), F.lit("kind"), F.lit("region"))
    b = F.create_map(F.lit("kind"), F.lit("area"), F.lit("number"), F.col("r_regionkey").cast("string"))
    return _t(spark, sf_dir, "region").select("r_regionkey", F.explode(relational.merge_maps(a, b)))


@query("documents", "SELECT doc_id, sha256(text) AS hash FROM documents")
def sha256_text(df):
    return df.select("doc_id", S.sha256_hex("text").alias("hash"))


_UNITS = ", ".join(f"('{k}', {float(v)!r}::DOUBLE)" for k, v in (("", 1), ("B", 1), ("kB", 1000), ("MB", 1000**2), ("GB", 1000**3), ("TB", 1000**4), ("KiB", 1024), ("MiB", 1024**2), ("GiB", 1024**3), ("PiB", 1024**5), ("furlong", 0)))


@query("supplier", f"""WITH u(unit, factor) AS (VALUES {_UNITS}), s AS (SELECT s_suppkey, (s_suppkey % 1500) / 4.0 AS n, unit, nullif(factor, 0) AS factor FROM supplier, u WHERE s_suppkey % 11 = length(unit) OR unit IN ('GiB', 'furlong'))
    SELECT s_suppkey, unit, CAST(n AS DOUBLE) * factor AS bytes, coalesce(CAST(ceil(CAST(n AS DOUBLE) * factor / 1073741824.0) AS BIGINT), -2) AS gib FROM s""")
def parse_bytes(df):
    units = ["", "B", "kB", "MB", "GB", "TB", "KiB", "MiB", "GiB", "PiB", "furlong"]
    df = df.withColumn("unit", F.explode(F.array(*map(F.lit, units)))).where((F.col("s_suppkey") % 11 == F.length("unit")) | F.col("unit").isin("GiB", "furlong"))
    text = F.concat_ws(" ", ((F.col("s_suppkey") % 1500) / 4.0).cast("string"), "unit")
    return df.select("s_suppkey", "unit", S.parse_bytes(text).alias("bytes"), F.coalesce(S.disk_capacity(text), F.lit(-2)).alias("gib"))


@query("supplier", "SELECT s_suppkey, 'bucket-' || s_suppkey AS name, 'arn:aws:s3:::bucket-' || s_suppkey AS arn, 'get-session-' || s_suppkey AS endpoint FROM supplier")
def bucket_names(df):
    name = F.concat(F.lit("bucket-"), "s_suppkey")
    tail = F.element_at(F.array(F.lit(""), F.lit("/"), F.lit("*"), F.lit("/*")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return df.select("s_suppkey", S.arn_to_name(F.concat(S.name_to_arn(name), tail)).alias("name"), S.name_to_arn(name).alias("arn"), S.endpoint(F.concat(F.lit("get_session_"), "s_suppkey")).alias("endpoint"))


@query("pages", r"""SELECT page_id, list_extract(string_split(url, '/'), -1) AS base, replace('file://' || url, 'file://', '') AS plain,
    split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS bucket, regexp_replace(url, '^https?://[^/]*/', '') AS key FROM pages""")
def url_parts(df):
    both = S.split_object_url(F.regexp_replace("url", "^https?://", "s3://"))
    names = S.basenames(F.array("url"))
    return df.select("page_id", names[0].alias("base"), S.strip_file_scheme(F.concat(F.lit("file://"), "url")).alias("plain"), both["bucket"].alias("bucket"), both["key"].alias("key"))


@query("events", "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS at FROM events")
def local_time(df):
    return df.select("event_id", S.local_time("ts", "America/Los_Angeles").alias("at"))


@query("region", "SELECT r_regionkey, to_base64(encode(repeat(r_name, 20))) AS contents, repeat(r_name, 20) AS value FROM region")
def b64_roundtrip(df):
    contents = S.encode_value(F.repeat("r_name", F.lit(20)))
    return df.select("r_regionkey", contents.alias("contents"), S.decode_value(contents).cast("string").alias("value"))


@query("events", "SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) AS VARCHAR) AS message_id FROM events")
def message_id(df):
    return relational.row_numbers(df.select("event_id"), "event_id")


@query(None, "SELECT i AS attempt, least(80.0, 5 * pow(2, i)) AS seconds FROM range(12) t(i)")
def backoff(spark, sf_dir):
    return spark.range(12).select(F.col("id").alias("attempt"), S.backoff("id").alias("seconds"))


@query("customer", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, 'file') AS chosen FROM customer""")
def precedence(df):
    return df.select("c_custkey", S.first_given(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.lit("file")).alias("chosen"))


@query(None, "SELECT i AS rank, (i + 1) * (i + 1) AS value FROM range(2) t(i)")
def spmd_gather(spark, sf_dir):
    found = spmd.run(spark, lambda w: w.gather((w.rank + 1) ** 2), 2)
    return spark.createDataFrame(list(enumerate(found[0])), "rank bigint, value bigint")


@query("orders", "SELECT o_orderkey, (o_orderkey + 1) * (o_orderkey + 1) AS value FROM orders")
def kernel(df):
    return df.select("o_orderkey", S.kernel("o_orderkey").alias("value"))


@query(None, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30")
def scatter_threshold(spark, sf_dir):
    arrived = spmd.run(spark, lambda w: w.values["threshold"], 2, scatter={"threshold": 30})
    over = [F.col("l_quantity") > x for x in arrived]  # what each worker got
    return _t(spark, sf_dir, "lineitem").where(over[0] & over[1]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("events", """WITH m AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'SESSION_READY' WHEN 'click' THEN 'EVALUATION_ENDok ' || user_id || 'MESSAGE_END'
      WHEN 'error' THEN 'JOB_FAILUREbad ' || user_id WHEN 'signup' THEN '{"kind":"GATHER","value_id":"' || user_id || '"}' ELSE 'noise' END AS body FROM events)
    SELECT event_id, CASE WHEN starts_with(body, 'SESSION_READY') THEN 'ready' WHEN starts_with(body, 'EVALUATION_END') THEN 'done' WHEN starts_with(body, 'JOB_FAILURE') THEN 'failed'
      WHEN starts_with(body, '{') THEN 'GATHER' END AS kind, ends_with(body, 'MESSAGE_END') AS end,
      CASE WHEN starts_with(body, 'EVALUATION_END') OR starts_with(body, 'JOB_FAILURE') THEN regexp_replace(regexp_replace(body, '^(EVALUATION_END|JOB_FAILURE)', ''), 'MESSAGE_END$', '') END AS text FROM m""")
def message_kind(df):
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    body = (
        F.when(kind == "view", F.lit("SESSION_READY")).when(kind == "click", F.concat(F.lit("EVALUATION_ENDok "), user, F.lit("MESSAGE_END")))
        .when(kind == "error", F.concat(F.lit("JOB_FAILUREbad "), user)).when(kind == "signup", F.concat(F.lit('{"kind":"GATHER","value_id":"'), user, F.lit('"}'))).otherwise("noise")
    )
    return messages.parsed(df.select("event_id", body.alias("body"))).drop("body")


@query("events", """WITH d AS (SELECT event_id, user_id % 7 AS g, event_id // 3 AS id FROM events), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY event_id) = 1)
    SELECT g AS group_id, id AS dedup_id, event_id AS seq, row_number() OVER (PARTITION BY g ORDER BY event_id) AS position FROM f""")
def fifo_dedup(df):
    rows = df.select((F.col("user_id") % 7).alias("group_id"), F.floor(F.col("event_id") / 3).alias("dedup_id"), F.col("event_id").alias("seq"))
    return messages.in_order(rows).withColumn("position", F.col("position").cast("long"))


@query("events", """WITH g AS (SELECT event_id, user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 20 MINUTE, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, CAST(sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS resource FROM g""")
def reuse_groups(df):
    return lifecycle.reuse_groups(df, "user_id", "ts", "event_id").select("user_id", "event_id", "resource")


@query("events", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def last_status(df):
    return lifecycle.last_status(df, "user_id", "event_type", "ts", "event_id")


@query("events", """WITH e AS (SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_type AS status FROM events)
    SELECT event_id, previous, status FROM e WHERE NOT ((previous IS NULL AND status = 'signup') OR (previous = 'signup' AND status IN ('view', 'error')) OR (previous = 'view' AND status IN ('click', 'error')) OR (previous = 'click' AND status = 'purchase')
      ) OR (previous IS NULL AND status <> 'signup')""")
def illegal_steps(df):
    steps = {None: ("signup",), "signup": ("view", "error"), "view": ("click", "error"), "click": ("purchase",)}
    return lifecycle.illegal_steps(df, "user_id", "event_type", "ts", "event_id", steps=steps).select("event_id", "previous", F.col("event_type").alias("status"))
