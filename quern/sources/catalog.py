"""Catalogs of sessions and clusters as DataFrames, and a paged source that takes filters."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from quern.functions.scalars import parse_time

SESSIONS = "session_id string NOT NULL, status string, status_explanation string, start_time timestamp_ntz, end_time timestamp_ntz, num_workers int"
CLUSTERS = "name string NOT NULL, status string NOT NULL, status_explanation string, s3_bucket_arn string, organization_id string, curr_cluster_instance_id string, num_sessions_running int, num_workers_running int"
#: As they come: times are text, and an end that is not known is the empty string.
RAW_SESSIONS = "session_id string, status string, status_explanation string, start_time string, end_time string, num_workers int"
RAW_SESSIONS_BY_CLUSTER = f"{RAW_SESSIONS}, cluster_name string"
RAW_CLUSTERS = "name string, status string, status_explanation string, s3_read_write_resource string, organization_id string, curr_cluster_instance_id string, num_sessions int, num_workers_in_use int"


def sessions(raw: DataFrame) -> DataFrame:
    """Typed session records: an empty end is null, times are UTC without zone."""
    return raw.withColumns({"start_time": parse_time("start_time", strict=True), "end_time": parse_time("end_time", strict=True)})


def clusters(raw: DataFrame) -> DataFrame:
    """Typed cluster records: four optional fields have defaults (for nulls too), names and status must be there."""
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(f"a cluster record has no {c}")).otherwise(F.col(c))
    return raw.select(
        need("name").alias("name"), need("status").alias("status"), F.coalesce("status_explanation", F.lit("")).alias("status_explanation"),
        F.col("s3_read_write_resource").alias("s3_bucket_arn"), "organization_id", F.coalesce("curr_cluster_instance_id", F.lit("")).alias("curr_cluster_instance_id"),
        F.coalesce("num_sessions", F.lit(0)).alias("num_sessions_running"), F.coalesce("num_workers_in_use", F.lit(0)).alias("num_workers_running"),
    )


class ServiceError(RuntimeError):
    pass


def decode_response(status: int, body: str):
    """The parsed body of a reply. 403 and 500 fail with the body's text, 502 with a fixed one, 504 (no answer in time) is None.
    The status is looked at before the body is parsed."""
    if status == 504:
        return None
    if status == 502:
        raise ServiceError("the service could not be reached; try again later")
    if status == 403:
        raise PermissionError(f"the credentials were refused: {body}")
    if status == 500:
        raise ServiceError(body)
    return json.loads(body)


def http_transport(url: str, headers: dict[str, str] | None = None, timeout: float = 30) -> Callable[[str, str], tuple[int, str]]:
    """A transport for ``request``: POST to the method's name below ``url``. A reply with an error's status is a reply."""

    def send(method: str, body: str) -> tuple[int, str]:
        call = urllib.request.Request(f"{url.rstrip('/')}/{method}", body.encode(), {"content-type": "application/json", **(headers or {})}, method="POST")
        try:
            with urllib.request.urlopen(call, timeout=timeout) as reply:
                return reply.status, reply.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    return send


def request(transport: Callable[[str, str], tuple[int, str]], method: str, content: dict, debug: bool = False):
    """Send a JSON request for ``method`` (its underscores become hyphens). ``content`` is left as it is."""
    return decode_response(*transport(method.replace("_", "-"), json.dumps({**content, "debug": debug})))


def paged_source(name: str, schema: str, fetch: Callable[[dict, object], tuple[Iterable, object]], pushed: tuple[str, ...] = (), starts: Callable[[dict], list] | None = None) -> type[DataSource]:
    """A Python data source over ``fetch(filters, cursor) -> (rows, next cursor)``; the last page's cursor is None.

    Equality and membership over the columns in ``pushed`` go to ``fetch`` (column: value, or a list); Spark applies the rest.
    Pages depend on each other's cursor, so they are read one after another, row by row as they come. Where the service has several rows of
    pages, ``starts(filters)`` gives the first cursor of each, and each is read by a task of its own. A page has tuples, or batches of Arrow if all pages do.
    Filters reach the source with spark.sql.python.filterPushdown.enabled.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.filters: dict[str, object] = {}

        def pushFilters(self, filters: list[Filter]):
            for f in filters:
                column = ".".join(f.attribute) if isinstance(f, EqualTo | In) else None
                if column in pushed and column not in self.filters:
                    self.filters[column] = list(f.value) if isinstance(f, In) else f.value
                else:
                    yield f

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(c) for c in ([None] if starts is None else starts(self.filters))]

        def read(self, partition: InputPartition | None) -> Iterator:
            if partition is None:  # Spark's, if there are none
                return
            rows, cursor = fetch(self.filters, partition.value)
            yield from rows
            while cursor is not None:
                rows, cursor = fetch(self.filters, cursor)
                yield from rows

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(self.options)

    return Source


def pages_of(records: list[tuple], names: list[str], size: int) -> Callable[[dict, object], tuple[list[tuple], object]]:
    """A ``fetch`` for ``paged_source`` over records held here, as a service would answer: filtered, in pages of ``size``."""

    def fetch(filters: dict, cursor: object) -> tuple[list[tuple], object]:
        at = {n: i for i, n in enumerate(names)}
        fits = lambda r: all(r[at[c]] in v if isinstance(v, list) else r[at[c]] == v for c, v in filters.items())
        found = [r for r in records if fits(r)]
        start = cursor or 0
        return found[start : start + size], start + size if start + size < len(found) else None

    return fetch


def read_paged(spark: SparkSession, source: type[DataSource]) -> DataFrame:
    """The source as a DataFrame. Filters are pushed unless the user has set that otherwise."""
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", None) is None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()
