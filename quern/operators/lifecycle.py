"""State of sessions and of the resources they hold, computed from their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.lineage import cut
from quern.operators.relational import running_sum, with_previous

#: What may follow what: sessions.
SESSION = {None: ("creating",), "creating": ("running", "failed"), "running": ("completed", "failed"), "completed": (), "failed": ()}
#: What may follow what: clusters.
CLUSTER = {
    None: ("creating",), "creating": ("running", "failed"), "updating": ("running", "terminated", "failed"), "running": ("updating", "terminated", "failed"),
    "terminated": ("creating",), "failed": ("terminated",),
}


def step(before: str | None, after: str, steps: dict = SESSION) -> str:
    """``after``, if it may follow ``before`` or is the same; else a ValueError."""
    if after != before and after not in steps.get(before, ()):
        raise ValueError(f"{after!r} may not follow {before!r}")
    return after


def last_status(events: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """The last status of each key. Works on streams too, in update mode."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))


def illegal_steps(events: DataFrame, key: str, status: str, *order: str, steps: dict = SESSION) -> DataFrame:
    """Events whose status may not follow the one before, which is added as ``previous``. A key's events may lie in many tasks."""
    rows = with_previous(events, key, *order)
    before = F.when(F.col("__previous")[key].eqNullSafe(F.col(key)), F.col("__previous")[status])
    allowed = [F.struct(F.lit(a).cast("string").alias("a"), F.lit(b).alias("b")) for a, bs in steps.items() for b in bs]
    step = F.struct(F.col("previous").alias("a"), F.col(status).alias("b"))
    known = F.exists(F.array(*allowed), lambda x: x["a"].eqNullSafe(step["a"]) & x["b"].eqNullSafe(step["b"]))
    return rows.select(*events.columns, before.alias("previous")).where(~known)


def reuse_groups(events: DataFrame, key: str, time: str, *order: str, minutes: int = 20) -> DataFrame:
    """Add ``resource``: a number, per key, of the resource that an event uses. A gap of more than ``minutes`` since the
    event before gives a new one; no gap counts beyond that. A key's events may lie in many tasks: new resources are counted over all keys in
    order, less the count before the key's first."""
    rows = with_previous(events, key, time, *order)
    before = F.col("__previous")
    same = F.coalesce(before[key].eqNullSafe(F.col(key)), F.lit(False))
    gap = F.col(time) > before[time] + F.expr(f"INTERVAL {int(minutes)} MINUTES")
    rows = cut(rows.withColumn("__fresh", F.coalesce(~same | gap, F.lit(True)).cast("long")).drop("__previous"))
    rows = cut(running_sum(rows, "__fresh", "__count"))
    starts = rows.groupBy(F.col(key).alias("__key")).agg(F.min("__count").alias("__first"))
    rows = rows.join(starts, rows[key].eqNullSafe(F.col("__key")))
    return rows.select(*events.columns, (F.col("__count") - F.col("__first") + 1).alias("resource"))


def sessions_of_stream(events: DataFrame, key: str, time: str, minutes: int = 20, late: str = "10 minutes") -> DataFrame:
    """The streaming twin of ``reuse_groups``: start, end and events of each use, from Spark's session windows."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, f"{int(minutes)} minutes").alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
