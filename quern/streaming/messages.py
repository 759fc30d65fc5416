"""Messages between a session and its client: kinds, FIFO order without repeats, queues; in batch and as streams."""

from __future__ import annotations

import json
import queue
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.driver import dedup_id, from_contents, to_contents
from quern.operators.relational import places
from quern.sources.files import write_text

MESSAGE = "seq long, group_id string, dedup_id string, body string, ts timestamp"
#: How bodies start and end.
READY = ("JOB_READY", "SESSION_READY")
DONE = "EVALUATION_END"
FAILED = ("JOB_FAILURE", "SESSION_FAILURE")
END = "MESSAGE_END"


def _starts(body: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | body.startswith(p)
    return out


def parsed(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``kind``, ``end`` and ``text``: ready; done or failed with the text between prefix and MESSAGE_END; or the ``kind`` of
    a JSON body in capitals as it stands; null for anything else."""
    b = F.col(body)
    failed = _starts(b, FAILED)
    kind = F.when(_starts(b, READY), F.lit("ready")).when(b.startswith(DONE), F.lit("done")).when(failed, F.lit("failed")).otherwise(F.get_json_object(b, "$.kind"))
    text = F.when(b.startswith(DONE) | failed, F.regexp_replace(F.regexp_replace(b, f"^({DONE}|{'|'.join(FAILED)})", ""), f"{END}$", ""))
    return df.withColumns({"kind": kind, "end": F.coalesce((b.startswith(DONE) | failed) & b.endswith(END), F.lit(False)), "text": text})


def in_order(df: DataFrame, group: str = "group_id", dedup: str = "dedup_id", seq: str = "seq") -> DataFrame:
    """The first message of each id, numbered in the order of each group (``seq`` is unique).

    First messages are found by an aggregation; positions are places in the order of (group, seq) over all tasks, less the place of
    the group's first. So no task gets a whole group, however large.
    """
    rest = [c for c in df.columns if c not in (group, dedup)]
    first = df.groupBy(group, dedup).agg(F.min_by(F.struct(*rest), seq).alias("__row")).select(group, dedup, "__row.*")
    placed = places(first, group, seq)
    starts = placed.groupBy(F.col(group).alias("__group")).agg(F.min("__place").alias("__start"))
    position = (F.col("__place") - F.col("__start") + 1).alias("position")
    return placed.join(starts, placed[group].eqNullSafe(F.col("__group"))).select(*df.columns, position)


def without_repeats(messages: DataFrame, dedup: str = "dedup_id", at: str = "ts", window: str = "5 minutes") -> DataFrame:
    """The streaming twin: an id that came within ``window`` is dropped. ``at`` must be a timestamp with zone."""
    return messages.withWatermark(at, window).dropDuplicatesWithinWatermark([dedup])


def stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The messages of a ``Mailbox`` as a stream, for any process that reaches the folder. A micro-batch whose result was not committed
    is read again from the stream's checkpoint, so a message comes again until it was dealt with."""
    return spark.readStream.schema(MESSAGE).options(**options).json(folder)


class Mailbox:
    """Sends messages to a folder of any file system that Spark reaches, a file for each; ``stream`` reads them.

    A file gets its name, which starts with its number, when it is whole. Numbers are one sender's; times order different senders.
    """

    def __init__(self, spark: SparkSession, folder: str, group: str = "1", clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.group, self.clock, self.number = spark, folder.rstrip("/"), group, clock, 0

    def send(self, body: str, id: str | None = None) -> None:
        self.number += 1
        id = id or dedup_id()
        at = datetime.fromtimestamp(self.clock(), UTC).isoformat()
        record = {"seq": self.number, "group_id": self.group, "dedup_id": id, "body": body, "ts": at}
        write_text(self.spark, f"{self.folder}/{self.number:012d}-{uuid.uuid4().hex}.json", json.dumps(record) + "\n")


class SessionFailed(RuntimeError):
    """A failure that ends the session; ``of_job`` if the job failed, whose resources are to be released at once."""

    def __init__(self, text: str, of_job: bool = False):
        super().__init__(text)
        self.of_job = of_job


#: Seconds for which a queue knows the ids of messages sent.
DEDUP_WINDOW = 300


@dataclass
class Queue:
    """A FIFO of one group in this process, which drops messages whose id it has seen in the last five minutes. ``receive``
    blocks; a message that is not deleted comes again."""

    name: str
    items: queue.Queue = field(default_factory=queue.Queue)
    seen: dict[str, float] = field(default_factory=dict)  # id: when it was sent, oldest first
    held: list = field(default_factory=list)
    clock: Callable[[], float] = time.time

    def send(self, body: str, id: str | None = None) -> None:
        id, now = id or dedup_id(), self.clock()
        while self.seen and next(iter(self.seen.values())) <= now - DEDUP_WINDOW:
            del self.seen[next(iter(self.seen))]
        if id not in self.seen:
            self.seen[id] = now
            self.items.put(body)

    def receive(self, delete: bool = True, timeout: float | None = None) -> str:
        body = self.held[0] if self.held else self.items.get(timeout=timeout)
        if delete and self.held:
            self.held.pop(0)
        elif not delete and not self.held:
            self.held.append(body)
        return body


def send_value(queue: Queue, value_id: str, value: object) -> None:
    """Worker to client."""
    queue.send(json.dumps({"kind": "GATHER", "value_id": value_id, "contents": to_contents(value)}))


def ask_value(gather: Queue, scatter: Queue, value_id: str, timeout: float | None = None) -> object:
    """Client to worker: ask on one queue, wait for the contents on the other."""
    gather.send(json.dumps({"kind": "SCATTER_REQUEST", "value_id": value_id}))
    return from_contents(json.loads(scatter.receive(timeout=timeout))["contents"])


def next_message(queue: Queue, timeout: float | None = None) -> dict:
    """The next message, parsed. Text of an evaluation or a failure is printed; a failure that ends the message raises."""
    body = queue.receive(timeout=timeout)
    if body.startswith(READY):
        return {"kind": "ready"}
    for prefix, kind in ((DONE, "done"), *((p, "failed") for p in FAILED)):
        if body.startswith(prefix):
            end = body.endswith(END)
            text = body.removeprefix(prefix).removesuffix(END)
            print(text)
            if kind == "failed" and end:
                raise SessionFailed(text, prefix == FAILED[0])
            return {"kind": kind, "end": end, "text": text}
    return json.loads(body)
