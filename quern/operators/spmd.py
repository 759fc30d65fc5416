"""The same code on N workers at once: ranks, gather to rank 0, failures that reach the caller."""

from __future__ import annotations

import os
import runpy
import sys
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

from quern.functions.driver import from_contents, to_contents


@dataclass
class Worker:
    """What one worker sees: its rank, how many there are, and values that the driver scattered."""

    rank: int
    size: int
    values: dict
    lines: list[str] = field(default_factory=list)

    def log(self, text: str) -> None:
        """A line for the session's log, which gets the lines of all workers by rank."""
        self.lines.append(f"worker {self.rank}: {text}")

    def gather(self, value: object) -> list | None:
        """All workers' values by rank, at rank 0; None elsewhere."""
        parts = BarrierTaskContext.get().allGather(to_contents(value))
        return [from_contents(p) for p in parts] if self.rank == 0 else None

    def barrier(self) -> None:
        BarrierTaskContext.get().barrier()


def run(spark: SparkSession, fn: Callable[[Worker], object], nworkers: int = 16, scatter: dict | None = None, log: list[str] | None = None) -> list:
    """Call ``fn`` on ``nworkers`` workers that run at the same time; their results by rank.

    Values in ``scatter`` go out as one broadcast. Lines that workers log are put behind ``log``. An exception in a worker fails the call with its text. If the cluster
    has fewer slots than workers, Spark refuses (SPARK-24819): fewer workers would change results.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local[") and nworkers > sc.defaultParallelism:  # Spark would look again for ten minutes first
        raise ValueError(f"{nworkers} workers need as many slots (SPARK-24819); {sc.master} has {sc.defaultParallelism}")
    sent = sc.broadcast(scatter or {})

    def task(_):
        context = BarrierTaskContext.get()
        worker = Worker(context.partitionId(), len(context.getTaskInfos()), sent.value)
        yield worker.rank, to_contents(fn(worker)), worker.lines

    found = sorted(sc.parallelize(range(nworkers), nworkers).barrier().mapPartitions(task).collect())
    if log is not None:
        log += [x for _, _, lines in found for x in lines]
    return [from_contents(c) for _, c, _ in found]


def run_files(spark: SparkSession, sources: list[str], nworkers: int = 16, scatter: dict | None = None, log: list[str] | None = None, names: list[str] | None = None) -> list:
    """Run Python sources (their text), one after another, on each worker, with ``worker`` in their globals. The result of
    a worker is what the last one leaves in ``result``, if anything. Under their ``names`` they can import each other."""
    named = list(zip(names or [f"code{i}.py" for i in range(len(sources))], sources, strict=True))

    def code(worker: Worker) -> object:
        out = None
        with tempfile.TemporaryDirectory() as folder:
            paths = [os.path.join(folder, str(i), name) for i, (name, _) in enumerate(named)]  # two may have one name
            for path, (_, text) in zip(paths, named, strict=True):
                os.mkdir(os.path.dirname(path))
                with open(path, "w") as f:
                    f.write(text)
            before = list(sys.path)
            sys.path[:0] = [os.path.dirname(p) for p in paths]
            try:
                for path in paths:
                    out = runpy.run_path(path, init_globals={"worker": worker}).get("result")
            finally:
                sys.path[:] = before
                for m in [m for m, x in list(sys.modules.items()) if (getattr(x, "__file__", None) or "").startswith(folder + os.sep)]:
                    del sys.modules[m]  # this process may run other code of that name later
        return out

    return run(spark, code, nworkers, scatter, log)
