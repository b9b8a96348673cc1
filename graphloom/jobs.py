"""Jobs in the background of the driver: one writer at a time, with progress, state, and a way to end them."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(ms: int | None = None) -> str:
    """26 characters that sort by time: 48 bits of milliseconds and 80 random bits."""
    n = (int(time.time() * 1000) if ms is None else ms) << 80 | int.from_bytes(os.urandom(10), "big")
    return "".join(CROCKFORD[n >> 5 * k & 31] for k in range(25, -1, -1))


class Aborted(Exception):
    """A job was asked to end."""


@dataclass
class Job:
    id: str
    project: str
    kind: str
    status: str = "running"  #: running, done, failed, aborted
    phase: str = ""
    done: int = 0
    total: int = 0
    error: str = ""
    result: object = None
    started: float = field(default_factory=time.time)
    ended: float = 0.0
    stop: threading.Event = field(default_factory=threading.Event)
    over: threading.Event = field(default_factory=threading.Event)

    def progress(self, phase: str, done: int = 0, total: int = 0) -> None:
        """Tell how far the job is; where it ends if it was asked to."""
        if self.stop.is_set():
            raise Aborted(self.id)
        self.phase, self.done, self.total = phase, done, total

    def state(self) -> dict[str, object]:
        names = ("id", "project", "kind", "status", "phase", "done", "total", "error", "started", "ended")
        return {k: getattr(self, k) for k in names}


class Jobs:
    """A registry; writes go one after the other. A job's Spark work carries its id as a tag, by which it is interrupted."""

    def __init__(self, spark: SparkSession, keep: int = 1000) -> None:
        self.spark, self.keep, self.all, self.lock, self.writing = spark, keep, {}, threading.Lock(), threading.Lock()

    def start(self, project: str, kind: str, work: Callable[[Job], object], wait: bool = False) -> Job:
        job = Job(ulid(), project, kind)
        with self.lock:
            self.all[job.id] = job
            for old in [j for j in self.all.values() if j.over.is_set()][: max(0, len(self.all) - self.keep)]:
                del self.all[old.id]

        def run() -> None:
            try:
                with self.writing:
                    job.progress("started")
                    self.spark.sparkContext.addJobTag(job.id)
                    try:
                        job.result = work(job)
                    finally:
                        self.spark.sparkContext.removeJobTag(job.id)
                job.status = "done"
            except Exception as e:
                job.status, job.error = ("aborted", "") if job.stop.is_set() else ("failed", f"{type(e).__name__}: {e}"[:2000])
            job.ended = time.time()
            job.over.set()

        from pyspark import inheritable_thread_target

        threading.Thread(target=inheritable_thread_target(self.spark)(run), daemon=True).start()
        if wait:
            job.over.wait()
        return job

    def get(self, id_: str) -> Job | None:
        return self.all.get(id_)

    def latest(self, project: str) -> Job | None:
        return max((j for j in self.all.values() if j.project == project), key=lambda j: (j.started, j.id), default=None)

    def abort(self, id_: str) -> bool:
        job = self.get(id_)
        if job is None or job.over.is_set():
            return False
        job.stop.set()
        self.spark.sparkContext.cancelJobsWithTag(id_)
        return True
