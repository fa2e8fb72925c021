"""A folder of jobs, and a runner that keeps several of them going."""

from __future__ import annotations

import os
import re
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from .compile import Built, build
from .spec import Spec, dump, load

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}")


class JobStore:
    """Jobs as text files; a job is validated before it is written, and a file is replaced as a whole."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _path(self, name: str) -> str:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a job's name: {name!r}")
        return os.path.join(self.folder, f"{name}.yaml")

    def save(self, text: str) -> Spec:
        spec = load(text)
        path = self._path(spec.name)
        with open(f"{path}.tmp", "w") as f:
            f.write(text)
        os.replace(f"{path}.tmp", path)
        return spec

    def text(self, name: str) -> str:
        with open(self._path(name)) as f:
            return f.read()

    def duplicate(self, name: str, new: str) -> Spec:
        """The job under another name."""
        if new in self.names():
            raise ValueError(f"{new} is there already")
        spec = load(self.text(name))
        spec.name = new
        return self.save(dump(spec))

    def delete(self, name: str) -> None:
        os.remove(self._path(name))

    def names(self) -> list[str]:
        return sorted(f[:-5] for f in os.listdir(self.folder) if f.endswith(".yaml"))


class Run:
    """A run of a job: a batch in a thread, or a stream."""

    def __init__(self, built: Built, pool: ThreadPoolExecutor, checkpoint: str | None) -> None:
        self.built, self.since = built, time.time()
        self.stream = built.start(checkpoint) if built.frame.isStreaming else None
        self.group = f"millrace-{uuid.uuid4().hex}"
        self.future = None if self.stream else pool.submit(self._batch)

    def _batch(self):
        sc = self.built.frame.sparkSession.sparkContext
        sc.setJobGroup(self.group, self.built.spec.name, interruptOnCancel=True)
        return self.built.run()

    def state(self) -> tuple[str, str | None]:
        """running, finished or failed; and the error."""
        if self.stream:
            error = self.stream.query.exception()
            return ("running", None) if self.stream.query.isActive else ("failed", str(error)) if error else ("finished", None)
        if not self.future.done():
            return "running", None
        error = None if self.future.cancelled() else self.future.exception()
        return ("failed", str(error)) if error else ("finished", None)

    def stop(self) -> None:
        if self.stream:
            self.stream.stop()
        elif not self.future.done():
            self.future.cancel()
            self.built.frame.sparkSession.sparkContext.cancelJobGroup(self.group)

    def result(self, timeout: float | None = None):
        if not self.stream:
            return self.future.result(timeout)
        self.stream.query.awaitTermination(timeout)
        return list(self.stream.rows)


class Runner:
    """Runs stored jobs side by side in one session; a job runs once at a time. Streams go on from their checkpoints when they are started again."""

    def __init__(self, spark: SparkSession, store: JobStore, workers: int = 8) -> None:
        self.spark, self.store = spark, store
        self._pool, self._lock, self._runs = ThreadPoolExecutor(workers), threading.Lock(), {}

    def start(self, name: str, checkpoint: str | None = None, **kwargs) -> Run:
        """``rows`` and ``bounded`` as for ``build``."""
        with self._lock:
            if name in self._runs and self._runs[name].state()[0] == "running":
                raise RuntimeError(f"{name} is running")
            self._runs[name] = Run(build(self.spark, self.store.text(name), **kwargs), self._pool, checkpoint)
            return self._runs[name]

    def stop(self, name: str) -> None:
        """Ends a job's run, if it has one."""
        run = self._runs.get(name)
        if run:
            run.stop()

    def stop_all(self) -> None:
        for name in list(self._runs):
            self.stop(name)

    def pick(self, name: str | None = None) -> Run | None:
        """The job's run; without a name the only one that is running."""
        if name:
            return self._runs.get(name)
        running = [r for r in self._runs.values() if r.state()[0] == "running"]
        return running[0] if len(running) == 1 else None

    def sample(self, name: str | None = None, stage: str | None = None, n: int = 20) -> list[dict]:
        """Some rows after a stage of a batch, or the last rows that left a stream."""
        run = self.pick(name)
        if run is None:
            return []
        if run.stream:
            return list(run.stream.rows)[-n:]
        frame = run.built.stages[stage] if stage else run.built.frame
        return [r.asDict(recursive=True) for r in frame.limit(n).collect()]

    def states(self) -> dict[str, str]:
        return {n: r.state()[0] for n, r in sorted(self._runs.items())}

    def status(self) -> dict:
        """Running jobs with the seconds they have run, and the errors of those that failed."""
        states = {n: (r, *r.state()) for n, r in sorted(self._runs.items())}
        return {"running": [{"name": n, "seconds": round(time.time() - r.since, 3)} for n, (r, s, _) in states.items() if s == "running"], "errors": {n: e for n, (_, s, e) in states.items() if s == "failed"}}
