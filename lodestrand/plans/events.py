"""What a run tells while it goes on: how far it is, and what it could not do."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


def _silent(*_: object) -> None:
    return None


@dataclass
class Events:
    """Functions that a run calls; those that are left out are silent.

    status(text): a step begins, or has ended with what it counted. progress(step,
    done, all): tasks of a step, as Spark's status tracker has them, every ``every``
    seconds. warning(text) and error(text): what was passed over, what could not be read.
    """

    status: Callable[[str], object] = _silent
    progress: Callable[[str, int, int], object] = _silent
    warning: Callable[[str], object] = _silent
    error: Callable[[str], object] = _silent
    every: float = 1.0

    @contextmanager
    def step(self, spark: SparkSession, name: str) -> Iterator[None]:
        """Tells of the stages that run meanwhile, from a thread of its own; the work itself knows nothing of it."""
        if self.progress is _silent and self.status is _silent:
            yield
            return
        self.status(name)
        ended, tracker = threading.Event(), spark.sparkContext.statusTracker()
        known: dict[int, tuple[int, int]] = {}

        def look() -> None:
            for stage in tracker.getActiveStageIds():
                if info := tracker.getStageInfo(stage):
                    known[stage] = (info.numCompletedTasks, info.numTasks)
            done, total = (sum(x) for x in zip(*known.values(), strict=True)) if known else (0, 0)
            self.progress(name, done, total)

        def watch() -> None:
            while not ended.wait(self.every):
                look()

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        finally:
            ended.set()
            thread.join()
            total = sum(n for _, n in known.values())
            self.progress(name, total, total)
