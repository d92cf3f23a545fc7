"""Several callers on one engine: at most `size` at a time, each in a FAIR scheduler pool of its own."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from quarry.session import Engine


class Pool:
    def __init__(self, engine: Engine, size: int = 8):
        self.engine, self.size = engine, size
        self._free = threading.Semaphore(size)
        self._writer = threading.RLock()

    @contextmanager
    def acquire(self) -> Iterator[Engine]:
        """An engine over the same tables whose jobs share the cluster fairly with those of the other callers."""
        with self._free:
            spark = self.engine.spark
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"quarry-{threading.get_ident()}")
            own = Engine(spark, self.engine._path)
            own._views = dict(self.engine._views)
            own._own = {**self.engine._own, **own._own}
            try:
                yield own
            finally:
                own.close()
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    def execute(self, sql: str, params=None) -> int:
        """A write; writers of one pool wait for each other, so none loses the race for a version."""
        with self._writer, self.acquire() as engine:
            return engine.execute(sql, params)
