"""A paced replay that can be held: on the driver, over records that come one after the other."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


class Player:
    """Hands out the rows of a replay in order, each no earlier than its due_ns after the start. ``clock`` tells nanoseconds and
    ``sleep`` waits so many; both can be replaced. pause() holds the replay without blocking, step(n) lets n rows
    through at once while it is held, and time that it was held doesn't count towards what is due."""

    def __init__(self, rows: Iterator, clock: Callable[[], int] = time.monotonic_ns, sleep: Callable[[int], None] = lambda ns: time.sleep(ns / 1e9)):
        self.rows, self.clock, self.sleep = rows, clock, sleep
        self.start, self.held, self.steps, self.ended = clock(), None, 0, False

    @classmethod
    def of(cls, due: DataFrame, order: list[str], **options) -> Player:
        """due has due_ns; its partitions come to the driver one by one."""
        return cls(due.orderBy(*order).toLocalIterator(prefetchPartitions=True), **options)

    def pause(self) -> None:
        if self.held is None:
            self.held = self.clock()

    def resume(self) -> None:
        if self.held is not None:
            self.start += self.clock() - self.held
            self.held, self.steps = None, 0

    def step(self, n: int = 1) -> None:
        if self.held is None:
            raise ValueError("a replay that runs can't be stepped")
        self.steps += n

    def take(self):
        """The next row, after waiting for it; None while held or at the end, which ``ended`` tells apart."""
        if self.ended or (self.held is not None and not self.steps):
            return None
        row = next(self.rows, None)
        if row is None:
            self.ended = True
        elif self.held is not None:
            self.steps -= 1
        elif (wait := self.start + row["due_ns"] - self.clock()) > 0:
            self.sleep(wait)
        return row
