"""Counts of what bounds have saved, gathered from the tasks."""

from __future__ import annotations

from collections.abc import Callable


class Work:
    """What passes have done, and what they would do without bounds. A task that runs twice counts twice."""

    def __init__(self, spark):
        self.done, self.possible = (spark.sparkContext.accumulator(0) for _ in range(2))

    @property
    def share(self) -> float:
        return self.done.value / max(self.possible.value, 1)


def counting(work: Work | None) -> Callable[[int, int], None]:
    """A function for tasks that adds to `work`, if there is any."""
    if work is None:
        return lambda done, possible: None
    one, two = work.done, work.possible

    def count(done: int, possible: int) -> None:
        one.add(int(done))
        two.add(int(possible))

    return count
