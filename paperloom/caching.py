"""Results kept for a while: by age, by number, by what they were made from."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import DataFrame


class Cache:
    """At most ``most`` results, each for ``seconds`` at most and as long as its fingerprint holds; the one longest unused goes first.

    DataFrames are persisted while they are kept and freed when they go; an executor's loss only costs their computation again.
    """

    def __init__(self, most: int = 256, seconds: float | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.most, self.seconds, self.clock = most, seconds, clock
        self.held: OrderedDict[Hashable, tuple[float, Any, Any]] = OrderedDict()

    def get(self, key: Hashable, make: Callable[[], Any], fingerprint: Any = None) -> Any:
        if key in self.held:
            at, made_from, value = self.held[key]
            if made_from == fingerprint and (self.seconds is None or self.clock() - at < self.seconds):
                self.held.move_to_end(key)
                return value
            self.drop(key)
        value = make()
        if isinstance(value, DataFrame):
            value = value.persist()
        self.held[key] = self.clock(), fingerprint, value
        while len(self.held) > self.most:
            self.drop(next(iter(self.held)))
        return value

    def drop(self, key: Hashable) -> None:
        _, _, value = self.held.pop(key)
        if isinstance(value, DataFrame):
            value.unpersist()
