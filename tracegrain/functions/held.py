"""Values that a driver holds between questions: the least recently used go first, and old ones are made again."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from threading import Lock
from typing import Any


class Held:
    """At most `most` values by key, each for `seconds` at most (None: for ever); `gone` is told of each that leaves."""

    def __init__(self, most: int, seconds: float | None = None, gone: Callable[[Any], Any] | None = None, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.gone, self.clock = most, seconds, gone, clock
        self._values: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()
        self._lock = Lock()

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        """The value of key, made if it is not held.  Two that ask at once may both make it; the later stays."""
        with self._lock:
            found = self._values.get(key)
            if found and (self.seconds is None or self.clock() - found[0] <= self.seconds):
                self._values.move_to_end(key)
                return found[1]
        value = make()
        with self._lock:
            left = [self._values.pop(key)] if key in self._values else []
            self._values[key] = (self.clock(), value)
            while len(self._values) > self.most:
                left.append(self._values.popitem(last=False)[1])
        self._tell(left)
        return value

    def drop(self, key: Hashable) -> None:
        with self._lock:
            left = [self._values.pop(key)] if key in self._values else []
        self._tell(left)

    def _tell(self, left: list[tuple[float, Any]]) -> None:
        if self.gone:
            for _, value in left:
                self.gone(value)

    def __len__(self) -> int:
        return len(self._values)
