"""Results kept for a while, by a main key and further ones."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any


class ResultCache:
    """Entries under a main key; a request hits if every further key it names matches the entry's.

    Entries expire after ``lifetime`` seconds. Expired ones are removed on lookup and all of them
    every ``sweep`` additions. ``clear`` drops everything, as when the index changes.
    """

    def __init__(self, lifetime: float = 86400, sweep: int = 100, clock: Callable[[], float] = time.monotonic):
        self.lifetime, self.sweep, self.clock = lifetime, sweep, clock
        self.entries: dict[Any, list[tuple[float, dict, Any]]] = {}
        self.added = 0

    def put(self, key: Any, value: Any, lifetime: float | None = None, **further: Any) -> None:
        self.added += 1
        if self.added % (self.sweep + 1) == 0:
            for other in list(self.entries):
                self._fresh(other)
        self.entries.setdefault(key, []).append((self.clock() + (self.lifetime if lifetime is None else lifetime), further, value))

    def get(self, key: Any, **further: Any) -> Any | None:
        for _, own, value in reversed(self._fresh(key)):
            if all(name in own and own[name] == wanted for name, wanted in further.items()):
                return value
        return None

    def clear(self) -> None:
        self.entries.clear()

    def _fresh(self, key: Any) -> list:
        kept = [e for e in self.entries.get(key, []) if e[0] > self.clock()]
        if kept:
            self.entries[key] = kept
        else:
            self.entries.pop(key, None)
        return kept
