"""What a Python worker keeps between texts and tasks, bounded in bytes.

Spark reuses its workers, so whatever an operator keeps in one stays there through the stages that follow. Every cache here has a budget
in bytes, and belongs to an operator: a task that starts work for one operator gives back what the others have kept.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

#: Bytes that an entry takes with its key and value, which are short.
ENTRY = 200
_MISSING = object()


class Kept(dict):
    """``make(key)`` for each key, kept: at most ``budget`` bytes of entries. When the young half is full it becomes the old half, and what is
    not asked for again until the next change is forgotten; keys above ``longest`` are never kept."""

    def __init__(self, make: Callable, budget: int, longest: int | None = None):
        super().__init__()
        self.make, self.most, self.longest = make, max(1, budget // (2 * ENTRY)), longest
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key, _MISSING)
        if value is _MISSING:
            value = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


_FORGET: dict[str, Callable[[], None]] = {}


def owns(operator: str, forget: Callable[[], None]) -> None:
    """``forget`` gives back what ``operator`` keeps in this worker."""
    _FORGET[operator] = forget


def returned() -> None:
    """Hand freed memory back to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_LAST: list[str] = []


def working_for(operator: str) -> None:
    """Call at the start of a task: what other operators have kept in this worker is given back."""
    if _LAST != [operator]:
        for name, forget in _FORGET.items():
            if name != operator:
                forget()
        _LAST[:] = [operator]
        returned()


def done_with(operator: str) -> None:
    """Call at the end of a task that leaves nothing worth keeping."""
    if operator in _FORGET:
        _FORGET[operator]()
    returned()
