"""Named extension points: a name stands for one function for good."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    def __init__(self, what: str):
        self.what = what
        self.entries: dict[str, Callable[..., Any]] = {}

    def register(self, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def put(f: Callable[..., Any]) -> Callable[..., Any]:
            if self.entries.get(name, f) is not f:
                raise ValueError(f"{self.what} {name!r} is registered already")
            self.entries[name] = f
            return f

        return put

    def __getitem__(self, name: str) -> Callable[..., Any]:
        if name not in self.entries:
            raise ValueError(f"unknown {self.what} {name!r}; there are {sorted(self.entries)}")
        return self.entries[name]

    def __contains__(self, name: str) -> bool:
        return name in self.entries
