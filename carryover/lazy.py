"""A mapping whose values are built when they are first asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any


class Lazy(Mapping):
    def __init__(self, makers: Mapping[str, Callable[[], Any]]):
        self._makers = makers
        self._made: dict[str, Any] = {}

    def __getitem__(self, name: str) -> Any:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)
