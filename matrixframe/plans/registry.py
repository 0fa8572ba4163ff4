"""A small registry: the engine's operators by name, and room for others without touching the engine."""

from __future__ import annotations

from collections.abc import Callable

from ..frame import MatrixFrame

_OPERATORS: dict[str, Callable[..., MatrixFrame]] = {}


def operator(name: str):
    """Register a function of a ``MatrixFrame`` (and options) under a name."""

    def register(fn):
        if name in _OPERATORS:
            raise ValueError(f"an operator is called {name!r} already")
        _OPERATORS[name] = fn
        return fn

    return register


def names() -> list[str]:
    return sorted(_OPERATORS)


def apply(name: str, a: MatrixFrame, *args, **options) -> MatrixFrame:
    if name not in _OPERATORS:
        raise KeyError(f"no operator is called {name!r}; there are {', '.join(names()) or 'none'}")
    return _OPERATORS[name](a, *args, **options)
