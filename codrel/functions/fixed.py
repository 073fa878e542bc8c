"""Vectors of a length fixed when they are made, as tuples."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any


def copies(n: int, value: Any) -> tuple:
    if n < 0:
        raise ValueError(f"no vector has length {n}")
    return (value,) * n


def apply(functions: tuple[Callable, ...], values: tuple) -> tuple:
    """Each function at the value in its place; the lengths must be equal."""
    return tuple(f(x) for f, x in zip(functions, values, strict=True))


def from_list(values: Iterable[Any]) -> tuple:
    return tuple(values)


def to_list(vector: tuple) -> list:
    return list(vector)


def to_non_empty(vector: tuple) -> tuple[Any, list]:
    """First value and the rest; raises where there is no first."""
    if not vector:
        raise ValueError("empty vector")
    return vector[0], list(vector[1:])
