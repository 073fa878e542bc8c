"""Predicates of restrictions: equality of a column with a constant or a column, and, or, not.

They have two truth values: absence equals absence, so every comparison is null-safe.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.schema import Schema
from .types import check_constant, constant


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


class Predicate:
    columns: frozenset[str]

    def condition(self, schema: Schema) -> Column:
        raise NotImplementedError

    def check(self, schema: Schema) -> None:
        for name in self.columns:
            schema[name]

    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class ValEq(Predicate):
    name: str
    value: Any

    @property
    def columns(self) -> frozenset[str]:
        return frozenset((self.name,))

    def check(self, schema: Schema) -> None:
        check_constant(self.value, schema[self.name])

    def condition(self, schema: Schema) -> Column:
        own = column(self.name)
        # With a value that cannot be null, plain equality is pushed down to the scan; nulls are then false, not unknown.
        return own.eqNullSafe(constant(self.value, schema[self.name]))

    def __str__(self) -> str:
        return f"{self.name} = {self.value!r}"


@dataclass(frozen=True)
class ColEq(Predicate):
    left: str
    right: str

    @property
    def columns(self) -> frozenset[str]:
        return frozenset((self.left, self.right))

    def check(self, schema: Schema) -> None:
        if schema[self.left] != schema[self.right]:
            raise TypeError(f"{self.left!r} is {schema[self.left].simpleString()} and {self.right!r} is {schema[self.right].simpleString()}")

    def condition(self, schema: Schema) -> Column:
        return column(self.left).eqNullSafe(column(self.right))

    def __str__(self) -> str:
        return f"{self.left} = {self.right}"


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate

    @property
    def columns(self) -> frozenset[str]:
        return self.left.columns | self.right.columns

    def check(self, schema: Schema) -> None:
        self.left.check(schema)
        self.right.check(schema)

    def condition(self, schema: Schema) -> Column:
        return self.left.condition(schema) & self.right.condition(schema)

    def __str__(self) -> str:
        return f"({self.left} and {self.right})"


@dataclass(frozen=True)
class Or(And):
    def condition(self, schema: Schema) -> Column:
        return self.left.condition(schema) | self.right.condition(schema)

    def __str__(self) -> str:
        return f"({self.left} or {self.right})"


@dataclass(frozen=True)
class Not(Predicate):
    of: Predicate

    @property
    def columns(self) -> frozenset[str]:
        return self.of.columns

    def check(self, schema: Schema) -> None:
        self.of.check(schema)

    def condition(self, schema: Schema) -> Column:
        return ~self.of.condition(schema)

    def __str__(self) -> str:
        return f"not {self.of}"


def val_eq(name: str, value: Any) -> Predicate:
    return ValEq(name, value)


def col_eq(left: str, right: str) -> Predicate:
    return ColEq(left, right)


def and_(first: Predicate, *more: Predicate) -> Predicate:
    for p in more:
        first = And(first, p)
    return first


def or_(first: Predicate, *more: Predicate) -> Predicate:
    for p in more:
        first = Or(first, p)
    return first


def not_(of: Predicate) -> Predicate:
    return Not(of)
