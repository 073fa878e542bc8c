"""Schemas of relations: columns by name, in descending order of name, with exact types."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType


def orderable(kind: DataType) -> bool:
    """Whether values of the type have an order, which every column of a relation needs."""
    if isinstance(kind, ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


@dataclass(frozen=True)
class Schema:
    """(name, type) pairs in descending order of name (by code point)."""

    fields: tuple[tuple[str, DataType], ...] = ()

    @classmethod
    def of(cls, fields: Iterable[tuple[str, DataType]]) -> Schema:
        ordered = tuple(sorted(fields, key=lambda f: f[0], reverse=True))
        for (a, _), (b, _) in zip(ordered, ordered[1:], strict=False):
            if a == b:
                raise ValueError(f"column {a!r} occurs twice")
        for name, kind in ordered:
            if not orderable(kind):
                raise TypeError(f"column {name!r}: values of {kind.simpleString()} have no order")
        return cls(ordered)

    @classmethod
    def of_struct(cls, struct: StructType) -> Schema:
        return cls.of((f.name, f.dataType) for f in struct.fields)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    def __iter__(self) -> Iterator[tuple[str, DataType]]:
        return iter(self.fields)

    def __len__(self) -> int:
        return len(self.fields)

    def __contains__(self, name: str) -> bool:
        return any(n == name for n, _ in self.fields)

    def __getitem__(self, name: str) -> DataType:
        for n, kind in self.fields:
            if n == name:
                return kind
        raise KeyError(f"no column {name!r} among {self.names}")

    def union(self, other: Schema) -> Schema:
        """Columns of either side; a name they share must have one type."""
        for name, kind in self:
            if name in other and other[name] != kind:
                raise TypeError(f"column {name!r} is {kind.simpleString()} on one side and {other[name].simpleString()} on the other")
        return Schema.of([*self.fields, *((n, k) for n, k in other if n not in self)])

    def subtract(self, other: Schema) -> Schema:
        return Schema(tuple((n, k) for n, k in self if n not in other))

    def intersect(self, other: Schema) -> Schema:
        self.union(other)
        return Schema(tuple((n, k) for n, k in self if n in other))

    def select(self, names: Iterable[str]) -> Schema:
        """The named columns, in any order given."""
        return Schema.of((n, self[n]) for n in names)

    def contains(self, other: Schema) -> bool:
        return all(n in self and self[n] == k for n, k in other)

    def remove(self, name: str) -> Schema:
        self[name]
        return Schema(tuple((n, k) for n, k in self if n != name))

    def insert(self, name: str, kind: DataType) -> Schema:
        return Schema.of([*self.fields, (name, kind)])

    def rename(self, old: str, new: str) -> Schema:
        kind = self[old]
        if old != new and new in self:
            raise ValueError(f"column {new!r} exists already")
        return self.remove(old).insert(new, kind)

    def check_equal(self, other: Schema, what: str = "operation") -> None:
        if self != other:
            raise TypeError(f"{what} needs equal schemas, not {self} and {other}")

    def __str__(self) -> str:
        return "{" + ", ".join(f"{n}: {k.simpleString()}" for n, k in self) + "}"
