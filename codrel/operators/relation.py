"""Relations: sets of records with typed, named columns.

A relation wraps a DataFrame and defers duplicate removal: restriction, renaming and joins of
sets are sets, and joining bags before removing duplicates gives the same set, so ``distinct``
runs once, where the result is taken, and not at all where a declared key rules duplicates out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.predicate import Predicate, column
from ..plans.schema import Schema


class Relation:
    def __init__(self, df: DataFrame, schema: Schema, is_set: bool, key: frozenset[str] | None = None, plan: tuple = ()):
        self._df, self.schema, self.is_set, self.key, self.plan = df, schema, is_set, key, plan

    # -- results -----------------------------------------------------------------

    def to_df(self) -> DataFrame:
        """Columns in descending order of name, without duplicates."""
        if self.is_set:
            return self._df
        return self._df.distinct() if len(self.schema) else self._df.limit(1)

    def distinct(self) -> Relation:
        """The same relation with duplicates removed here, where that makes a join's input smaller."""
        return self if self.is_set else Relation(self.to_df(), self.schema, True, self.key, self.plan)

    def collect(self) -> list:
        return self.to_df().collect()

    def count(self) -> int:
        return self.to_df().count()

    def is_nonempty(self) -> DataFrame:
        """One row, one boolean column: the two relations without columns as data that can be written."""
        return self._df.limit(1).agg((F.count(F.lit(1)) > 0).alias("nonempty"))

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def describe(self) -> str:
        """The algebra plan, one node a line."""
        from ..plans.printer import render

        return render(self.plan)

    def explain(self, mode: str = "formatted") -> None:
        print(self.describe())
        self.to_df().explain(mode)

    # -- operators ---------------------------------------------------------------

    def project(self, names: Iterable[str]) -> Relation:
        names = list(names)
        schema = self.schema.select(names)
        df = self._df.select(*map(column, schema.names))
        keeps_key = self.is_set and (len(schema) == len(self.schema) or self.key is not None and self.key <= set(schema.names))
        if not len(schema):
            return Relation(df.limit(1), schema, True, None, ("project", names, self.plan))
        return Relation(df, schema, keeps_key, self.key if keeps_key else None, ("project", names, self.plan))

    def restrict(self, predicate: Predicate) -> Relation:
        predicate.check(self.schema)
        return Relation(self._df.filter(predicate.condition(self.schema)), self.schema, self.is_set, self.key, ("restrict", predicate, self.plan))

    def rename(self, old: str, new: str) -> Relation:
        schema = self.schema.rename(old, new)
        df = self._df.select(*(column(old).alias(new) if n == new else column(n) for n in schema.names))
        key = frozenset(new if k == old else k for k in self.key) if self.key else None
        return Relation(df, schema, self.is_set, key, ("rename", (old, new), self.plan))

    def natural_join(self, other: Relation) -> Relation:
        return self._join(other, (), ("natural join", None, self.plan, other.plan))

    def equijoin(self, left: str, right: str, other: Relation) -> Relation:
        """Natural join of records whose ``left`` column equals the other's ``right`` column; both columns stay."""
        if self.schema[left] != other.schema[right]:
            raise TypeError(f"{left!r} is {self.schema[left].simpleString()} and {right!r} is {other.schema[right].simpleString()}")
        return self._join(other, ((left, right),), ("equijoin", (left, right), self.plan, other.plan))

    def _join(self, other: Relation, pairs: tuple, plan: tuple) -> Relation:
        schema, shared = self.schema.union(other.schema), self.schema.intersect(other.schema).names
        a, b = self._df.alias("a"), other._df.alias("b")
        of = lambda side, n: F.col(f"{side}.`{n.replace('`', '``')}`")
        conditions = [of("a", n).eqNullSafe(of("b", n)) for n in shared] + [of("a", x).eqNullSafe(of("b", y)) for x, y in pairs]
        if conditions:
            joined = a.join(b, reduce(lambda x, y: x & y, conditions))
        else:
            joined = a.crossJoin(b)
        df = joined.select(*(of("a" if n in self.schema else "b", n) for n in schema.names))
        key = self.key | other.key if self.key and other.key else None
        return Relation(df, schema, self.is_set and other.is_set, key, plan)

    def union(self, other: Relation) -> Relation:
        self.schema.check_equal(other.schema, "union")
        df = self._df.union(other._df)
        if not len(self.schema):
            return Relation(df.limit(1), self.schema, True, None, ("union", None, self.plan, other.plan))
        return Relation(df, self.schema, False, None, ("union", None, self.plan, other.plan))

    def intersection(self, other: Relation) -> Relation:
        return self._set_operation(other, "intersection", "left_semi", DataFrame.intersect)

    def difference(self, other: Relation) -> Relation:
        return self._set_operation(other, "difference", "left_anti", DataFrame.subtract)

    def _set_operation(self, other: Relation, name: str, how: str, operation: Callable) -> Relation:
        self.schema.check_equal(other.schema, name)
        # Without columns, Spark's own set operations take every relation for non-empty.
        df = operation(self._df, other._df) if len(self.schema) else self._df.limit(1).join(other._df.limit(1), how=how)
        return Relation(df, self.schema, True, self.key if self.is_set else None, (name, None, self.plan, other.plan))


def table(df: DataFrame, name: str = "table", key: Iterable[str] | None = None) -> Relation:
    """A leaf. With a declared ``key`` the rows are taken as a set; else duplicates are removed when needed."""
    schema = Schema.of_struct(df.schema)
    keyed = frozenset(key) if key is not None else None
    for k in keyed or ():
        schema[k]
    df = df.select(*map(column, schema.names))
    if not len(schema):
        return Relation(df.limit(1), schema, True, None, ("table", name))
    return Relation(df, schema, keyed is not None, keyed, ("table", name))


def from_rows(spark: SparkSession, rows: Iterable[tuple], fields: list[tuple], name: str = "table") -> Relation:
    struct = StructType([StructField(n, k, True) for n, k in fields])
    return table(spark.createDataFrame(list(rows), struct), name)


def dee(spark: SparkSession) -> Relation:
    """No columns, one record."""
    return table(spark.createDataFrame([()], StructType([])), "dee")


def dum(spark: SparkSession) -> Relation:
    """No columns, no record."""
    return table(spark.createDataFrame([], StructType([])), "dum")
