"""Ordered vectors of records: a DataFrame with a dense hidden position.

Positions are 0 to n - 1. Element functions are Column expressions; ``*_m`` forms and
``map_rows`` take Python callables and run them over Arrow batches. Operations that are
undefined on an empty vector, or out of range, raise. Folds and scans with an arbitrary
function gather the vector's values into one ordered array, because nothing is known of the
function; named operations (sum, min, max, count, and, or) are distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .positions import POS, RUN, all_equal, combine, running, with_positions


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


class Vector:
    def __init__(self, df: DataFrame, length: int | None = None):
        if POS not in df.columns:
            raise ValueError("a vector needs dense positions: use Vector.from_df or Vector.from_list")
        self._df, self._length = df, length

    # -- sources and sinks ---------------------------------------------------------

    @classmethod
    def from_df(cls, df: DataFrame, *order: str) -> Vector:
        return cls(with_positions(df, *order))

    @classmethod
    def from_list(cls, spark: SparkSession, rows: Iterable[Any], schema: StructType | str) -> Vector:
        struct = spark.createDataFrame([], schema).schema
        rows = [tuple(r) if isinstance(r, (tuple, list, Row)) else (r,) for r in rows]
        with_pos = StructType([*struct.fields, StructField(POS, LongType(), False)])
        return cls(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], with_pos), len(rows))

    @classmethod
    def from_list_n(cls, spark: SparkSession, n: int, rows: Iterable[Any], schema: StructType | str) -> Vector:
        return cls.from_list(spark, list(rows)[: max(0, n)], schema)

    def to_list(self) -> list[tuple]:
        return [tuple(r)[:-1] for r in self._df.select(*self.columns, POS).orderBy(POS).collect()]

    def to_df(self, position: str | None = None) -> DataFrame:
        return self._df.select(*([F.col(POS).alias(position)] if position else []), *self._cols())

    @property
    def columns(self) -> list[str]:
        return [c for c in self._df.columns if c != POS]

    def _cols(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.columns]

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    def _schema(self) -> StructType:
        return StructType([f for f in self._df.schema.fields if f.name != POS])

    def _again(self, df: DataFrame, length: int | None = None) -> Vector:
        return Vector(df.select(*(F.col(f"`{c}`") for c in df.columns if c != POS), POS), length)

    def _renumbered(self, df: DataFrame, length: int | None = None) -> Vector:
        return Vector(with_positions(df.withColumnRenamed(POS, "_old"), "_old").drop("_old"), length)

    def to_rec(self) -> dict[str, Vector]:
        return {c: Vector(self._df.select(F.col(f"`{c}`"), POS), self._length) for c in self.columns}

    @classmethod
    def from_rec(cls, rec: dict[str, Vector]) -> Vector:
        """Columns of equal length side by side."""
        parts = list(rec.items())
        if len({v.length() for _, v in parts}) > 1:
            raise ValueError("columns differ in length")
        df = parts[0][1]._df.select(F.col(f"`{parts[0][1].columns[0]}`").alias(parts[0][0]), POS)
        for name, v in parts[1:]:
            df = df.join(v._df.select(F.col(f"`{v.columns[0]}`").alias(name), POS), POS)
        return cls(df.select(*(f"`{n}`" for n, _ in parts), POS), parts[0][1].length())

    # -- length, elements ----------------------------------------------------------

    def length(self) -> int:
        if self._length is None:
            self._length = self._df.count()
        return self._length

    def null(self) -> bool:
        return self._df.isEmpty() if self._length is None else self._length == 0

    def get(self, i: int) -> tuple | None:
        rows = self._df.filter(F.col(POS) == i).select(*self._cols()).take(1)
        return tuple(rows[0]) if rows else None

    def index(self, i: int) -> tuple:
        found = self.get(i)
        if found is None:
            raise IndexError(f"no position {i}")
        return found

    __getitem__ = unsafe_index = index_m = unsafe_index_m = index

    def head(self) -> tuple:
        return self.index(0)

    def last(self) -> tuple:
        if self.null():
            raise IndexError("empty vector")
        return self.index(self.length() - 1)

    unsafe_head = head_m = unsafe_head_m = head
    unsafe_last = last_m = unsafe_last_m = last

    # -- slices ----------------------------------------------------------------------

    def _between(self, a: int, b: int) -> Vector:
        return self._again(self._df.filter((F.col(POS) >= a) & (F.col(POS) < b)).withColumn(POS, F.col(POS) - a))

    def slice(self, i: int, n: int) -> Vector:
        if i < 0 or n < 0 or i + n > self.length():
            raise IndexError(f"slice {i} {n} of {self.length()} records")
        return self._between(i, i + n)

    def init(self) -> Vector:
        return self.slice(0, self.length() - 1)

    def tail(self) -> Vector:
        return self.slice(1, self.length() - 1)

    def take(self, n: int) -> Vector:
        return self._between(0, max(0, n))

    def drop(self, n: int) -> Vector:
        n = max(0, n)
        return self._again(self._df.filter(F.col(POS) >= n).withColumn(POS, F.col(POS) - n))

    def split_at(self, n: int) -> tuple[Vector, Vector]:
        return self.take(n), self.drop(n)

    unsafe_slice, unsafe_init, unsafe_tail, unsafe_take, unsafe_drop = slice, init, tail, take, drop

    # -- construction ------------------------------------------------------------------

    @classmethod
    def empty(cls, spark: SparkSession, schema: StructType | str) -> Vector:
        return cls.from_list(spark, [], schema)

    @classmethod
    def singleton(cls, spark: SparkSession, row: Any, schema: StructType | str) -> Vector:
        return cls.from_list(spark, [row], schema)

    @classmethod
    def replicate(cls, spark: SparkSession, n: int, row: Any, schema: StructType | str) -> Vector:
        one = cls.from_list(spark, [row], schema)
        return cls(spark.range(max(0, n)).withColumnRenamed("id", POS).crossJoin(F.broadcast(one._df.drop(POS))).select(*one._cols(), POS), max(0, n))

    @classmethod
    def generate(cls, spark: SparkSession, n: int, f: Callable[[Column], Column | list[Column]]) -> Vector:
        made = f(F.col(POS))
        return cls(spark.range(max(0, n)).withColumnRenamed("id", POS).select(*(made if isinstance(made, list) else [made]), POS), max(0, n))

    @classmethod
    def generate_m(cls, spark: SparkSession, n: int, action: Callable[[int], Any], schema: StructType | str) -> Vector:
        return cls.from_list(spark, [action(i) for i in range(max(0, n))], schema)

    @classmethod
    def replicate_m(cls, spark: SparkSession, n: int, action: Callable[[], Any], schema: StructType | str) -> Vector:
        return cls.from_list(spark, [action() for _ in range(max(0, n))], schema)

    @classmethod
    def create(cls, spark: SparkSession, build: Callable[[], Iterable[Any]], schema: StructType | str) -> Vector:
        return cls.from_list(spark, build(), schema)

    @classmethod
    def iterate_n(cls, spark: SparkSession, n: int, f: Callable[[Column], Column], first: Any, kind: str = "bigint") -> Vector:
        """first, f(first), ... as one JVM-side array."""
        if n <= 0:
            return cls.empty(spark, f"value {kind}")
        start = F.array(F.lit(first).cast(kind))
        grown = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, n - 1))), start, lambda a, _: F.concat(a, F.array(f(F.element_at(a, -1)).cast(kind)))) if n > 1 else start
        return cls(spark.range(1).select(F.posexplode(grown).alias(POS, "value")).select("value", F.col(POS).cast("long").alias(POS)), n)

    @classmethod
    def unfoldr(cls, spark: SparkSession, f: Callable[[Any], tuple[Any, Any] | None], seed: Any, schema: StructType | str, most: int | None = None) -> Vector:
        """Rows from a seed until ``f`` gives None; each depends on the one before, so the driver makes them."""

        def made() -> Iterator[Any]:
            state, n = seed, 0
            while (most is None or n < most) and (step := f(state)) is not None:
                row, state = step
                n += 1
                yield row

        return cls.from_list(spark, made(), schema)

    @classmethod
    def unfoldr_n(cls, spark: SparkSession, n: int, f: Callable, seed: Any, schema: StructType | str) -> Vector:
        return cls.unfoldr(spark, f, seed, schema, most=max(0, n))

    @classmethod
    def construct_n(cls, spark: SparkSession, n: int, f: Callable[[list], Any], schema: StructType | str) -> Vector:
        built: list = []
        for _ in range(max(0, n)):
            built.append(f(built))
        return cls.from_list(spark, built, schema)

    @classmethod
    def constructr_n(cls, spark: SparkSession, n: int, f: Callable[[list], Any], schema: StructType | str) -> Vector:
        built: list = []
        for _ in range(max(0, n)):
            built.insert(0, f(built))
        return cls.from_list(spark, built, schema)

    def _literal(self, row: Any) -> DataFrame:
        return Vector.from_list(self.spark, [row], self._schema())._df

    def cons(self, row: Any) -> Vector:
        return self._again(self._literal(row).unionByName(self._df.withColumn(POS, F.col(POS) + 1)))

    def snoc(self, row: Any) -> Vector:
        n = self.length()
        return self._again(self._df.unionByName(self._literal(row).withColumn(POS, F.lit(n).cast("long"))))

    def append(self, other: Vector) -> Vector:
        n = self.length()
        return self._again(self._df.unionByName(other._df.withColumn(POS, F.col(POS) + n)))

    __add__ = append

    @staticmethod
    def concat(vectors: list[Vector]) -> Vector:
        out = vectors[0]
        for v in vectors[1:]:
            out = out.append(v)
        return out

    def force(self) -> Vector:
        return self

    freeze = thaw = copy = unsafe_freeze = unsafe_thaw = unsafe_copy = convert = force

    # -- updates, permutations ------------------------------------------------------------

    def _updates(self, changes: Iterable[tuple[int, Any]], schema: StructType) -> DataFrame:
        changes = list(changes)
        n = self.length()
        for i, _ in changes:
            if not 0 <= i < n:
                raise IndexError(f"no position {i} among {n}")
        v = Vector.from_list(self.spark, [r for _, r in changes], schema)
        at = self.spark.createDataFrame([(k, i) for k, (i, _) in enumerate(changes)], "_seq long, _to long")
        return v._df.join(F.broadcast(at), F.col(POS) == F.col("_seq")).drop(POS)

    def update(self, changes: Iterable[tuple[int, Any]] | DataFrame) -> Vector:
        """Records replaced at positions; the last change of a position holds. A DataFrame of changes has ``_to``, ``_seq`` and the columns."""
        changes = changes if isinstance(changes, DataFrame) else self._updates(changes, self._schema())
        new = changes.groupBy("_to").agg(F.max_by(F.struct(*self._cols()), "_seq").alias("_new"))
        joined = self._df.join(new, F.col(POS) == F.col("_to"), "left")
        return self._again(joined.select(*(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(f"`{c}`")).alias(c) for c in self.columns), POS), self._length)

    unsafe_upd = update

    def accum(self, column: str, f: Callable[[Column, Column], Column] | str, changes: Iterable[tuple[int, Any]] | DataFrame) -> Vector:
        """Folds each (position, value) into a column, in order; a named ``f`` is pre-aggregated."""
        kind = self._df.schema[column].dataType
        if not isinstance(changes, DataFrame):
            changes = self._updates(((i, (c,)) for i, c in changes), StructType([StructField("_c", kind)]))
        if isinstance(f, str):
            part = changes.groupBy("_to").agg(getattr(F, f)("_c").alias("_c"))
            value = combine(f, F.col(f"`{column}`"), F.col("_c"))
        else:
            part = changes.groupBy("_to").agg(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_c"))), lambda x: x["_c"]).alias("_cs"))
            value = F.aggregate(F.coalesce("_cs", F.array().cast(f"array<{kind.simpleString()}>")), F.col(f"`{column}`"), lambda a, c: f(a, c).cast(kind))
        joined = self._df.join(part, F.col(POS) == F.col("_to"), "left").withColumn("_folded", value.cast(kind))
        return self._again(joined.select(*(F.col("_folded").alias(c) if c == column else F.col(f"`{c}`") for c in self.columns), POS), self._length)

    unsafe_accum = accum

    def reverse(self) -> Vector:
        n = self.length()
        return self._again(self._df.withColumn(POS, F.lit(n - 1) - F.col(POS)), n)

    def sort(self, *columns: str) -> Vector:
        """Stable ascending sort; all columns in order when none are named."""
        df = self._df.withColumnRenamed(POS, "_old")
        return Vector(with_positions(df, *(columns or self.columns), "_old").drop("_old"), self._length)

    def modify(self, algorithm: Callable[[Vector], Vector]) -> Vector:
        return algorithm(self)

    # -- maps, zips --------------------------------------------------------------------------

    def map(self, *columns: Column) -> Vector:
        return Vector(self._df.select(*columns, POS), self._length)

    def imap(self, f: Callable[[Column], list[Column]]) -> Vector:
        return Vector(self._df.select(*f(F.col(POS)), POS), self._length)

    def concat_map(self, array: Column, name: str = "value") -> Vector:
        """Each record becomes the elements of an array, in order; structs spread into columns."""
        df = self._df.select(F.col(POS).alias("_old"), F.posexplode(array).alias("_sub", name))
        return Vector(with_positions(df, "_old", "_sub").drop("_old", "_sub"))

    def map_rows(self, f: Callable[[tuple], Any], schema: StructType | str) -> Vector:
        struct = self.spark.createDataFrame([], schema).schema
        names, out = self.columns, StructType([*struct.fields, StructField(POS, LongType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                made = [f(r) for r in pdf[names].itertuples(index=False, name=None)]
                made = [r if isinstance(r, tuple) else (r,) for r in made]
                yield pd.DataFrame(made, columns=struct.names).assign(**{POS: pdf[POS].to_numpy()})

        return Vector(self._df.mapInPandas(run, out), self._length)

    map_m = for_m = map_rows

    def map_rows_(self, f: Callable[[tuple], Any]) -> None:
        names = self.columns
        self._df.select(*names).foreach(lambda r: f(tuple(r)))

    map_m_ = for_m_ = map_rows_

    def zip(self, other: Vector) -> Vector:
        """Records side by side up to the shorter length; column names must differ."""
        if set(self.columns) & set(other.columns):
            raise ValueError("column names of zipped vectors must differ")
        return self._again(self._df.join(other._df, POS))

    def zip_with(self, other: Vector, *columns: Column) -> Vector:
        return self.zip(other).map(*columns)

    def zip_with_m(self, other: Vector, f: Callable[[tuple, tuple], Any], schema: StructType | str) -> Vector:
        k = len(self.columns)
        return self.zip(other).map_rows(lambda r: f(r[:k], r[k:]), schema)

    def zip_with_m_(self, other: Vector, f: Callable[[tuple, tuple], Any]) -> None:
        k = len(self.columns)
        self.zip(other).map_rows_(lambda r: f(r[:k], r[k:]))

    # -- filters -------------------------------------------------------------------------------

    def filter(self, condition: Column) -> Vector:
        return self._renumbered(self._df.filter(condition))

    def ifilter(self, f: Callable[[Column], Column]) -> Vector:
        return self._renumbered(self._df.filter(f(F.col(POS))))

    def filter_m(self, f: Callable[[tuple], bool]) -> Vector:
        names = self.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[[bool(f(r)) for r in pdf[names].itertuples(index=False, name=None)]]

        return self._renumbered(self._df.mapInPandas(run, self._df.schema))

    def _first_failure(self, condition: Column) -> int:
        found = self._df.filter(~F.coalesce(condition, F.lit(False))).agg(F.min(POS)).first()[0]
        return self.length() if found is None else found

    def take_while(self, condition: Column) -> Vector:
        return self.take(self._first_failure(condition))

    def drop_while(self, condition: Column) -> Vector:
        return self.drop(self._first_failure(condition))

    def span(self, condition: Column) -> tuple[Vector, Vector]:
        return self.split_at(self._first_failure(condition))

    def break_(self, condition: Column) -> tuple[Vector, Vector]:
        return self.span(~F.coalesce(condition, F.lit(False)))

    def partition(self, condition: Column) -> tuple[Vector, Vector]:
        holds = F.coalesce(condition, F.lit(False))
        return self.filter(holds), self.filter(~holds)

    unstable_partition = partition

    # -- searches --------------------------------------------------------------------------------

    def _is(self, row: Any) -> Column:
        row = row if isinstance(row, (tuple, list)) else (row,)
        return all_equal(self._cols(), [F.lit(v) for v in row])

    def elem(self, row: Any) -> bool:
        return not self._df.filter(self._is(row)).isEmpty()

    def not_elem(self, row: Any) -> bool:
        return not self.elem(row)

    def find_index(self, condition: Column) -> int | None:
        return self._df.filter(condition).agg(F.min(POS)).first()[0]

    def find(self, condition: Column) -> tuple | None:
        i = self.find_index(condition)
        return None if i is None else self.index(i)

    def elem_index(self, row: Any) -> int | None:
        return self.find_index(self._is(row))

    # -- folds --------------------------------------------------------------------------------------

    def aggregate(self, *aggregates: Column) -> DataFrame:
        """Folds that Spark has as aggregates, in one distributed pass."""
        return self._df.agg(*aggregates)

    def _ordered(self) -> Column:
        return F.array_sort(F.collect_list(F.struct(F.col(POS), *self._cols())))

    def fold(self, f: Callable[[Column, Column], Column], zero: Column | None, right: bool = False) -> DataFrame:
        """One row, one column: the fold of the records (structs that also hold ``_pos``) in order, or from the right.

        Without ``zero`` the first record (the last, from the right) starts it.
        """
        records = F.reverse(self._ordered()) if right else self._ordered()
        step = (lambda a, x: f(x, a)) if right else f
        if zero is not None:
            return self._df.agg(F.aggregate(records, zero, step).alias("value"))
        if self.null():
            raise ValueError("fold of an empty vector")
        return self._df.agg(_let(records, lambda a: F.aggregate(F.slice(a, F.lit(2), F.size(a)), F.get(a, 0), step)).alias("value"))

    def foldl(self, f: Callable, zero: Column) -> Any:
        return self.fold(f, zero).first()[0]

    def foldl1(self, f: Callable) -> Any:
        return self.fold(f, None).first()[0]

    def foldr(self, f: Callable, zero: Column) -> Any:
        return self.fold(f, zero, right=True).first()[0]

    def foldr1(self, f: Callable) -> Any:
        return self.fold(f, None, right=True).first()[0]

    foldl_strict, foldl1_strict, foldr_strict, foldr1_strict = foldl, foldl1, foldr, foldr1

    def ifoldl(self, f: Callable[[Column, Column, Column], Column], zero: Column) -> Any:
        return self.foldl(lambda a, x: f(a, x[POS], x), zero)

    def ifoldr(self, f: Callable[[Column, Column, Column], Column], zero: Column) -> Any:
        return self.foldr(lambda x, a: f(x[POS], x, a), zero)

    ifoldl_strict, ifoldr_strict = ifoldl, ifoldr

    def fold_m(self, f: Callable[[Any, tuple], Any], zero: Any) -> Any:
        """A Python fold on the driver over rows streamed in order; holds one partition at a time."""
        for r in self._df.select(*self.columns, POS).orderBy(POS).toLocalIterator():
            zero = f(zero, tuple(r)[:-1])
        return zero

    def fold1_m(self, f: Callable[[Any, tuple], Any]) -> Any:
        first = self.head()
        return self.drop(1).fold_m(f, first)

    def fold_m_(self, f: Callable[[Any, tuple], Any], zero: Any) -> None:
        self.fold_m(f, zero)

    def fold1_m_(self, f: Callable[[Any, tuple], Any]) -> None:
        self.fold1_m(f)

    fold_m_strict, fold1_m_strict, fold_m_strict_, fold1_m_strict_ = fold_m, fold1_m, fold_m_, fold1_m_

    def all(self, condition: Column) -> bool:
        return self._df.agg(F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True))).first()[0]

    def any(self, condition: Column) -> bool:
        return self._df.agg(F.coalesce(F.bool_or(F.coalesce(condition, F.lit(False))), F.lit(False))).first()[0]

    def extreme(self, greatest: bool, *keys: Column) -> DataFrame:
        """The record of greatest (least) key with its position; the first of equals."""
        by = keys or tuple(self._cols())
        order = [k.desc_nulls_last() if greatest else k.asc_nulls_first() for k in by]
        return self._df.orderBy(*order, F.col(POS).asc()).limit(1)

    def _extreme(self, greatest: bool, *keys: Column) -> Row:
        found = self.extreme(greatest, *keys).select(*self._cols(), POS).take(1)
        if not found:
            raise ValueError("empty vector")
        return found[0]

    def maximum(self) -> tuple:
        return tuple(self._extreme(True))[:-1]

    def minimum(self) -> tuple:
        return tuple(self._extreme(False))[:-1]

    def maximum_by(self, *keys: Column) -> tuple:
        return tuple(self._extreme(True, *keys))[:-1]

    def minimum_by(self, *keys: Column) -> tuple:
        return tuple(self._extreme(False, *keys))[:-1]

    def max_index(self, *keys: Column) -> int:
        return self._extreme(True, *keys)[POS]

    def min_index(self, *keys: Column) -> int:
        return self._extreme(False, *keys)[POS]

    max_index_by, min_index_by = max_index, min_index

    # -- scans ------------------------------------------------------------------------------------

    def _scan(self, op: str | Callable, value: Column, zero: Any, reverse: bool, exclusive: bool, out: str) -> Vector:
        if isinstance(op, str):
            start = F.lit(zero) if zero is not None else F.lit(None)
            df = running(self._df, op, value, "_scan", reverse, exclusive)
            kind = df.schema["_scan"].dataType
            return Vector(df.select(combine(op, start.cast(kind), F.col("_scan")).alias(out), POS), self._length)
        records = F.transform(F.array_sort(F.collect_list(F.struct(F.col(POS), value.alias("v")))), lambda x: x["v"])
        # The results have the type of a zero given as a Column, else that of the values.
        kind = self._df.select(zero if isinstance(zero, Column) else value).schema[0].dataType
        step = (lambda a, x: op(x, a).cast(kind)) if reverse else (lambda a, x: op(a, x).cast(kind))

        def states(a: Column) -> Column:
            a = F.reverse(a) if reverse else a
            begin = F.array(F.lit(zero).cast(kind)) if zero is not None else F.slice(a, 1, 1)
            rest = a if zero is not None else F.slice(a, F.lit(2), F.size(a))
            grown = F.aggregate(rest, begin, lambda s, x: F.concat(s, F.array(step(F.element_at(s, -1), x))))
            if zero is not None:
                grown = _let(grown, lambda s: F.slice(s, F.lit(1 if exclusive else 2), F.size(s) - 1))
            return F.reverse(grown) if reverse else grown

        made = self._df.agg(records.alias("a")).select(F.posexplode(F.when(F.size("a") > 0, _let(F.col("a"), states))).alias(POS, out))
        return Vector(made.select(out, F.col(POS).cast("long").alias(POS)), self._length)

    def prescanl(self, op, value: Column, zero: Any, out: str = "value") -> Vector:
        return self._scan(op, value, zero, False, True, out)

    def postscanl(self, op, value: Column, zero: Any, out: str = "value") -> Vector:
        return self._scan(op, value, zero, False, False, out)

    def scanl(self, op, value: Column, zero: Any, out: str = "value") -> Vector:
        return self.postscanl(op, value, zero, out).cons((zero,))

    def scanl1(self, op, value: Column, out: str = "value") -> Vector:
        return self._scan(op, value, None, False, False, out)

    def prescanr(self, op, value: Column, zero: Any, out: str = "value") -> Vector:
        return self._scan(op, value, zero, True, True, out)

    def postscanr(self, op, value: Column, zero: Any, out: str = "value") -> Vector:
        return self._scan(op, value, zero, True, False, out)

    def scanr(self, op, value: Column, zero: Any, out: str = "value") -> Vector:
        return self.postscanr(op, value, zero, out).snoc((zero,))

    def scanr1(self, op, value: Column, out: str = "value") -> Vector:
        return self._scan(op, value, None, True, False, out)

    prescanl_strict, postscanl_strict, scanl_strict, scanl1_strict = prescanl, postscanl, scanl, scanl1
    prescanr_strict, postscanr_strict, scanr_strict, scanr1_strict = prescanr, postscanr, scanr, scanr1

    # -- runs -----------------------------------------------------------------------------------

    def uniq(self, *columns: str) -> Vector:
        """Drops records equal to the one just before (in the named columns)."""
        own = F.struct(*(F.col(f"`{c}`") for c in columns or self.columns))
        return self._renumbered(runs(self._df.withColumn("_own", own), "_own").drop("_own"))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Vector) and self.columns == other.columns and self.to_list() == other.to_list()

    __hash__ = None  # type: ignore[assignment]


def runs(df: DataFrame, column: str) -> DataFrame:
    """Rows that differ from the row one position before.

    Rows are compared within runs of ``RUN`` positions; the first of a run meets the last of the
    run before by the run's number, which both sides are already dealt by.
    """
    run = F.floor(F.col(POS) / RUN)
    ends = df.filter(F.col(POS) % RUN == RUN - 1).select((run + 1).alias("_run"), F.struct(F.col(column).alias("v")).alias("_end"))
    order = Window.partitionBy("_run").orderBy(POS)
    placed = df.withColumn("_run", run).withColumn("_before", F.lag(F.struct(F.col(column).alias("v"))).over(order))
    joined = placed.join(ends, "_run", "left").withColumn("_before", F.coalesce("_before", "_end"))
    return joined.filter(F.col("_before").isNull() | ~F.col(column).eqNullSafe(F.col("_before.v"))).drop("_run", "_before", "_end")


class MutableVector:
    """A named place that holds a vector: writes put a new vector there."""

    def __init__(self, vector: Vector):
        self.vector = vector

    @classmethod
    def replicate(cls, spark: SparkSession, n: int, row: Any, schema: StructType | str) -> MutableVector:
        return cls(Vector.replicate(spark, n, row, schema))

    new = unsafe_new = replicate

    @classmethod
    def replicate_m(cls, spark: SparkSession, n: int, action: Callable[[], Any], schema: StructType | str) -> MutableVector:
        return cls(Vector.replicate_m(spark, n, action, schema))

    def clone(self) -> MutableVector:
        return MutableVector(self.vector)

    def length(self) -> int:
        return self.vector.length()

    def null(self) -> bool:
        return self.vector.null()

    def read(self, i: int) -> tuple:
        return self.vector.index(i)

    def write(self, i: int, row: Any) -> None:
        self.vector = self.vector.update([(i, row)])

    def swap(self, i: int, j: int) -> None:
        self.vector = self.vector.update([(i, self.read(j)), (j, self.read(i))])

    unsafe_read, unsafe_write, unsafe_swap = read, write, swap

    def set(self, row: Any) -> None:
        self.vector = Vector.replicate(self.vector.spark, self.length(), row, self.vector._schema())

    def copy(self, source: MutableVector) -> None:
        if source.length() != self.length():
            raise ValueError("lengths differ")
        self.vector = source.vector

    move = unsafe_copy = unsafe_move = copy

    def grow(self, n: int, row: Any) -> MutableVector:
        return MutableVector(self.vector + Vector.replicate(self.vector.spark, n, row, self.vector._schema()))

    unsafe_grow = grow

    def slice(self, i: int, n: int) -> MutableVector:
        return MutableVector(self.vector.slice(i, n))

    def take(self, n: int) -> MutableVector:
        return MutableVector(self.vector.take(n))

    def drop(self, n: int) -> MutableVector:
        return MutableVector(self.vector.drop(n))

    def init(self) -> MutableVector:
        return MutableVector(self.vector.init())

    def tail(self) -> MutableVector:
        return MutableVector(self.vector.tail())

    def split_at(self, n: int) -> tuple[MutableVector, MutableVector]:
        a, b = self.vector.split_at(n)
        return MutableVector(a), MutableVector(b)

    unsafe_slice, unsafe_take, unsafe_drop, unsafe_init, unsafe_tail = slice, take, drop, init, tail

    def overlaps(self, other: MutableVector) -> bool:
        """Nothing is shared in memory; the same vector counts as overlap."""
        return self.vector is other.vector

    def clear(self) -> None:
        """Nothing to release: vectors hold no buffers."""
