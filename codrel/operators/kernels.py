"""Kernels on vectors and columns: join indices, runs, sorting with indices, gather and masks, dynamic records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .positions import POS
from .vector import Vector


def join_indices(left: Vector, right: Vector, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(left_pos, right_pos) of all records whose key columns are equal; by default all columns, in order."""
    pairs = pairs or list(zip(left.columns, right.columns, strict=True))
    a = left.to_df("_l").select(F.col("_l"), *(F.col(f"`{x}`").alias(f"_l{i}") for i, (x, _) in enumerate(pairs)))
    b = right.to_df("_r").select(F.col("_r"), *(F.col(f"`{y}`").alias(f"_r{i}") for i, (_, y) in enumerate(pairs)))
    for i in range(len(pairs)):
        if a.schema[f"_l{i}"].dataType != b.schema[f"_r{i}"].dataType:
            raise TypeError(f"key columns {pairs[i]} differ in type")
    on = reduce(lambda x, y: x & y, (F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}")) for i in range(len(pairs))))
    return a.join(b, on).select(F.col("_l").alias("left_pos"), F.col("_r").alias("right_pos"))


def join_indices_naive(left: list, right: list) -> list[tuple[int, int]]:
    """Quadratic specification."""
    return [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x == y]


def matching_indices(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right) positions of two inputs (pos, key) with equal keys, by a merge of both in key order; equal runs give their full product."""
    a, b = left.select(F.col("pos").alias("left"), F.col("key").alias("_a")), right.select(F.col("pos").alias("right"), F.col("key").alias("_b"))
    return a.hint("merge").join(b, F.col("_a").eqNullSafe(F.col("_b"))).select("left", "right")


def uniq(vector: Vector, *columns: str) -> Vector:
    return vector.uniq(*columns)


def remove_duplicates(df: DataFrame) -> DataFrame:
    return df.distinct() if df.columns else df.limit(1)


def sort_with_indices(vector: Vector, *columns: str) -> Vector:
    """Sorted records with the position each came from, as ``index``."""
    indexed = Vector(vector._df.withColumn("index", F.col(POS)), vector._length)
    return indexed.sort(*(columns or vector.columns))


def argsort(vector: Vector, *columns: str) -> Vector:
    return sort_with_indices(vector, *columns).map(F.col("index"))


def index_many(indices: Vector, vector: Vector) -> Vector:
    """Gather: the record at each index, in the order of the indices."""
    wanted = indices.to_df("_out").toDF("_out", "_at")
    out = wanted.join(vector._df.withColumnRenamed(POS, "_at"), "_at").withColumnRenamed("_out", POS)
    return Vector(out.select(*(f"`{c}`" for c in vector.columns), POS), indices._length)


def index_many_predicate(condition: Column, indices: Vector, vector: Vector) -> Vector:
    return index_many(indices, vector).map(F.coalesce(condition, F.lit(False)).alias("mask"))


def to_record(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` as exactly the given static schema: raises on a missing name, another type, or columns left over."""
    for field in schema.fields:
        if field.name not in df.columns:
            raise KeyError(f"missing column {field.name!r}")
        if df.schema[field.name].dataType != field.dataType:
            raise TypeError(f"column {field.name!r} is {df.schema[field.name].dataType.simpleString()}, not {field.dataType.simpleString()}")
    if over := [c for c in df.columns if c not in schema.names]:
        raise ValueError(f"columns left over: {over}")
    return df.select(*(f"`{n}`" for n in schema.names))


def zip_names(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def constant_record(schema: StructType, f: Callable[[DataType], Any]) -> dict[str, Column]:
    """A literal for each field, made from its type alone."""
    return {field.name: F.lit(f(field.dataType)).cast(field.dataType).alias(field.name) for field in schema.fields}


def show_record(*columns: str) -> Column:
    """``name: value, name: value`` as one string."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))) for c in columns))


def same_type(a: DataFrame, b: DataFrame) -> bool:
    return [(f.name, f.dataType) for f in a.schema.fields] == [(f.name, f.dataType) for f in b.schema.fields]
