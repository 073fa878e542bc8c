"""Parquet tables as DataFrames and relations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators.relation import Relation, table


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def relation(spark: SparkSession, folder: str, name: str, columns: Iterable[str] | None = None, key: Iterable[str] | None = None) -> Relation:
    df = read(spark, folder, name)
    return table(df.select(*columns) if columns is not None else df, name, key)
