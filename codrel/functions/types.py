"""Column types: the table of value types and how composite values are kept in columns."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType,
    StructField, StructType, TimestampNTZType, TimestampType,
)

#: Value types by their usual names; unsigned ones take the next wider signed type.
TYPES: dict[str, DataType] = {
    "int": LongType(), "int8": ByteType(), "int16": ShortType(), "int32": IntegerType(), "int64": LongType(),
    "word8": ShortType(), "word16": IntegerType(), "word32": LongType(), "word64": DecimalType(20, 0),
    "float": FloatType(), "double": DoubleType(), "bool": BooleanType(), "char": StringType(), "text": StringType(), "bytes": BinaryType(), "day": DateType(),
}


def type_of(spec: Any) -> DataType:
    """``"int"``, ``["int"]`` (list), ``("int", "text")`` (pair or triple), ``{"maybe": "int"}``, ``{"either": ("int", "text")}`` or a Spark type."""
    if isinstance(spec, DataType):
        return spec
    if isinstance(spec, str):
        return TYPES[spec.lower()]
    if isinstance(spec, list):
        return ArrayType(type_of(spec[0]))
    if isinstance(spec, tuple):
        return StructType([StructField(f"_{i}", type_of(s)) for i, s in enumerate(spec, 1)])
    if isinstance(spec, dict) and "maybe" in spec:
        return type_of(spec["maybe"])  # a nullable column; absence equals absence and comes first
    if isinstance(spec, dict) and "either" in spec:
        left, right = spec["either"]
        return StructType([StructField("is_left", BooleanType(), False), StructField("left", type_of(left)), StructField("right", type_of(right))])
    raise TypeError(f"no column type for {spec!r}")


def left(value: Column, right_type: DataType) -> Column:
    return F.struct(F.lit(True).alias("is_left"), value.alias("left"), F.lit(None).cast(right_type).alias("right"))


def right(value: Column, left_type: DataType) -> Column:
    return F.struct(F.lit(False).alias("is_left"), F.lit(None).cast(left_type).alias("left"), value.alias("right"))


_PYTHON = (
    (bool, (BooleanType,)), (int, (ByteType, ShortType, IntegerType, LongType, DecimalType)), (float, (FloatType, DoubleType)), (str, (StringType,)),
    (bytes, (BinaryType,)), (bytearray, (BinaryType,)), (datetime.datetime, (TimestampType, TimestampNTZType)), (datetime.date, (DateType,)),
)


def check_constant(value: Any, kind: DataType) -> None:
    """A constant must be of the column's own type: nothing is cast implicitly."""
    if value is None:
        return
    for python, kinds in _PYTHON:
        if isinstance(value, python):
            if not isinstance(kind, kinds):
                break
            return
    else:
        if isinstance(value, (list, tuple)) and isinstance(kind, (ArrayType, StructType)):
            return
    raise TypeError(f"{value!r} is not a value of {kind.simpleString()}")


def constant(value: Any, kind: DataType) -> Column:
    check_constant(value, kind)
    if isinstance(kind, ArrayType) and value is not None:
        return F.array(*(constant(v, kind.elementType) for v in value)).cast(kind)
    if isinstance(kind, StructType) and value is not None:
        return F.struct(*(constant(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)))
    return F.lit(value).cast(kind)
