import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql.types import LongType, MapType, StringType

from codrel.functions.types import check_constant, type_of
from codrel.plans.schema import Schema

NAMES = st.sets(st.sampled_from("abcdefg"))


def of(names) -> Schema:
    return Schema.of((n, LongType()) for n in names)


@given(NAMES, NAMES, NAMES)
def test_laws(a, b, c):
    x, y, z = of(a), of(b), of(c)
    assert x.names == sorted(a, reverse=True)
    assert x.union(y) == y.union(x) and x.union(y).union(z) == x.union(y.union(z)) and x.union(of(())) == x
    assert set(x.subtract(y).names) == a - b and set(x.intersect(y).names) == a & b
    assert x.intersect(y) == x.subtract(x.subtract(y))
    assert x.union(y).contains(x) and x.contains(x.intersect(y))
    for n in a:
        assert x.remove(n).insert(n, LongType()) == x


def test_errors():
    with pytest.raises(ValueError):
        Schema.of([("a", LongType()), ("a", LongType())])
    with pytest.raises(TypeError):
        of("a").union(Schema.of([("a", StringType())]))
    with pytest.raises(TypeError):
        Schema.of([("m", MapType(LongType(), LongType()))])


def test_types():
    assert type_of(("int", ["text"])).simpleString() == "struct<_1:bigint,_2:array<string>>"
    assert type_of({"either": ("int", "day")}).simpleString() == "struct<is_left:boolean,left:bigint,right:date>"
    assert type_of({"maybe": "word64"}).simpleString() == "decimal(20,0)"
    with pytest.raises(TypeError):
        check_constant(True, LongType())
