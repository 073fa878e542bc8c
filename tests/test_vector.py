import random

import pytest
from pyspark.sql import functions as F

from codrel import Vector
from codrel.functions.types import left, right
from codrel.operators import kernels, positions
from codrel.operators.vector import MutableVector
from codrel.sources import datagen

X = None  # the column x, once a session runs


@pytest.fixture(scope="module")
def vec(spark):
    global X
    X = F.col("x")
    return lambda values: Vector.from_list(spark, values, "x long")


def flat(v):
    return [r[0] for r in v.to_list()]


def test_elements_and_slices(vec):
    v = vec([5, 9, 2, 7])
    assert (v.length(), v.null(), v[1], v.get(4), v.head(), v.last()) == (4, False, (9,), None, (5,), (7,))
    assert flat(v.slice(1, 2)) == [9, 2] and flat(v.init()) == [5, 9, 2] and flat(v.tail()) == [9, 2, 7]
    assert flat(v.take(9)) == [5, 9, 2, 7] and flat(v.drop(3)) == [7] and [flat(p) for p in v.split_at(1)] == [[5], [9, 2, 7]]
    assert v.drop(3)[0] == (7,)
    for bad in (lambda: v[4], lambda: v.slice(3, 2), vec([]).head, vec([]).last, vec([]).maximum, lambda: vec([]).foldl1(lambda a, r: a)):
        with pytest.raises((IndexError, ValueError)):
            bad()


def test_construction(spark, vec):
    assert flat(Vector.unfoldr(spark, lambda n: (n, n - 1) if n else None, 10, "x long")) == list(range(10, 0, -1))
    assert flat(Vector.unfoldr_n(spark, 3, lambda n: (n, n - 1) if n else None, 10, "x long")) == [10, 9, 8]
    assert flat(Vector.iterate_n(spark, 4, lambda c: c * 2, 1)) == [1, 2, 4, 8] and flat(Vector.iterate_n(spark, 1, lambda c: c, 3)) == [3] and flat(Vector.iterate_n(spark, 0, lambda c: c, 3)) == []
    assert flat(Vector.replicate(spark, 3, 7, "x long")) == [7, 7, 7] and flat(Vector.generate(spark, 3, lambda i: (i * i).alias("x"))) == [0, 1, 4]
    assert flat(Vector.construct_n(spark, 4, lambda p: sum(p) + 1, "x long")) == [1, 2, 4, 8] and flat(Vector.constructr_n(spark, 3, lambda p: len(p), "x long")) == [2, 1, 0]
    assert flat(Vector.from_list_n(spark, 2, [1, 2, 3], "x long")) == [1, 2] and flat(Vector.empty(spark, "x long")) == [] and flat(Vector.singleton(spark, 4, "x long")) == [4]
    assert flat(Vector.generate_m(spark, 2, lambda i: i + 1, "x long")) == [1, 2] and flat(Vector.replicate_m(spark, 2, lambda: 5, "x long")) == [5, 5]
    assert flat(Vector.create(spark, lambda: [3, 1], "x long")) == [3, 1]
    v = vec([1, 1])
    assert flat(v.cons(0)) == [0, 1, 1] and flat(v.snoc(2)) == [1, 1, 2] and flat(v + v) == [1] * 4 and flat(Vector.concat([v, vec([]), v])) == [1] * 4


def test_updates(vec):
    assert flat(vec([5, 9, 2, 7]).update([(2, 1), (0, 3), (2, 8)])) == [3, 9, 8, 7]
    changes = [(2, 4), (1, 6), (0, 3), (1, 7)]
    assert flat(vec([5, 9, 2]).accum("x", lambda a, c: a + c, changes)) == flat(vec([5, 9, 2]).accum("x", "sum", changes)) == [8, 22, 6]
    assert flat(vec([5, 9, 2]).accum("x", lambda a, c: a * 10 + c, [(0, 1), (0, 2)])) == [512, 9, 2]
    with pytest.raises(IndexError):
        vec([1]).update([(1, 1)])
    assert flat(vec([5, 9, 2]).reverse()) == [2, 9, 5] and flat(vec([5, 9, 2]).modify(lambda v: v.sort())) == [2, 5, 9]


def test_maps_filters_searches(vec):
    v = vec([5, 9, 2, 7])
    assert flat(v.map((X + 1).alias("y"))) == [6, 10, 3, 8] and flat(v.imap(lambda p: [(X * p).alias("y")])) == [0, 9, 4, 21]
    assert flat(vec([2, 0, 1]).concat_map(F.when(X > 0, F.sequence(F.lit(1).cast("long"), X)).otherwise(F.array().cast("array<bigint>")))) == [1, 2, 1]
    assert flat(v.map_rows(lambda r: r[0] * 2, "y long")) == [10, 18, 4, 14] and flat(v.filter_m(lambda r: r[0] > 5)) == [9, 7]
    other = v.map((X * 10).alias("y")).take(3)
    assert v.zip(other).to_list() == [(5, 50), (9, 90), (2, 20)] and flat(v.zip_with(other, (F.col("y") - X).alias("z"))) == [45, 81, 18]
    assert flat(v.zip_with_m(other, lambda a, b: a[0] + b[0], "z long")) == [55, 99, 22]
    assert flat(v.filter(X > 4)) == [5, 9, 7] and flat(v.ifilter(lambda p: p % 2 == 1)) == [9, 7] and v.filter(X > 5)[1] == (7,)
    assert flat(v.take_while(X > 4)) == [5, 9] and flat(v.drop_while(X > 4)) == [2, 7] and [flat(p) for p in v.span(X > 4)] == [[5, 9], [2, 7]]
    assert [flat(p) for p in v.break_(X > 5)] == [[5], [9, 2, 7]] and [flat(p) for p in v.partition(X > 5)] == [[9, 7], [5, 2]]
    assert v.elem(9) and v.not_elem(1) and v.find(X > 5) == (9,) and v.find_index(X > 99) is None and v.elem_index(7) == 3


def test_folds(vec):
    v = vec([5, 9, 2, 7])
    zero = F.lit(0).cast("long")
    assert v.foldl(lambda a, r: a - r.x, zero) == -23 and v.foldr(lambda r, a: r.x - a, zero) == -9
    assert v.ifoldl(lambda a, i, r: a + i * r.x, zero) == 34 and v.ifoldr(lambda i, r, a: a * 2 + i, zero) == 34
    assert v.map_rows(lambda r: r[0], "x long").foldl1(lambda a, r: F.when(a.x < r.x, a).otherwise(r))["x"] == 2
    assert v.fold_m(lambda a, r: a * 2 + r[0], 0) == 87 and v.fold1_m(lambda a, r: (a[0] - r[0],)) == (-13,)
    assert v.all(X > 1) and not v.all(X > 2) and v.any(X == 2) and vec([]).all(X > 1) and not vec([]).any(X > 1)
    w = vec([3, 8, 3, 8])
    assert (w.max_index(), w.min_index(), w.maximum(), w.minimum(), w.maximum_by(-X)) == (1, 0, (8,), (3,), (3,))


@pytest.mark.parametrize("op", ["sum", lambda a, c: a + c])
def test_scans(vec, op):
    v = vec([1, 2, 3, 4])
    expected = {"prescanl": [0, 1, 3, 6], "postscanl": [1, 3, 6, 10], "scanl": [0, 1, 3, 6, 10], "prescanr": [9, 7, 4, 0], "postscanr": [10, 9, 7, 4], "scanr": [10, 9, 7, 4, 0]}
    for name, values in expected.items():
        assert flat(getattr(v, name)(op, X, 0)) == values, name
    assert flat(v.scanl1(op, X)) == [1, 3, 6, 10] and flat(v.scanr1(op, X)) == [10, 9, 7, 4]
    assert flat(vec([]).postscanl(op, X, 0)) == []


def test_scan_order_matters(vec):
    v = vec([7, 2, 1])
    assert flat(v.postscanl(lambda a, c: a - c, X, 20)) == [13, 11, 10] and flat(v.postscanr(lambda c, a: c - a, X, 0)) == [6, 1, 1]


def test_distributed_positions_and_scans(spark, monkeypatch):
    monkeypatch.setattr(positions, "ONE_WINDOW", 10)
    monkeypatch.setattr(positions, "ROWS_PER_BUCKET", 50)
    monkeypatch.setattr(positions, "RUN", 16)
    g = random.Random(2)
    keys = [g.choice([None, *range(40)]) for _ in range(400)]
    df = spark.createDataFrame(list(zip(keys, range(400), strict=True)), "k long, x long").repartition(7)
    v = Vector.from_df(df, "k", "x")
    ordered = sorted(zip(keys, range(400), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert v.to_list() == ordered
    total, sums = 0, []
    for _, x in ordered:
        total += x
        sums.append(total)
    assert flat(v.postscanl("sum", X, 0)) == sums and flat(v.prescanl("sum", X, 0)) == [0, *sums[:-1]]
    xs = [x for _, x in ordered]
    assert flat(v.scanr1("max", X)) == [max(xs[i:]) for i in range(400)] and flat(v.scanl1("min", X)) == [min(xs[: i + 1]) for i in range(400)]


def test_kernels(spark, vec):
    a, b = list(range(0, 21, 3)), list(range(0, 21, 5))
    assert sorted(map(tuple, kernels.join_indices(vec(a), vec(b)).collect())) == kernels.join_indices_naive(a, b) == [(0, 0), (5, 3)]
    g = random.Random(1)
    for _ in range(3):
        a, b = ([g.choice([None, 1, 2, 3]) for _ in range(g.randrange(9))] for _ in range(2))
        assert sorted(map(tuple, kernels.join_indices(vec(a), vec(b)).collect())) == kernels.join_indices_naive(a, b)
    assert flat(kernels.uniq(vec([1, 1, 2, 2, None, None, 1]))) == [1, 2, None, 1] and flat(kernels.uniq(vec([]))) == []
    v = vec([5, 9, 2, 7])
    assert flat(kernels.argsort(v)) == [2, 0, 3, 1] and flat(kernels.index_many(vec([3, 0, 0]), v)) == [7, 5, 5]
    assert flat(kernels.index_many_predicate(X > 5, vec([3, 0]), v)) == [True, False]
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    assert kernels.to_record(df, df.select("y", "x").schema).columns == ["y", "x"]
    for schema in (df.select("x").schema, df.selectExpr("x", "y", "1 as z").schema, df.selectExpr("cast(x as int) x", "y").schema):
        with pytest.raises((KeyError, TypeError, ValueError)):
            kernels.to_record(df, schema)
    assert kernels.zip_names(df, ["p", "q"]).select(kernels.show_record("p", "q")).first()[0] == "p: 1, q: a"
    assert kernels.remove_duplicates(df.union(df)).count() == 1


def test_records_of_columns_and_mutation(spark, vec):
    v = Vector.from_list(spark, [(1, "a"), (2, "b")], "x long, y string")
    assert Vector.from_rec(v.to_rec()) == v
    m = MutableVector(vec([1, 2, 3]))
    m.swap(0, 2)
    m.write(1, 9)
    assert flat(m.vector) == [3, 9, 1] and m.read(0) == (3,) and flat(m.grow(2, 0).vector) == [3, 9, 1, 0, 0]
    n = m.clone()
    n.set(4)
    assert flat(n.vector) == [4, 4, 4] and flat(m.vector) == [3, 9, 1]


def test_either_and_generators(spark):
    from pyspark.sql.types import LongType, StringType

    row = spark.range(1).select(left(F.lit(1).cast("long"), StringType()).alias("l"), right(F.lit("a"), LongType()).alias("r")).first()
    assert row.l.is_left and row.l.left == 1 and not row.r.is_left and row.r.right == "a"
    person = datagen.record(datagen.int_between(1, 6), datagen.given_name)
    assert person.run(3) == person.run(3) and 1 <= person.run(3)[0] <= 6
    assert person.rows(spark, 5, 1, "i long, n string").collect() == person.rows(spark, 5, 1, "i long, n string").collect()
    assert spark.range(50).select(datagen.int_column(2, 3, 1).alias("v")).distinct().count() == 2
