import datetime
import itertools
import random

import pytest
from pyspark.sql.types import DateType, LongType, StringType

from codrel import and_, col_eq, not_, or_, table, val_eq
from codrel.operators.relation import Relation, dee, dum, from_rows

DAY = datetime.date.fromisoformat
PERSON = [("Drew", 1, 24), ("Alexa", 2, 14), ("Jordan", 3, 39), ("Mary", 4, 66), ("Arnold", 5, 14), ("Carlos", 6, 20), ("Juan", 7, 52)]
EMPLOYMENT = [
    ("2002-08-13", 1, 1004), ("2004-03-23", 2, 1001), ("2001-10-02", 2, 1005), ("1998-03-19", 3, 1004), ("2001-03-12", 4, 1004), ("2008-04-09", 4, 1001),
    ("2012-03-08", 4, 1005), ("2002-11-14", 6, 1003), ("2001-11-07", 7, 1001),
]
COMPANY = [("Dunder Mifflin", 1001), ("Spade and Archer", 1002), ("Monks Diner", 1003), ("Moes Tavern", 1004), ("The Krusty Krab", 1005)]


@pytest.fixture(scope="module")
def golden(spark):
    person = from_rows(spark, PERSON, [("person_name", StringType()), ("person_id", LongType()), ("person_age", LongType())], "person")
    employment = from_rows(spark, [(DAY(d), p, c) for d, p, c in EMPLOYMENT], [("start_date", DateType()), ("person_id", LongType()), ("company_id", LongType())], "employment")
    company = from_rows(spark, COMPANY, [("company_name", StringType()), ("company_id", LongType())], "company")
    return person, employment, company


def rows(relation: Relation) -> list[tuple]:
    return sorted(tuple(r) for r in relation.collect())


DREW = (DAY("2002-08-13"), "Drew", 1, 24, 1004)
CARLOS = (DAY("2002-11-14"), "Carlos", 6, 20, 1003)


def test_golden_cases(golden):
    person, employment, company = golden
    assert rows(person.restrict(val_eq("person_name", "Carlos"))) == [("Carlos", 6, 20)]
    assert rows(person.restrict(or_(val_eq("person_name", "Carlos"), val_eq("person_age", 14)))) == [("Alexa", 2, 14), ("Arnold", 5, 14), ("Carlos", 6, 20)]
    assert sorted(r[0] for r in rows(person.project(["person_age"]))) == [14, 20, 24, 39, 52, 66]
    assert person.restrict(val_eq("person_age", 105)).project([]).count() == 0
    assert person.restrict(val_eq("person_age", 14)).project([]).count() == 1
    two = or_(val_eq("person_id", 1), val_eq("person_id", 2))
    expected = sorted([DREW, (DAY("2004-03-23"), "Alexa", 2, 14, 1001), (DAY("2001-10-02"), "Alexa", 2, 14, 1005)])
    below = employment.natural_join(person.restrict(two))
    assert below.columns == ["start_date", "person_name", "person_id", "person_age", "company_id"]
    assert rows(below) == rows(employment.natural_join(person).restrict(two)) == expected
    both = employment.natural_join(person)
    assert rows(both.restrict(or_(val_eq("person_id", 1), val_eq("company_id", 1003)))) == [DREW, CARLOS]
    four = both.restrict(or_(val_eq("person_name", "Drew"), val_eq("start_date", DAY("2002-11-14"))))
    assert rows(four) == [DREW, CARLOS]
    five = company.natural_join(four).project(["company_name", "person_name"])
    assert rows(five) == [("Carlos", "Monks Diner"), ("Drew", "Moes Tavern")]
    assert rows(company.union(company)) == sorted(COMPANY)
    foo = person.project(["person_id"]).rename("person_id", "foo").union(company.project(["company_id"]).rename("company_id", "foo"))
    assert [r[0] for r in rows(foo)] == [1, 2, 3, 4, 5, 6, 7, 1001, 1002, 1003, 1004, 1005]


def test_relations_without_columns(spark, golden):
    one, none = dee(spark), dum(spark)
    truth = {"union": [1, 1, 1, 0], "intersection": [1, 0, 0, 0], "difference": [0, 1, 0, 0], "natural_join": [1, 0, 0, 0]}
    for name, expected in truth.items():
        assert [getattr(a, name)(b).count() for a, b in itertools.product((one, none), repeat=2)] == expected, name
    person = golden[0]
    assert person.natural_join(one).count() == 7 and person.natural_join(none).count() == 0
    assert [r.is_nonempty().first()[0] for r in (one, none)] == [True, False]


def test_absence_equals_absence(spark):
    a = table(spark.createDataFrame([(None, 1), (2, 2), (None, 1)], "k long, x long"))
    b = table(spark.createDataFrame([(None, 5), (3, 6)], "k long, y long"))
    assert a.count() == 2
    assert [tuple(r) for r in a.natural_join(b).collect()] == [(5, 1, None)]
    assert a.restrict(not_(val_eq("k", 2))).count() == 1
    assert a.restrict(val_eq("k", None)).count() == 1
    assert a.project(["k"]).intersection(b.project(["k"])).count() == 1


def test_errors(spark, golden):
    person, employment, company = golden
    with pytest.raises(TypeError):
        person.restrict(val_eq("person_age", "14"))
    with pytest.raises(KeyError):
        person.restrict(val_eq("age", 14))
    with pytest.raises(TypeError):
        person.union(company)
    with pytest.raises(ValueError):
        person.rename("person_age", "person_id")
    with pytest.raises(KeyError):
        person.rename("age", "years")
    with pytest.raises(KeyError):
        person.project(["age"])
    with pytest.raises(TypeError):
        person.natural_join(company.rename("company_name", "person_id"))
    with pytest.raises(TypeError):
        person.restrict(col_eq("person_name", "person_id"))
    with pytest.raises(TypeError):
        table(spark.sql("select map(1, 2) as m"))


def test_equijoin_keeps_both_keys_and_joins_shared_names(spark):
    a = table(spark.createDataFrame([(1, 10, 5), (2, 20, 6)], "a long, x long, s long"))
    b = table(spark.createDataFrame([(1, 5), (2, 7)], "b long, s long"))
    joined = a.equijoin("a", "b", b)
    assert joined.columns == ["x", "s", "b", "a"] and [tuple(r) for r in joined.collect()] == [(10, 5, 1, 1)]


def test_dotted_names_and_plan_text(spark):
    r = table(spark.createDataFrame([(1, 2), (1, 2)], "`t.a` long, `t.b` long"), "t")
    assert rows(r.restrict(val_eq("t.a", 1)).project(["t.b"]).rename("t.b", "c.d")) == [(2,)]
    text = r.restrict(val_eq("t.a", 1)).project(["t.b"]).describe()
    assert text.splitlines() == ["project t.b", "  restrict t.a = 1", "    table t"]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr("id as a", "id % 7 as b", "id % 3 as c").write.parquet(path)
    left = table(spark.read.parquet(path).select("a", "b"), key=["a"])
    right = table(spark.read.parquet(path).selectExpr("a", "c"), key=["a"])
    df = left.natural_join(right).restrict(val_eq("b", 3)).project(["a", "c"]).to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(b,3)" in plan and "CartesianProduct" not in plan


# -- random plans against an interpreter over Python sets ------------------------------


def interpret(plan, tables):
    """(columns, set of frozenset of (name, value))."""
    op = plan[0]
    if op == "table":
        names, data = tables[plan[1]]
        return frozenset(names), {frozenset(zip(names, r, strict=True)) for r in data}
    if op == "project":
        names, data = interpret(plan[2], tables)
        return frozenset(plan[1]), {frozenset((k, v) for k, v in r if k in plan[1]) for r in data}
    if op == "restrict":
        names, data = interpret(plan[2], tables)
        return names, {r for r in data if holds(plan[1], dict(r))}
    if op == "rename":
        (old, new), (names, data) = plan[1], interpret(plan[2], tables)
        swap = lambda k: new if k == old else k
        return frozenset(map(swap, names)), {frozenset((swap(k), v) for k, v in r) for r in data}
    (an, a), (bn, b) = interpret(plan[1], tables), interpret(plan[2], tables)
    if op == "join":
        return an | bn, {x | y for x in a for y in b if all(dict(x)[k] == dict(y)[k] for k in an & bn)}
    return an, {"union": a | b, "intersection": a & b, "difference": a - b}[op]


def holds(p, r):
    if p[0] == "val":
        return r[p[1]] == p[2]
    if p[0] == "col":
        return r[p[1]] == r[p[2]]
    if p[0] == "not":
        return not holds(p[1], r)
    return (all if p[0] == "and" else any)(holds(q, r) for q in p[1:])


def build(plan, tables):
    op = plan[0]
    if op == "table":
        return tables[plan[1]]
    if op in ("project", "restrict", "rename"):
        below = build(plan[2], tables)
        return below.project(plan[1]) if op == "project" else below.restrict(predicate(plan[1])) if op == "restrict" else below.rename(*plan[1])
    a, b = build(plan[1], tables), build(plan[2], tables)
    return {"join": a.natural_join, "union": a.union, "intersection": a.intersection, "difference": a.difference}[op](b)


def predicate(p):
    if p[0] == "val":
        return val_eq(p[1], p[2])
    if p[0] == "col":
        return col_eq(p[1], p[2])
    if p[0] == "not":
        return not_(predicate(p[1]))
    return (and_ if p[0] == "and" else or_)(*map(predicate, p[1:]))


def grow(g, depth, tables):
    """A random plan and its column names."""
    if depth == 0:
        name = g.choice(sorted(tables))
        return ("table", name), set(tables[name][0])
    kind = g.choice(["project", "restrict", "rename", "join", "union", "intersection", "difference"])
    plan, names = grow(g, depth - 1, tables)
    ordered = sorted(names)
    if kind == "project":
        keep = [n for n in ordered if g.random() < 0.6]
        return ("project", keep, plan), set(keep)
    if kind == "restrict":
        if not ordered:
            return plan, names
        leaf = lambda: ("col", g.choice(ordered), g.choice(ordered)) if g.random() < 0.3 else ("val", g.choice(ordered), g.choice([0, 1, 2, None]))
        p = leaf()
        for _ in range(g.randrange(3)):
            p = g.choice([("not", p), ("and", p, leaf()), ("or", p, leaf())])
        return ("restrict", p, plan), names
    if kind == "rename":
        free = [n for n in "abcdef" if n not in names]
        if not ordered or not free:
            return plan, names
        old, new = g.choice(ordered), g.choice(free)
        return ("rename", (old, new), plan), (names - {old}) | {new}
    if kind == "join":
        other, more = grow(g, depth - 1, tables)
        return ("join", plan, other), names | more
    p = ("val", ordered[0], 1) if ordered else None
    other = ("restrict", ("not", p), plan) if p else plan
    return (kind, plan, other) if g.random() < 0.5 else (kind, other, plan), names


def test_random_plans(spark):
    g = random.Random(5)
    value = lambda: g.choice([0, 1, 2, None])
    tables = {"t": (list("ab"), [(value(), value()) for _ in range(6)]), "u": (list("bc"), [(value(), value()) for _ in range(6)]), "v": (list("d"), [(value(),) for _ in range(3)])}
    made = {k: table(spark.createDataFrame(data, ", ".join(f"{n} long" for n in names)), k) for k, (names, data) in tables.items()}
    for _ in range(25):
        plan, _names = grow(g, 3, tables)
        names, expected = interpret(plan, tables)
        got = build(plan, made)
        assert got.columns == sorted(names, reverse=True), plan
        found = [frozenset(r.asDict().items()) for r in got.collect()]
        assert len(found) == len(set(found)) and set(found) == expected, plan
