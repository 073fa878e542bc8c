"""Queries that run every operator of the vectors and kernels, several of a kind in one table (op, pos, value), with SQL for the same rows.

Importing this module adds them to the catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .functions import fixed
from .functions.predicate import and_, col_eq, not_, or_, val_eq
from .operators import kernels
from .operators.relation import from_rows, table
from .operators.vector import MutableVector, Vector
from .queries import query
from .sources import datagen
from .sources.tables import read, relation

_V = (
    "WITH v AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS r, row_number() OVER (ORDER BY n_nationkey)-1 AS p, "
    "(SELECT count(*) FROM nation) AS n FROM nation) "
)


def _nations(s: SparkSession, d: str) -> Vector:
    df = read(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("r"))
    return Vector.from_df(df, "k")


def _numbers(s: SparkSession, d: str) -> Vector:
    return _nations(s, d).map(F.col("r").alias("value"))


def _facts(s: SparkSession, facts: dict) -> DataFrame:
    """One row (op, value) for each result that is a value."""
    rows = [(op, None if v is None else str(v).lower() if isinstance(v, bool) else str(v)) for op, v in facts.items()]
    return s.createDataFrame(rows, "op string, value string")


def _tagged(vectors: dict[str, Vector], value: str = "value") -> DataFrame:
    """op, pos, value of all records of the vectors."""
    parts = [v.to_df("pos").select(F.lit(op).alias("op"), "pos", F.col(f"`{value}`").cast("long").alias("value")) for op, v in vectors.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _each(ops: str, select: str) -> str:
    return " UNION ALL ".join(f"SELECT '{op}' AS op, {select}" for op in ops.split())


def _values(**facts: str) -> str:
    return " UNION ALL ".join(f"SELECT '{op}' AS op, CAST(({expression}) AS VARCHAR) AS value" for op, expression in facts.items())


def _rows(**parts: str) -> str:
    return " UNION ALL ".join(f"SELECT '{op}' AS op, CAST(pos AS BIGINT) AS pos, CAST(value AS BIGINT) AS value FROM ({sql})" for op, sql in parts.items())


# -- B1: length and elements -------------------------------------------------------------------

_FIRST, _LAST = "SELECT name FROM v WHERE p=0", "SELECT name FROM v WHERE p=n-1"
_AT = "SELECT name FROM v WHERE p=3"


@query(
    _V
    + _values(length="SELECT count(*) FROM v", null="SELECT count(*)=0 FROM v", get=_AT, get_outside="SELECT name FROM v WHERE p=n", **{o: _AT for o in ("index", "unsafe_index", "index_m", "unsafe_index_m")})
    + " UNION ALL "
    + _values(**{o: _FIRST for o in ("head", "unsafe_head", "head_m", "unsafe_head_m")}, **{o: _LAST for o in ("last", "unsafe_last", "last_m", "unsafe_last_m")})
)
def vec_elements(s, d):
    v = _nations(s, d)
    facts = {"length": v.length(), "null": v.null(), "get": v.get(3)[1], "get_outside": v.get(v.length())}
    facts |= {op: getattr(v, op)(3)[1] for op in ("index", "unsafe_index", "index_m", "unsafe_index_m")}
    facts |= {op: getattr(v, op)()[1] for op in "head unsafe_head head_m unsafe_head_m last unsafe_last last_m unsafe_last_m".split()}
    return _facts(s, facts)


# -- B2: slices ------------------------------------------------------------------------------------

_SLICES = {
    "slice": "SELECT p-2 AS pos, k AS value FROM v WHERE p BETWEEN 2 AND 4",
    "init": "SELECT p AS pos, k AS value FROM v WHERE p<n-1",
    "tail": "SELECT p-1 AS pos, k AS value FROM v WHERE p>0",
    "take": "SELECT p AS pos, k AS value FROM v WHERE p<4",
    "drop": "SELECT p-20 AS pos, k AS value FROM v WHERE p>=20",
}


@query(
    _V
    + _rows(**_SLICES, **{f"unsafe_{op}": sql for op, sql in _SLICES.items()}, split_at_a="SELECT p AS pos, k AS value FROM v WHERE p<9", split_at_b="SELECT p-9 AS pos, k AS value FROM v WHERE p>=9")
)
def vec_slices(s, d):
    v = _nations(s, d)
    arguments = {"slice": (2, 3), "init": (), "tail": (), "take": (4,), "drop": (20,)}
    parts = {f"{kind}{op}": getattr(v, f"{kind}{op}")(*a) for kind in ("", "unsafe_") for op, a in arguments.items()}
    parts["split_at_a"], parts["split_at_b"] = v.split_at(9)
    return _tagged(parts, "k")


# -- B3: construction ---------------------------------------------------------------------------------


@query(
    _V
    + _rows(
        singleton="SELECT 0 AS pos, 7 AS value",
        replicate="SELECT range AS pos, 7 AS value FROM range(5)",
        generate="SELECT range AS pos, range*range AS value FROM range(6)",
        iterate_n="SELECT range AS pos, CAST(3*2**range AS BIGINT) AS value FROM range(6)",
        replicate_m="SELECT range AS pos, range+1 AS value FROM range(4)",
        generate_m="SELECT range AS pos, 10-range AS value FROM range(4)",
        create="SELECT range AS pos, 2*range AS value FROM range(3)",
        unfoldr="SELECT range AS pos, 10-range AS value FROM range(10)",
        unfoldr_n="SELECT range AS pos, 10-range AS value FROM range(4)",
        construct_n="SELECT range AS pos, CAST(2**range AS BIGINT) AS value FROM range(5)",
        constructr_n="SELECT range AS pos, CAST(2**(4-range) AS BIGINT) AS value FROM range(5)",
    )
)
def vec_construction(s, d):
    kind, count = "value long", iter(range(1, 99))
    down = lambda n: (n, n - 1) if n > 0 else None
    parts = {
        "empty": Vector.empty(s, kind),
        "singleton": Vector.singleton(s, 7, kind),
        "replicate": Vector.replicate(s, 5, 7, kind),
        "generate": Vector.generate(s, 6, lambda i: (i * i).alias("value")),
        "iterate_n": Vector.iterate_n(s, 6, lambda x: x * 2, 3),
        "replicate_m": Vector.replicate_m(s, 4, lambda: next(count), kind),
        "generate_m": Vector.generate_m(s, 4, lambda i: 10 - i, kind),
        "create": Vector.create(s, lambda: [0, 2, 4], kind),
        "unfoldr": Vector.unfoldr(s, down, 10, kind),
        "unfoldr_n": Vector.unfoldr_n(s, 4, down, 10, kind),
        "construct_n": Vector.construct_n(s, 5, lambda so_far: sum(so_far) + 1, kind),
        "constructr_n": Vector.constructr_n(s, 5, lambda so_far: sum(so_far) + 1, kind),
    }
    return _tagged(parts)


_ALL = "SELECT p AS pos, r AS value FROM v"
_TWICE = _ALL + " UNION ALL SELECT p+n, r FROM v"


@query(
    _V
    + _rows(
        cons="SELECT p+1 AS pos, r AS value FROM v UNION ALL SELECT 0, 99",
        snoc=_ALL + " UNION ALL SELECT count(*), 99 FROM v",
        append=_TWICE,
        concat=_TWICE + " UNION ALL SELECT p+2*n, r FROM v",
        force=_ALL,
    )
)
def vec_joining(s, d):
    v = _numbers(s, d)
    return _tagged({"cons": v.cons((99,)), "snoc": v.snoc((99,)), "append": v.append(v), "concat": Vector.concat([v, v, v]), "force": v.force()})


# -- B4: updates and permutations -----------------------------------------------------------------------

_UPDATED = "SELECT p AS pos, CASE p WHEN 2 THEN 70 WHEN 5 THEN 91 ELSE r END AS value FROM v"
_FOLDED = "SELECT p AS pos, CASE p WHEN 2 THEN (r*10+4)*10+5 WHEN 3 THEN r*10+6 ELSE r END AS value FROM v"


@query(
    _V
    + _rows(
        update=_UPDATED, unsafe_upd=_UPDATED, accum=_FOLDED, unsafe_accum=_FOLDED, accum_named="SELECT p AS pos, CASE p WHEN 2 THEN r+9 WHEN 3 THEN r+6 ELSE r END AS value FROM v",
        reverse="SELECT n-1-p AS pos, r AS value FROM v", modify="SELECT n-1-p AS pos, r AS value FROM v",
    )
)
def vec_updates(s, d):
    v, changes, folds = _numbers(s, d), [(5, (90,)), (2, (70,)), (5, (91,))], [(2, 4), (3, 6), (2, 5)]
    grown = lambda a, c: a * 10 + c
    return _tagged(
        {
            "update": v.update(changes), "unsafe_upd": v.unsafe_upd(changes), "accum": v.accum("value", grown, folds), "unsafe_accum": v.unsafe_accum("value", grown, folds),
            "accum_named": v.accum("value", "sum", folds), "reverse": v.reverse(), "modify": v.modify(Vector.reverse),
        }
    )


# -- B5: maps and zips ------------------------------------------------------------------------------------

_DOUBLE, _PLUS = "SELECT p AS pos, 2*r AS value FROM v", "SELECT p AS pos, r+k AS value FROM v"


@query(
    _V
    + _rows(
        map=_DOUBLE, map_m=_DOUBLE, for_m=_DOUBLE, imap="SELECT p AS pos, r*100+p AS value FROM v", zip_with=_PLUS, zip_with_m=_PLUS,
        concat_map="SELECT row_number() OVER (ORDER BY p, i)-1 AS pos, i AS value FROM (SELECT p, unnest(range(0, r)) AS i FROM v)",
        map_m_="SELECT 0 AS pos, sum(r) AS value FROM v", for_m_="SELECT 0 AS pos, sum(r) AS value FROM v", zip_with_m_="SELECT 0 AS pos, sum(r*k) AS value FROM v",
    )
)
def vec_maps(s, d):
    v, other = _numbers(s, d), _nations(s, d).map(F.col("k").alias("other"))
    i = F.col("value")
    parts = {
        "map": v.map((i * 2).alias("value")), "map_m": v.map_m(lambda row: row[0] * 2, "value long"), "for_m": v.for_m(lambda row: row[0] * 2, "value long"),
        "imap": v.imap(lambda p: [(i * 100 + p).alias("value")]), "zip_with": v.zip_with(other, (i + F.col("other")).alias("value")), "zip_with_m": v.zip_with_m(other, lambda a, b: a[0] + b[0], "value long"),
        "concat_map": v.concat_map(F.when(i > 0, F.sequence(F.lit(0).cast("long"), i - 1))),
    }
    totals = {}
    for op in ("map_m_", "for_m_"):
        seen = s.sparkContext.accumulator(0)
        getattr(v, op)(lambda row, seen=seen: seen.add(row[0]))
        totals[op] = seen.value
    seen = s.sparkContext.accumulator(0)
    v.zip_with_m_(other, lambda a, b: seen.add(a[0] * b[0]))
    totals["zip_with_m_"] = seen.value
    return _tagged(parts | {op: Vector.singleton(s, total, "value long") for op, total in totals.items()})


# -- B6: filters ---------------------------------------------------------------------------------------------


def _kept(condition: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY p)-1 AS pos, k AS value FROM v WHERE {condition}"


_UPTO = "p < (SELECT coalesce(min(p), 99999) FROM v WHERE r>=3)"


@query(
    _V
    + _rows(
        filter=_kept("r<2"), filter_m=_kept("r<2"), ifilter=_kept("p%3=0"), take_while=_kept(_UPTO), drop_while=_kept(f"NOT {_UPTO}"), span_a=_kept(_UPTO), span_b=_kept(f"NOT {_UPTO}"), break_a=_kept(_UPTO), break_b=_kept(f"NOT {_UPTO}"),
        partition_a=_kept("r<2"), partition_b=_kept("r>=2"), unstable_partition_a=_kept("r<2"), unstable_partition_b=_kept("r>=2"),
    )
)
def vec_filters(s, d):
    v, low = _nations(s, d), F.col("r") < 2
    parts = {
        "filter": v.filter(low), "filter_m": v.filter_m(lambda row: row[2] < 2), "ifilter": v.ifilter(lambda p: p % 3 == 0),
        "take_while": v.take_while(F.col("r") < 3), "drop_while": v.drop_while(F.col("r") < 3),
    }
    for op, pair in {"span": v.span(F.col("r") < 3), "break": v.break_(F.col("r") >= 3), "partition": v.partition(low), "unstable_partition": v.unstable_partition(low)}.items():
        parts[f"{op}_a"], parts[f"{op}_b"] = pair
    return _tagged(parts, "k")


# -- B7: searches ----------------------------------------------------------------------------------------------


@query(
    _V
    + _values(
        elem="true", elem_absent="false", not_elem="true", find="SELECT name FROM v WHERE r=3 ORDER BY p LIMIT 1", find_absent="NULL", find_index="SELECT min(p) FROM v WHERE r=3", elem_index="SELECT min(p) FROM v WHERE r=4",
        elem_index_absent="NULL",
    )
)
def vec_searches(s, d):
    v, numbers = _nations(s, d), _numbers(s, d)
    return _facts(
        s,
        {
            "elem": numbers.elem(4), "elem_absent": numbers.elem(77), "not_elem": numbers.not_elem(77), "find": v.find(F.col("r") == 3)[1], "find_absent": v.find(F.col("r") == 77),
            "find_index": v.find_index(F.col("r") == 3), "elem_index": numbers.elem_index(4), "elem_index_absent": numbers.elem_index(77),
        },
    )


# -- B8: folds --------------------------------------------------------------------------------------------------

_LEFT, _RIGHT = "SELECT string_agg(r, '' ORDER BY p) FROM v", "SELECT string_agg(r, '' ORDER BY p DESC) FROM v"
_I_LEFT, _I_RIGHT = "SELECT string_agg(p || ':' || r, ',' ORDER BY p) || ',' FROM v", "SELECT string_agg(p || ':' || r, ',' ORDER BY p DESC) || ',' FROM v"
_FOLDS = {
    **{op: _LEFT for op in "foldl foldl_strict foldl1 foldl1_strict fold_m fold_m_strict fold1_m fold1_m_strict".split()},
    **{op: _RIGHT for op in "foldr foldr_strict foldr1 foldr1_strict".split()},
    **{op: "SELECT sum(r) FROM v" for op in "fold_m_ fold_m_strict_".split()},
    **{op: "SELECT sum(r) FROM v WHERE p>0" for op in "fold1_m_ fold1_m_strict_".split()},
    "ifoldl": _I_LEFT, "ifoldl_strict": _I_LEFT, "ifoldr": _I_RIGHT, "ifoldr_strict": _I_RIGHT,
    "all": "SELECT bool_and(r<5) FROM v", "all_not": "SELECT bool_and(r<4) FROM v", "any": "SELECT bool_or(r=4) FROM v", "any_not": "SELECT bool_or(r=5) FROM v",
    "maximum": "SELECT name FROM v ORDER BY k DESC LIMIT 1", "minimum": "SELECT name FROM v ORDER BY k LIMIT 1",
    "maximum_by": "SELECT name FROM v ORDER BY r DESC, p LIMIT 1", "minimum_by": "SELECT name FROM v ORDER BY r, p LIMIT 1",
    "max_index": "SELECT p FROM v ORDER BY k DESC LIMIT 1", "min_index": "SELECT p FROM v ORDER BY k LIMIT 1",
    "max_index_by": "SELECT p FROM v ORDER BY r DESC, p LIMIT 1", "min_index_by": "SELECT p FROM v ORDER BY r, p LIMIT 1",
}


@query(_V + _values(**_FOLDS))
def vec_folds(s, d):
    v, text = _nations(s, d), _nations(s, d).map(F.col("r").cast("string").alias("value"))
    i, facts = F.col("r"), {}
    for kind in ("", "_strict"):
        facts[f"foldl{kind}"] = getattr(text, f"foldl{kind}")(lambda a, x: F.concat(a, x["value"]), F.lit(""))
        facts[f"foldr{kind}"] = getattr(text, f"foldr{kind}")(lambda x, a: F.concat(a, x["value"]), F.lit(""))
        join = lambda a, x: F.struct(a["_pos"].alias("_pos"), F.concat(a["value"], x["value"]).alias("value"))
        facts[f"foldl1{kind}"] = getattr(text, f"foldl1{kind}")(join)["value"]
        facts[f"foldr1{kind}"] = getattr(text, f"foldr1{kind}")(lambda x, a: join(a, x))["value"]
        facts[f"fold_m{kind}"] = getattr(text, f"fold_m{kind}")(lambda a, row: a + row[0], "")
        facts[f"fold1_m{kind}"] = "".join(getattr(text, f"fold1_m{kind}")(lambda a, row: (a[0] + row[0],)))
        said = lambda p, x: F.concat(p.cast("string"), F.lit(":"), x["value"], F.lit(","))
        facts[f"ifoldl{kind}"] = getattr(text, f"ifoldl{kind}")(lambda a, p, x: F.concat(a, said(p, x)), F.lit(""))
        facts[f"ifoldr{kind}"] = getattr(text, f"ifoldr{kind}")(lambda p, x, a: F.concat(a, said(p, x)), F.lit(""))
    for op in ("fold_m_", "fold_m_strict_", "fold1_m_", "fold1_m_strict_"):
        seen: list[int] = []
        getattr(text, op)(lambda a, row, seen=seen: seen.append(int(row[0])) or a, *([None] if op.startswith("fold_m") else []))
        facts[op] = sum(seen)
    facts |= {"all": v.all(i < 5), "all_not": v.all(i < 4), "any": v.any(i == 4), "any_not": v.any(i == 5), "maximum": v.maximum()[1], "minimum": v.minimum()[1]}
    facts |= {"maximum_by": v.maximum_by(i)[1], "minimum_by": v.minimum_by(i)[1], "max_index": v.max_index(), "min_index": v.min_index(), "max_index_by": v.max_index_by(i), "min_index_by": v.min_index_by(i)}
    return _facts(s, facts)


# -- B9: scans ------------------------------------------------------------------------------------------------------


def _scan_sql(order: str, frame: str, zero: int, start: str = "") -> str:
    sql = f"SELECT p AS pos, {zero}+coalesce(sum(r) OVER (ORDER BY p {order} ROWS BETWEEN UNBOUNDED PRECEDING AND {frame}), 0) AS value FROM v"
    return {"": sql, "first": f"SELECT pos+1 AS pos, value FROM ({sql}) UNION ALL SELECT 0, {zero}", "last": f"{sql} UNION ALL SELECT count(*), {zero} FROM v"}[start]


_SCANS = {
    "prescanl": _scan_sql("", "1 PRECEDING", 5), "postscanl": _scan_sql("", "CURRENT ROW", 5), "scanl": _scan_sql("", "CURRENT ROW", 5, "first"), "scanl1": _scan_sql("", "CURRENT ROW", 0),
    "prescanr": _scan_sql("DESC", "1 PRECEDING", 5), "postscanr": _scan_sql("DESC", "CURRENT ROW", 5), "scanr": _scan_sql("DESC", "CURRENT ROW", 5, "last"), "scanr1": _scan_sql("DESC", "CURRENT ROW", 0),
}


@query(_V + _rows(**_SCANS, **{f"{op}_strict": sql for op, sql in _SCANS.items()}, **{f"{op}_function": sql for op, sql in _SCANS.items()}))
def vec_scans(s, d):
    v, i = _numbers(s, d), F.col("value")
    parts = {}
    for op in _SCANS:
        zero = () if op.endswith("1") else (5,)
        parts[op] = getattr(v, op)("sum", i, *zero)
        parts[f"{op}_strict"] = getattr(v, f"{op}_strict")("sum", i, *zero)
        parts[f"{op}_function"] = getattr(v, op)(lambda a, b: a + b, i, *zero)
    return _tagged(parts)


# -- B10: conversions, B12: mutable vectors -----------------------------------------------------------------------------


@query(
    _V
    + _rows(
        **{op: _ALL for op in "to_list from_list freeze thaw copy unsafe_freeze unsafe_thaw unsafe_copy from_rec".split()}, from_list_n="SELECT p AS pos, r AS value FROM v WHERE p<7",
        to_rec_k="SELECT p AS pos, k AS value FROM v", to_rec_r=_ALL,
    )
)
def vec_conversions(s, d):
    v = _numbers(s, d)
    rows = v.to_list()
    columns = _nations(s, d).map(F.col("k"), F.col("r")).to_rec()
    parts = {"to_list": Vector.from_list(s, rows, "value long"), "from_list": Vector.from_list(s, [r for (r,) in rows], "value long"), "from_list_n": Vector.from_list_n(s, 7, rows, "value long")}
    parts |= {op: getattr(v, op)() for op in "freeze thaw copy unsafe_freeze unsafe_thaw unsafe_copy".split()}
    parts |= {"to_rec_k": columns["k"].map(F.col("k").alias("value")), "to_rec_r": columns["r"].map(F.col("r").alias("value"))}
    parts["from_rec"] = Vector.from_rec(columns).map(F.col("r").alias("value"))
    return _tagged(parts)


_WRITTEN = "SELECT p AS pos, CASE p WHEN 1 THEN 50 ELSE r END AS value FROM v"
_SWAPPED = "SELECT CASE p WHEN 0 THEN 4 WHEN 4 THEN 0 ELSE p END AS pos, r AS value FROM v"


@query(
    _V
    + _rows(
        new="SELECT range AS pos, 8 AS value FROM range(3)", replicate="SELECT range AS pos, 8 AS value FROM range(3)", replicate_m="SELECT range AS pos, range AS value FROM range(3)", clone=_ALL, write=_WRITTEN, unsafe_write=_WRITTEN,
        swap=_SWAPPED, unsafe_swap=_SWAPPED, set="SELECT p AS pos, 6 AS value FROM v", copy=_ALL, move=_ALL, grow=_ALL + " UNION ALL SELECT n+range, 0 FROM range(2), (SELECT count(*) AS n FROM v)",
        **{op: sql.replace("k AS value", "r AS value") for op, sql in _SLICES.items()}, **{f"unsafe_{op}": sql.replace("k AS value", "r AS value") for op, sql in _SLICES.items()},
        read="SELECT 0 AS pos, r AS value FROM v WHERE p=3", unsafe_read="SELECT 0 AS pos, r AS value FROM v WHERE p=3", length="SELECT 0 AS pos, count(*) AS value FROM v", null="SELECT 0 AS pos, 0 AS value",
        overlaps="SELECT 0 AS pos, 1 AS value", overlaps_not="SELECT 0 AS pos, 0 AS value", clear=_ALL,
    )
)
def vec_mutable(s, d):
    v, kind, count = _numbers(s, d), "value long", iter(range(9))
    fresh = lambda: MutableVector(v)
    one = lambda x: Vector.singleton(s, int(x), kind)
    parts = {"new": MutableVector.new(s, 3, 8, kind).vector, "replicate": MutableVector.replicate(s, 3, 8, kind).vector, "replicate_m": MutableVector.replicate_m(s, 3, lambda: next(count), kind).vector, "clone": fresh().clone().vector}
    for op in ("write", "unsafe_write"):
        m = fresh()
        getattr(m, op)(1, (50,))
        parts[op] = m.vector
    for op in ("swap", "unsafe_swap"):
        m = fresh()
        getattr(m, op)(0, 4)
        parts[op] = m.vector
    filled, into, moved, cleared = fresh(), fresh(), fresh(), fresh()
    filled.set((6,))
    into.set((6,))
    into.copy(fresh())
    moved.move(fresh())
    cleared.clear()
    parts |= {"set": filled.vector, "copy": into.vector, "move": moved.vector, "clear": cleared.vector, "grow": fresh().grow(2, (0,)).vector}
    arguments = {"slice": (2, 3), "init": (), "tail": (), "take": (4,), "drop": (20,)}
    parts |= {f"{k}{op}": getattr(fresh(), f"{k}{op}")(*a).vector for k in ("", "unsafe_") for op, a in arguments.items()}
    m = fresh()
    parts |= {"read": one(m.read(3)[0]), "unsafe_read": one(m.unsafe_read(3)[0]), "length": one(m.length()), "null": one(m.null()), "overlaps": one(m.overlaps(m.clone())), "overlaps_not": one(m.overlaps(filled))}
    return _tagged(parts)


# -- C: kernels -----------------------------------------------------------------------------------------------------------

_JOINED = "SELECT a.i AS left_pos, b.i AS right_pos FROM (SELECT c_nationkey AS x, c_mktsegment AS y, row_number() OVER (ORDER BY c_custkey)-1 AS i FROM customer) a JOIN (SELECT c_nationkey AS x, c_mktsegment AS y, row_number() OVER (ORDER BY c_custkey)-1 AS i FROM customer WHERE c_custkey%50=0) b USING (x, y)"


@query(_JOINED)
def join_indices_multi_key(s, d):
    c = read(s, d, "customer")
    a = Vector.from_df(c.select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    b = Vector.from_df(c.filter("c_custkey % 50 = 0").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_custkey")
    return kernels.join_indices(a, b, [("c_nationkey", "c_nationkey"), ("c_mktsegment", "c_mktsegment")])


@query(_V + "SELECT op, a.p AS left_pos, b.p AS right_pos FROM v a JOIN v b ON a.r=b.r, (SELECT unnest(['merge', 'naive']) AS op)")
def join_indices_merge_and_naive(s, d):
    v = _numbers(s, d)
    keyed = v.to_df("pos").select("pos", F.col("value").alias("key"))
    merged = kernels.matching_indices(keyed, keyed).select(F.lit("merge").alias("op"), F.col("left").alias("left_pos"), F.col("right").alias("right_pos"))
    rows = v.to_list()
    naive = s.createDataFrame([("naive", i, j) for i, j in kernels.join_indices_naive(rows, rows)], merged.schema)
    return merged.unionByName(naive)


_UNIQ = "SELECT row_number() OVER (ORDER BY event_id)-1 AS pos, user_id, event_type FROM (SELECT *, lag({0}) OVER (ORDER BY event_id) AS b, row_number() OVER (ORDER BY event_id) AS i FROM events) WHERE i=1 OR b IS DISTINCT FROM {0}"


@query(_UNIQ.format("event_type"))
def uniq_by_column(s, d):
    v = Vector.from_df(read(s, d, "events").select("event_id", "user_id", "event_type"), "event_id")
    return kernels.uniq(v, "event_type").map(F.col("user_id"), F.col("event_type")).to_df("pos")


@query(
    "SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey)-1 AS pos, o_orderpriority, o_orderstatus FROM (SELECT *, lag(o_orderpriority || o_orderstatus) OVER (ORDER BY o_custkey, o_orderkey) AS b FROM orders) WHERE b IS DISTINCT FROM o_orderpriority || o_orderstatus"
)
def uniq_records(s, d):
    v = Vector.from_df(read(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"), "o_custkey", "o_orderkey")
    return v.map(F.col("o_orderpriority"), F.col("o_orderstatus")).uniq().to_df("pos")


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def remove_duplicates(s, d):
    return kernels.remove_duplicates(read(s, d, "orders").select("o_orderpriority", "o_orderstatus"))


@query(
    "SELECT row_number() OVER (ORDER BY c_mktsegment, c_nationkey, c_custkey)-1 AS pos, c_mktsegment, c_nationkey, index FROM (SELECT *, row_number() OVER (ORDER BY c_custkey)-1 AS index FROM customer)"
)
def sort_with_indices(s, d):
    v = Vector.from_df(read(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey").map(F.col("c_mktsegment"), F.col("c_nationkey"))
    return kernels.sort_with_indices(v).to_df("pos")


@query(_V + "SELECT w.p AS pos, v.r>=2 AS mask FROM v JOIN (SELECT p, 24-p AS i FROM v) w ON v.p=w.i")
def gather_mask(s, d):
    v = _numbers(s, d)
    indices = v.imap(lambda p: [(F.lit(24) - p).alias("i")])
    return kernels.index_many_predicate(F.col("value") >= 2, indices, v).to_df("pos")


@query(
    _V
    + "SELECT k AS key, name, 'key: ' || k || ', name: ' || name AS shown, 7 AS seven, 'seven' AS word FROM v"
)
def dynamic_records(s, d):
    """A frame of names known at run time as a static record, shown, beside a constant record."""
    schema = StructType([StructField("key", LongType()), StructField("name", StringType())])
    named = kernels.zip_names(_nations(s, d).to_df().select("k", "name"), ["key", "name"])
    made = kernels.to_record(named, schema)
    constant = kernels.constant_record(StructType([StructField("seven", LongType()), StructField("word", StringType())]), lambda kind: 7 if isinstance(kind, LongType) else "seven")
    return made.select("key", "name", kernels.show_record("key", "name").alias("shown"), *(c.cast("int") if n == "seven" else c for n, c in constant.items()))


@query(_values(same="true", other_type="false", other_name="false", copies="'x,x,x'", applied="'2,4,6'", to_list="'1,2'", empty="'[]'", non_empty="'1|2,3'"))
def types_and_fixed_vectors(s, d):
    n, r = read(s, d, "nation"), read(s, d, "region")
    said = lambda values: ",".join(map(str, values))
    first, rest = fixed.to_non_empty(fixed.from_list([1, 2, 3]))
    return _facts(
        s,
        {
            "same": kernels.same_type(n, n.limit(1)), "other_type": kernels.same_type(n, n.select("n_nationkey", "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))), "other_name": kernels.same_type(n, r),
            "copies": said(fixed.copies(3, "x")), "applied": said(fixed.apply(fixed.copies(3, lambda x: 2 * x), (1, 2, 3))), "to_list": said(fixed.to_list(fixed.from_list([1, 2]))), "empty": fixed.to_list(fixed.from_list([])),
            "non_empty": f"{first}|{said(rest)}",
        },
    )


@query("SELECT 200 AS n, true AS in_range, true AS in_domain, true AS repeats, true AS left_identity, true AS right_identity, true AS associative, 100 AS given_names, 123 AS companies, 85 AS house_styles, true AS records_fit")
def random_records(s, d):
    """Drawn records lie in their domains, equal seeds draw equal records, and drawing obeys the monad laws."""
    person = datagen.record(datagen.given_name, datagen.int_between(18, 90), datagen.company, datagen.house_style)
    df = person.rows(s, 200, 5, "name string, age long, company string, style string")
    again = person.rows(s, 200, 5, "name string, age long, company string, style string")
    older, twice = (lambda a: datagen.int_between(a, a + 5)), (lambda a: datagen.constant(2 * a))
    age = datagen.int_between(0, 9)
    laws = [
        all(datagen.constant(3).then(older).run(i) == older(3).run(i) for i in range(20)),
        all(age.then(datagen.constant).run(i) == age.run(i) for i in range(20)),
        all(age.then(older).then(twice).run(i) == age.then(lambda a: older(a).then(twice)).run(i) for i in range(20)),
    ]
    schema = StructType([StructField("a", LongType()), StructField("b", StringType())])
    fits = datagen.arbitrary(schema).rows(s, 50, 3, schema).count() == 50
    checked = df.agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.bool_and(F.col("age").between(18, 90)).alias("in_range"),
        F.bool_and(F.col("name").isin(*datagen.GIVEN_NAMES) & F.col("company").isin(*datagen.COMPANIES) & F.col("style").isin(*datagen.HOUSE_STYLES)).alias("in_domain"),
    )
    more: dict[str, Column] = {"repeats": F.lit(df.exceptAll(again).isEmpty()), "left_identity": F.lit(laws[0]), "right_identity": F.lit(laws[1]), "associative": F.lit(laws[2])}
    more |= {"given_names": F.lit(len(set(datagen.GIVEN_NAMES))), "companies": F.lit(len(set(datagen.COMPANIES))), "house_styles": F.lit(len(set(datagen.HOUSE_STYLES))), "records_fit": F.lit(fits)}
    return checked.select("*", *(c.alias(n) for n, c in more.items()))


# -- A: schemas, plans, results ----------------------------------------------------------------------------------------------


@query(
    _values(
        columns="'o_orderstatus,o_orderkey,c_name'", types="'string,bigint,string'", key_type="'bigint'", ordered="true", contains="true", left_over="'c_name'", shared="'o_orderkey'",
        plan="'project o_orderkey, o_orderstatus, c_name|  equijoin on o_custkey = c_custkey|    rename o_total to o_totalprice|      table orders|    table customer'", count="SELECT count(*) FROM orders JOIN customer ON o_custkey=c_custkey", loaded="2", names="'a,b'",
    )
)
def schemas_and_plans(s, d):
    o = table(read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("o_total")), "orders", ["o_orderkey"])
    joined = o.rename("o_total", "o_totalprice").equijoin("o_custkey", "c_custkey", relation(s, d, "customer", ["c_custkey", "c_name"], ["c_custkey"]))
    p = joined.project(["o_orderkey", "o_orderstatus", "c_name"])
    own = p.schema
    loaded = from_rows(s, [(1, "x"), (2, "y"), (2, "y")], [("a", LongType()), ("b", StringType())])
    return _facts(
        s,
        {
            "columns": ",".join(p.columns), "types": ",".join(k.simpleString() for _, k in own), "key_type": own["o_orderkey"].simpleString(), "ordered": list(own.names) == sorted(own.names, reverse=True),
            "contains": joined.schema.contains(own), "left_over": ",".join(own.subtract(o.schema).names), "shared": ",".join(own.intersect(o.project(["o_orderkey"]).schema).names),
            "plan": p.describe().replace("\n", "|"), "count": p.count(), "loaded": loaded.count(), "names": ",".join(sorted(loaded.columns)),
        },
    )


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus='F' OR o_custkey%2=0)")
def collected_and_loaded(s, d):
    """A result taken to the driver and loaded as a relation again."""
    odd = table(read(s, d, "orders").filter("o_custkey % 2 = 1").select("o_custkey", "o_orderstatus"), "odd").restrict(not_(or_(val_eq("o_orderstatus", "F"), and_(val_eq("o_orderstatus", "F"), col_eq("o_custkey", "o_custkey")))))
    rows = [(r.o_custkey, r.o_orderstatus) for r in odd.collect()]
    return from_rows(s, rows, [("o_custkey", LongType()), ("o_orderstatus", StringType())]).to_df()
