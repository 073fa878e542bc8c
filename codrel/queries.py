"""The query catalogue: one Spark query for each operator of the algebra and the vectors, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicate import and_, col_eq, not_, or_, val_eq
from .operators import kernels
from .operators.vector import Vector
from .sources.tables import read, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _orders(s: SparkSession, d: str, *columns: str):
    return relation(s, d, "orders", columns or ORDERS, key=["o_orderkey"] if not columns or "o_orderkey" in columns else None)


def _customers(s: SparkSession, d: str, *columns: str):
    return relation(s, d, "customer", columns or None, key=["c_custkey"] if not columns or "c_custkey" in columns else None)


def _events(s: SparkSession, d: str, *columns: str) -> Vector:
    return Vector.from_df(read(s, d, "events").select("event_id", *columns), "event_id")


@query("SELECT DISTINCT n_nationkey, n_name, n_regionkey FROM nation")
def scan_table(s, d):
    return relation(s, d, "nation").to_df()


@query("SELECT DISTINCT * FROM customer WHERE c_mktsegment='BUILDING'")
def restrict_value_eq(s, d):
    return _customers(s, d).restrict(val_eq("c_mktsegment", "BUILDING")).to_df()


@query("SELECT DISTINCT * FROM orders WHERE o_orderstatus='F' OR o_orderpriority='1-URGENT'")
def restrict_disjunction(s, d):
    return _orders(s, d).restrict(or_(val_eq("o_orderstatus", "F"), val_eq("o_orderpriority", "1-URGENT"))).to_df()


@query("SELECT DISTINCT * FROM orders WHERE o_orderstatus='F' AND o_orderpriority='1-URGENT'")
def restrict_conjunction(s, d):
    return _orders(s, d).restrict(and_(val_eq("o_orderstatus", "F"), val_eq("o_orderpriority", "1-URGENT"))).to_df()


@query("SELECT DISTINCT * FROM orders WHERE NOT (o_orderstatus IS NOT DISTINCT FROM 'F')")
def restrict_negation(s, d):
    return _orders(s, d).restrict(not_(val_eq("o_orderstatus", "F"))).to_df()


@query("SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber IS NOT DISTINCT FROM l_suppkey")
def restrict_col_eq(s, d):
    from .operators.relation import table

    df = read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return table(df, "lineitem").restrict(col_eq("l_suppkey", "l_linenumber")).project(["l_orderkey", "l_partkey", "l_suppkey"]).to_df()


@query("SELECT DISTINCT o_orderkey FROM orders WHERE NOT (o_orderstatus='F' OR (o_orderstatus='O' AND o_orderpriority='1-URGENT'))")
def restrict_nested(s, d):
    p = not_(or_(val_eq("o_orderstatus", "F"), and_(val_eq("o_orderstatus", "O"), val_eq("o_orderpriority", "1-URGENT"))))
    return _orders(s, d).restrict(p).project(["o_orderkey"]).to_df()


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def project_dedup(s, d):
    return _orders(s, d).project(["o_orderpriority", "o_orderstatus"]).to_df()


@query("SELECT EXISTS(SELECT 1 FROM orders WHERE o_orderstatus='F') AS nonempty")
def project_null_nonempty(s, d):
    return _orders(s, d).restrict(val_eq("o_orderstatus", "F")).project([]).is_nonempty()


@query("SELECT EXISTS(SELECT 1 FROM orders WHERE o_orderstatus='no such') AS nonempty")
def project_null_empty(s, d):
    return _orders(s, d).restrict(val_eq("o_orderstatus", "no such")).project([]).is_nonempty()


@query("SELECT DISTINCT c.c_custkey, c.c_name, n.n_name, n.n_nationkey AS nationkey FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey")
def natural_join(s, d):
    c = _customers(s, d, "c_custkey", "c_name", "c_nationkey").rename("c_nationkey", "nationkey")
    n = relation(s, d, "nation", ["n_nationkey", "n_name"], key=["n_nationkey"]).rename("n_nationkey", "nationkey")
    return c.natural_join(n).to_df()


@query(
    "SELECT DISTINCT a.custkey, a.status, a.okey, b.priority FROM (SELECT o_custkey custkey,o_orderstatus status,o_orderkey okey FROM orders) a "
    "JOIN (SELECT DISTINCT o_custkey custkey,o_orderstatus status,o_orderpriority priority FROM orders) b USING (custkey,status)"
)
def natural_join_multi_key(s, d):
    def named(*columns):
        out = _orders(s, d, *columns)
        for c, n in (("o_custkey", "custkey"), ("o_orderstatus", "status"), ("o_orderkey", "okey"), ("o_orderpriority", "priority")):
            out = out.rename(c, n) if c in columns else out
        return out

    a = named("o_custkey", "o_orderstatus", "o_orderkey")
    b = named("o_custkey", "o_orderstatus", "o_orderpriority").distinct()  # few distinct records: smaller before the join
    return a.natural_join(b).to_df()


@query("SELECT DISTINCT r_name, n_name, s_name FROM region JOIN nation ON r_regionkey=n_regionkey JOIN supplier ON n_nationkey=s_nationkey")
def natural_join_three_way(s, d):
    r = relation(s, d, "region", key=["r_regionkey"]).rename("r_regionkey", "regionkey")
    n = relation(s, d, "nation", key=["n_nationkey"]).rename("n_regionkey", "regionkey").rename("n_nationkey", "nationkey")
    p = relation(s, d, "supplier", ["s_name", "s_nationkey"]).rename("s_nationkey", "nationkey")
    return r.natural_join(n).natural_join(p).project(["r_name", "n_name", "s_name"]).to_df()


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def natural_join_disjoint_is_cross(s, d):
    return relation(s, d, "region", ["r_name"]).natural_join(relation(s, d, "nation", ["n_name"])).to_df()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def natural_join_same_schema_is_intersection(s, d):
    return _orders(s, d, "o_custkey").rename("o_custkey", "k").natural_join(_customers(s, d, "c_custkey").rename("c_custkey", "k")).to_df()


def _orders_of_customers(s, d):
    o = _orders(s, d, "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").rename("o_custkey", "custkey")
    c = _customers(s, d, "c_custkey", "c_name", "c_nationkey", "c_mktsegment").rename("c_custkey", "custkey")
    return o.natural_join(c)


@query("SELECT DISTINCT o_orderkey, c_name FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderstatus='F' OR o_orderpriority='1-URGENT'")
def join_then_pushable_restrict(s, d):
    p = or_(val_eq("o_orderstatus", "F"), val_eq("o_orderpriority", "1-URGENT"))
    return _orders_of_customers(s, d).restrict(p).project(["o_orderkey", "c_name"]).to_df()


@query("SELECT DISTINCT o_orderkey, c_name FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderstatus='P' OR c_mktsegment='BUILDING'")
def join_then_nonpushable_disjunction(s, d):
    p = or_(val_eq("o_orderstatus", "P"), val_eq("c_mktsegment", "BUILDING"))
    return _orders_of_customers(s, d).restrict(p).project(["o_orderkey", "c_name"]).to_df()


@query(
    "SELECT DISTINCT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey "
    "WHERE o_orderstatus='P' OR c_mktsegment='BUILDING'"
)
def join_on_top_of_restrict(s, d):
    p = or_(val_eq("o_orderstatus", "P"), val_eq("c_mktsegment", "BUILDING"))
    n = relation(s, d, "nation", ["n_nationkey", "n_name"], key=["n_nationkey"]).rename("n_nationkey", "c_nationkey")
    return n.natural_join(_orders_of_customers(s, d).restrict(p)).project(["o_orderkey", "c_name", "n_name"]).to_df()


@query("SELECT DISTINCT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey=c_custkey")
def equijoin(s, d):
    return _orders(s, d, "o_orderkey", "o_custkey").equijoin("o_custkey", "c_custkey", _customers(s, d, "c_custkey", "c_name")).to_df()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus='P' AND o_orderpriority='5-LOW' UNION SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING'")
def union_set(s, d):
    low = _orders(s, d).restrict(and_(val_eq("o_orderstatus", "P"), val_eq("o_orderpriority", "5-LOW"))).project(["o_custkey"]).rename("o_custkey", "k")
    building = _customers(s, d).restrict(val_eq("c_mktsegment", "BUILDING")).project(["c_custkey"]).rename("c_custkey", "k")
    return low.union(building).to_df()


def _urgent(s, d):
    return _orders(s, d).restrict(and_(val_eq("o_orderstatus", "F"), val_eq("o_orderpriority", "1-URGENT"))).project(["o_custkey"]).rename("o_custkey", "k")


@query("SELECT c_custkey AS k FROM customer WHERE c_mktsegment='BUILDING' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus='F' AND o_orderpriority='1-URGENT'")
def intersection_set(s, d):
    return _customers(s, d).restrict(val_eq("c_mktsegment", "BUILDING")).project(["c_custkey"]).rename("c_custkey", "k").intersection(_urgent(s, d)).to_df()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='F' AND o_orderpriority='1-URGENT'")
def subtraction_set(s, d):
    return _customers(s, d, "c_custkey").rename("c_custkey", "k").difference(_urgent(s, d)).to_df()


@query("SELECT DISTINCT r_regionkey AS id, r_name FROM region")
def rename_column(s, d):
    return relation(s, d, "region").rename("r_regionkey", "id").to_df()


@query("SELECT n_nationkey AS foo FROM nation UNION SELECT r_regionkey FROM region")
def union_after_rename(s, d):
    a = relation(s, d, "nation").project(["n_nationkey"]).rename("n_nationkey", "foo")
    return a.union(relation(s, d, "region").project(["r_regionkey"]).rename("r_regionkey", "foo")).to_df()


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
def cardinality(s, d):
    return _orders(s, d).project(["o_custkey", "o_orderstatus"]).to_df().agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH a AS (SELECT n_regionkey k, row_number() OVER (ORDER BY n_nationkey)-1 AS ia FROM nation), "
    "b AS (SELECT r_regionkey k, row_number() OVER (ORDER BY r_regionkey)-1 AS ib FROM region) SELECT ia, ib FROM a JOIN b USING (k)"
)
def join_indices(s, d):
    a, b = Vector.from_df(read(s, d, "nation"), "n_nationkey"), Vector.from_df(read(s, d, "region"), "r_regionkey")
    return kernels.join_indices(a, b, [("n_regionkey", "r_regionkey")]).toDF("ia", "ib")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) p FROM events) WHERE p IS DISTINCT FROM event_type")
def uniq_runs(s, d):
    return _events(s, d, "event_type").uniq("event_type").to_df()


@query("SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey)-1 AS pos, c_mktsegment, c_custkey FROM customer")
def sort_multi_key(s, d):
    return Vector.from_df(read(s, d, "customer").select("c_mktsegment", "c_custkey"), "c_custkey").sort("c_mktsegment", "c_custkey").to_df("pos")


@query("SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey)-1 AS pos, index FROM (SELECT c_acctbal, c_custkey, row_number() OVER (ORDER BY c_custkey)-1 AS index FROM customer)")
def argsort(s, d):
    v = Vector.from_df(read(s, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return kernels.argsort(v, "c_acctbal").to_df("pos")


@query("WITH v AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey)-1 AS p FROM customer), w AS (SELECT n_nationkey AS i FROM nation) SELECT i AS pos, c_name FROM v JOIN w ON p = 3*i")
def gather(s, d):
    indices = Vector.generate(s, 25, lambda i: (i * 3).alias("i"))
    return kernels.index_many(indices, Vector.from_df(read(s, d, "customer").select("c_custkey", "c_name"), "c_custkey").map(F.col("c_name"))).to_df("pos")


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 25 OFFSET 10")
def vec_slice(s, d):
    return _events(s, d, "user_id").slice(10, 25).to_df()


@query("SELECT event_id, event_type FROM (SELECT *, min(CASE WHEN value<90 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) k FROM events) WHERE k=1")
def vec_take_while(s, d):
    return _events(s, d, "event_type", "value").take_while(F.col("value") < 90).map(F.col("event_id"), F.col("event_type")).to_df()


@query("SELECT event_id, event_type FROM (SELECT *, min(CASE WHEN value<90 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) k FROM events) WHERE k=0")
def vec_drop_while(s, d):
    return _events(s, d, "event_type", "value").drop_while(F.col("value") < 90).map(F.col("event_id"), F.col("event_type")).to_df()


@query("SELECT row_number() OVER (ORDER BY event_id)-1 AS pos, event_id FROM events WHERE event_type='click'")
def vec_filter(s, d):
    return _events(s, d, "event_type").filter(F.col("event_type") == "click").map(F.col("event_id")).to_df("pos")


@query("SELECT event_id, user_id*2+row_number() OVER (ORDER BY event_id)-1 AS v FROM events")
def vec_imap(s, d):
    return _events(s, d, "user_id").imap(lambda p: [F.col("event_id"), (F.col("user_id") * 2 + p).alias("v")]).to_df()


@query("SELECT count(*) OVER () - row_number() OVER (ORDER BY event_id) AS pos, event_id FROM events")
def vec_reverse(s, d):
    return _events(s, d).reverse().to_df("pos")


@query("SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
def vec_concat(s, d):
    v = Vector.from_df(read(s, d, "region").select("r_regionkey", "r_name"), "r_regionkey").map(F.col("r_name"))
    return (v + v).to_df()


@query(
    "SELECT row_number() OVER (ORDER BY o_orderkey, i)-1 AS pos, i AS value FROM (SELECT o_orderkey, unnest(range(0, o_orderkey%4)) AS i FROM orders)"
)
def vec_concat_map(s, d):
    n = F.col("o_orderkey") % 4
    return Vector.from_df(read(s, d, "orders").select("o_orderkey"), "o_orderkey").concat_map(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))).to_df("pos")


@query(
    "WITH a AS (SELECT n_name,row_number() OVER (ORDER BY n_nationkey) p FROM nation), b AS (SELECT r_name,row_number() OVER (ORDER BY r_regionkey) p FROM region) "
    "SELECT n_name, r_name FROM a JOIN b USING (p)"
)
def vec_zip(s, d):
    a = Vector.from_df(read(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").map(F.col("n_name"))
    return a.zip(Vector.from_df(read(s, d, "region"), "r_regionkey").map(F.col("r_name"))).to_df()


@query("SELECT count(*) AS n, min(event_id) AS lo, max(event_id) AS hi, bool_and(value>=0) AS all_nonneg, bool_or(event_type='click') AS any_click FROM events")
def vec_fold(s, d):
    v = _events(s, d, "event_type", "value")
    bounds = v.aggregate(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return bounds.withColumns({"all_nonneg": F.lit(v.all(F.col("value") >= 0)), "any_click": F.lit(v.any(F.col("event_type") == "click"))})


@query("SELECT row_number() OVER (ORDER BY event_id)-1 AS pos, event_type FROM events QUALIFY row_number() OVER (ORDER BY event_type DESC, event_id)=1")
def vec_max_index(s, d):
    v = _events(s, d, "event_type")
    at = v.max_index(F.col("event_type"))
    return v.slice(at, 1).to_df().select(F.lit(at).cast("long").alias("pos"), "event_type")


@query("SELECT row_number() OVER (ORDER BY event_id)-1 AS pos, event_type FROM events QUALIFY row_number() OVER (ORDER BY event_type, event_id)=1")
def vec_min_index(s, d):
    v = _events(s, d, "event_type")
    at = v.min_index(F.col("event_type"))
    return v.slice(at, 1).to_df().select(F.lit(at).cast("long").alias("pos"), "event_type")


@query("SELECT row_number() OVER (ORDER BY event_id)-1 AS pos, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS s FROM events")
def vec_postscanl(s, d):
    return _events(s, d, "user_id").postscanl("sum", F.col("user_id"), 0, "s").to_df("pos")


@query("SELECT row_number() OVER (ORDER BY event_id)-1 AS pos, CAST(coalesce(sum(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS s FROM events")
def vec_prescanl(s, d):
    return _events(s, d, "user_id").prescanl("sum", F.col("user_id"), 0, "s").to_df("pos")


@query("SELECT row_number() OVER (ORDER BY event_id)-1 AS pos, max(user_id) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM events")
def vec_scanr1(s, d):
    return _events(s, d, "user_id").scanr1("max", F.col("user_id"), "m").to_df("pos")


@query("SELECT n.n_nationkey, CAST(n.n_regionkey + coalesce(x.c,0) AS BIGINT) AS v FROM nation n LEFT JOIN (SELECT c_nationkey, count(*) c FROM customer GROUP BY 1) x ON n.n_nationkey=x.c_nationkey")
def vec_accum(s, d):
    v = Vector.from_df(read(s, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("v")), "n_nationkey")
    return v.accum("v", "sum", read(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("_to"), F.lit(1).cast("long").alias("_c"))).to_df()


@query("SELECT n.n_nationkey, coalesce(u.nm, n.n_name) AS n_name FROM nation n LEFT JOIN (SELECT c_nationkey, arg_max(c_name, c_custkey) nm FROM customer GROUP BY 1) u ON n.n_nationkey=u.c_nationkey")
def vec_update(s, d):
    v = Vector.from_df(read(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    changes = read(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("_to"), F.col("c_custkey").alias("_seq"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_name").alias("n_name"))
    return v.update(changes).to_df()


@query("SELECT DISTINCT c_name FROM customer JOIN orders ON c_custkey=o_custkey WHERE c_mktsegment='BUILDING' AND o_orderstatus='F'")
def building_customers_with_finished_orders(s, d):
    p = and_(val_eq("c_mktsegment", "BUILDING"), val_eq("o_orderstatus", "F"))
    return _orders_of_customers(s, d).restrict(p).project(["c_name"]).to_df()


from . import vector_queries  # noqa: E402, F401  registers the queries of all vector operators
