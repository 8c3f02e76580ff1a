"""Query catalogue of the engine over the driver's tables, with DuckDB SQL for each query.

Nested results are flattened for the comparison; the nested form is what
:meth:`Database.fetch` gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .db import Database
from .operators import changes as C
from .operators import evolve, sync, writes
from .plans.ast import Q, and_, exists, or_
from .sources import catalog as K
from .streaming import live

TABLES = {
    "regions": "region",
    "nations": "nation",
    "customers": "customer",
    "suppliers": "supplier",
    "parts": "part",
    "orders": "orders",
    "lines": "lineitem",
    "events": "events",
    "turns": "conversations",
    "vectors": "embeddings",
}

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def schema(**permissions) -> S.Schema:
    given = permissions
    return S.Schema.of(
        S.Collection("regions", id="r_regionkey", relationships={"nations": S.many("nations", ("n_regionkey", "=", "$id"))}),
        S.Collection(
            "nations",
            id="n_nationkey",
            relationships={
                "region": S.by_id("regions", "$n_regionkey", "r_regionkey"),
                "customers": S.many("customers", ("c_nationkey", "=", "$id")),
                "suppliers": S.many("suppliers", ("s_nationkey", "=", "$id")),
            },
        ),
        S.Collection(
            "customers",
            id="c_custkey",
            relationships={
                "nation": S.by_id("nations", "$c_nationkey", "n_nationkey"),
                "orders": S.many("orders", ("o_custkey", "=", "$id")),
                "big_orders": S.many("orders", ("o_custkey", "=", "$id"), ("o_totalprice", ">", 400000.0)),
                "last_order": S.Relationship(Q("orders").where("o_custkey", "=", "$id").order("o_orderdate", "DESC").take(1), "one"),
            },
            permissions=given.get("customers"),
        ),
        S.Collection(
            "orders",
            id="o_orderkey",
            relationships={"customer": S.by_id("customers", "$o_custkey", "c_custkey"), "lines": S.many("lines", ("l_orderkey", "=", "$id"))},
            permissions=given.get("orders"),
        ),
        S.Collection("lines", id="l_orderkey", relationships={"order": S.by_id("orders", "$l_orderkey", "o_orderkey"), "part": S.by_id("parts", "$l_partkey", "p_partkey")}, keyed=False),
        S.Collection("parts", id="p_partkey", relationships={"lines": S.many("lines", ("l_partkey", "=", "$id"))}),
        S.Collection("suppliers", id="s_suppkey", relationships={"nation": S.by_id("nations", "$s_nationkey", "n_nationkey")}),
        S.Collection("events", {"props": S.json()}, id="event_id"),
        S.Collection("turns", id="turn", keyed=False),
        S.Collection("chats", id="conv_id", relationships={"turns": S.many("turns", ("conv_id", "=", "$id"))}),
        S.Collection("vectors", id="vec_id"),
        S.Collection("graded", id="doc_id"),
        S.Collection("profiles", id="user_id"),
        S.Collection("contacts", id="c_custkey"),
        roles={"clerk": {"role": "clerk", "segment": "$segment"}, "auditor": {"role": "auditor"}},
    )


def database(spark: SparkSession, sf_dir: str, **permissions) -> Database:
    """The driver's tables as collections, and collections derived from them for what the tables don't have."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    derived = {
        "chats": lambda: table("conversations").select("conv_id").distinct(),
        "graded": lambda: table("documents").select("doc_id", "lang", "source", "n_chars").join(table("labels"), "doc_id", "left"),
        "profiles": lambda: table("events").groupBy("user_id").agg(
            F.array_sort(F.collect_set("event_type")).alias("types"), F.array_sort(F.collect_set(F.when(F.col("value") > 250, F.col("event_type")))).alias("costly"),
            F.array_sort(F.collect_set((F.col("event_id") % 7).cast("double"))).alias("digits"), F.array_sort(F.collect_set((F.col("user_id") % 25).cast("int"))).alias("places"),
        ).withColumn("costly", F.when(F.size("costly") > 0, F.col("costly"))),
        "contacts": lambda: table("customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct("c_nationkey", "c_mktsegment").alias("home")).alias("profile")),
    }
    frames = {name: (lambda t=t: table(t)) for name, t in TABLES.items()}
    return Database(K.Catalog({**frames, **derived}), schema(**permissions))


def query(sql: str | None, **permissions):
    """Register a function of a database as a query of its name."""

    def keep(f):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(database(spark, sf_dir, **permissions))
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return keep


def fetch(name: str, q, sql: str) -> None:
    _QUERIES[name] = lambda spark, sf_dir: database(spark, sf_dir).fetch(q)
    _ORACLE[name] = sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment's 20 most recent orders including the customer."""
    db = database(spark, sf_dir)
    q = Q("orders").where("customer.c_mktsegment", "=", "BUILDING").order("o_orderdate", "DESC").take(20).include("customer").select("o_orderkey", "o_orderdate", "o_totalprice")
    return db.fetch(q).select("o_orderkey", "o_orderdate", "o_totalprice", "customer.c_custkey", "customer.c_name")


_QUERIES["recent_orders"] = flagship
_ORACLE["recent_orders"] = """SELECT o_orderkey, o_orderdate, o_totalprice, c_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"""


def _flat(df: DataFrame, alias: str, keep: list[str], fields: list[str]) -> DataFrame:
    """An include of many, a row per child with its place; parents without children have nulls."""
    out = df.select(*keep, F.posexplode_outer(alias).alias("pos", "child"))
    return out.select(*keep, F.col("pos").cast("long").alias("pos"), *[F.col(f"child.{f}").alias(f) for f in fields])


# -- scans, projections, filters ----------------------------------------------

fetch("scan_all", Q("nations"), "SELECT * FROM nation")
fetch("select_cols", Q("customers").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer")
fetch("filter_eq", Q("orders").where("o_orderstatus", "=", "F"), "SELECT * FROM orders WHERE o_orderstatus = 'F'")
fetch("filter_ne", Q("graded").where("quality", "!=", 1), "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1")
fetch("filter_gt", Q("orders").where("o_totalprice", ">", 400000.0).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
fetch("filter_gte", Q("graded").where("quality", ">=", 0).select("doc_id"), "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality >= 0, false)")
fetch("filter_lt", Q("graded").where("quality", "<", 1).select("doc_id"), "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality < 1")
fetch("filter_lte", Q("graded").where("toxic", "<=", 0).select("doc_id"), "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL OR toxic <= 0")
fetch("filter_eq_null", Q("graded").where("quality", "=", None).select("doc_id"), "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
fetch("filter_like", Q("customers").where("c_name", "like", "customer#%7_").select("c_custkey", "c_name"), r"SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'customer#%7_'")
fetch("filter_nlike", Q("parts").where("p_type", "nlike", "%BRASS%").select("p_partkey", "p_type"), "SELECT p_partkey, p_type FROM part WHERE p_type IS NULL OR NOT p_type ILIKE '%BRASS%'")
fetch("filter_in", Q("orders").where("o_orderpriority", "in", ["1-URGENT", "2-HIGH", None]).select("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
fetch("filter_nin", Q("graded").where("quality", "nin", [1, None]).select("doc_id", "quality"), "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality NOT IN (1)")
fetch("filter_is_defined", Q("graded").where("toxic", "isDefined", True).select("doc_id", "toxic"), "SELECT doc_id, toxic FROM labels JOIN documents USING (doc_id)")
fetch(
    "filter_date_range",
    Q("orders").where(("o_orderdate", ">=", "1996-01-01"), ("o_orderdate", "<", "1997-01-01")).select("o_orderkey", "o_orderdate"),
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'",
)
fetch("filter_nested", Q("contacts").where("profile.home.c_mktsegment", "=", "BUILDING").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
fetch(
    "filter_and_or",
    Q("customers").where(or_(and_(("c_mktsegment", "=", "BUILDING"), ("c_acctbal", ">", 5000.0)), ("c_nationkey", "in", [1, 2]))).select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 5000) OR c_nationkey IN (1, 2)",
)
fetch("filter_true", Q("regions").where(True), "SELECT * FROM region")
fetch("filter_false", Q("regions").where(False), "SELECT * FROM region WHERE false")
fetch("json_filter", Q("events").where("props.k", ">", 50).select("event_id", "props"), "SELECT event_id, props FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 50")
fetch("json_across_types", Q("events").where(("props.k", "<", "50"), ("props.k", "!=", 7)).select("event_id"), "SELECT event_id FROM events WHERE json_type(props, '$.k') <> 'VARCHAR' AND CAST(json_extract(props, '$.k') AS DOUBLE) <> 7")


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def select_nested(db):
    df = db.fetch(Q("contacts").select("c_custkey", "profile.name", "profile.home.c_mktsegment"))
    return df.select("c_custkey", F.col("profile.name").alias("name"), F.col("profile.home.c_mktsegment").alias("segment"))


_PROFILES = """(SELECT user_id, list_sort(list(DISTINCT event_type)) AS types, list_sort(list(DISTINCT event_type) FILTER (value > 250)) AS costly,
list(DISTINCT (event_id % 7)::DOUBLE) AS digits, [(user_id % 25)::INT] AS places FROM events GROUP BY user_id)"""
fetch("set_has", Q("profiles").where("types", "has", "click").select("user_id"), f"SELECT user_id FROM {_PROFILES} WHERE list_contains(types, 'click')")
fetch("set_not_has", Q("profiles").where("costly", "!has", "click").select("user_id"), f"SELECT user_id FROM {_PROFILES} WHERE NOT coalesce(list_contains(costly, 'click'), false)")
fetch("set_is_defined", Q("profiles").where("costly", "isDefined", False).select("user_id"), f"SELECT user_id FROM {_PROFILES} WHERE costly IS NULL")
fetch("set_any_gt", Q("profiles").where("digits", ">", 5).select("user_id"), f"SELECT user_id FROM {_PROFILES} WHERE len(list_filter(digits, lambda x: x > 5)) > 0")
fetch("set_any_like", Q("profiles").where("types", "like", "%cha%").select("user_id"), f"SELECT user_id FROM {_PROFILES} WHERE len(list_filter(types, lambda x: x ILIKE '%cha%')) > 0")
fetch("set_in_intersects", Q("profiles").where("types", "in", ["error", "signup"]).select("user_id"), f"SELECT user_id FROM {_PROFILES} WHERE list_has_any(types, ['error', 'signup'])")
fetch("id_lookup", Q("customers").by_id(77, "c_custkey"), "SELECT * FROM customer WHERE c_custkey = 77")
fetch("id_in", Q("customers").by_id([5, 5, 7, 100000000], "c_custkey"), "SELECT * FROM customer WHERE c_custkey IN (5, 7)")
fetch("fetch_one", Q("orders").where("o_totalprice", ">", 300000.0).take(1), "SELECT * FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 1")

# -- order, limit, cursors ---------------------------------------------------

fetch("limit_no_order", Q("customers").take(10), "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
fetch(
    "order_multi",
    Q("graded").order(("quality", "DESC"), ("lang", "ASC")).take(300).select("doc_id", "quality", "lang"),
    "SELECT doc_id, quality, lang FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, lang ASC NULLS FIRST, doc_id LIMIT 300",
)
fetch("order_nested", Q("contacts").order("profile.home.c_mktsegment", "ASC").take(50).select("c_custkey"), "SELECT c_custkey FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 50")
fetch("order_limit", Q("orders").order("o_orderdate", "DESC").take(100), "SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
fetch(
    "after_cursor",
    Q("graded").order(("quality", "ASC"), ("doc_id", "DESC")).after((0, 100)).take(50).select("doc_id", "quality"),
    """SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality > 0, false) OR (quality = 0 AND doc_id < 100)
ORDER BY quality, doc_id DESC LIMIT 50""",
)
fetch(
    "after_inclusive",
    Q("customers").order(("c_mktsegment", "DESC"), ("c_custkey", "ASC")).after(("FURNITURE", 40), inclusive=True).select("c_custkey", "c_mktsegment"),
    "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'FURNITURE' OR (c_mktsegment = 'FURNITURE' AND c_custkey >= 40)",
)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey ASC LIMIT 25 OFFSET 25")
def page_2(db):
    q = Q("orders").order(("o_orderdate", "DESC"), ("o_orderkey", "ASC"))
    first = live.page(db, q, 25)
    return live.page(db, q, 25, first.last).rows.select("o_orderkey", "o_orderdate")


# -- joins -----------------------------------------------------------------------

fetch(
    "exists_semi",
    Q("customers").where(exists(Q("orders").where(("o_custkey", "=", "$1.c_custkey"), ("o_totalprice", ">", 450000.0)))).select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
)
fetch(
    "exists_relation",
    Q("nations").where(exists("suppliers", ("s_acctbal", ">", 9000.0))).select("n_name"),
    "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)",
)
fetch(
    "exists_deep",
    Q("customers").where(exists("orders.lines.part", ("p_brand", "=", "Brand#11"))).select("c_custkey"),
    """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (
SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#11'))""",
)
fetch(
    "exists_in_or",
    Q("customers").where(or_(("c_acctbal", ">", 9500.0), exists("big_orders"))).select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE c_acctbal > 9500 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
fetch(
    "exists_grandparent",
    Q("nations").where(exists("customers", exists(Q("suppliers").where(("s_nationkey", "=", "$2.n_nationkey"), ("s_acctbal", ">", "$1.c_acctbal"))))).select("n_nationkey"),
    """SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND EXISTS (
SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > c_acctbal))""",
)
fetch(
    "exists_theta",
    Q("customers").where(exists(Q("suppliers").where(("s_acctbal", "<", "$1.c_acctbal"), ("s_nationkey", "=", 3)))).select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < c_acctbal AND s_nationkey = 3)",
)
fetch(
    "rel_path_filter",
    Q("orders").where(("customer.nation.n_name", "=", "NATION_7"), ("customer.c_acctbal", "<", 1000.0)).select("o_orderkey"),
    "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_7' AND c_acctbal < 1000",
)
fetch(
    "rel_value_filter",
    Q("nations").where(exists("customers", ("c_acctbal", ">", 9900.0), ("c_custkey", ">", "$1.n_regionkey"))).select("n_name"),
    "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900 AND c_custkey > n_regionkey)",
)


@query("SELECT n_nationkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS pos, s_suppkey, s_acctbal FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey, NULL, NULL, NULL FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def include_many(db):
    return _flat(db.fetch(Q("nations").include("suppliers")), "suppliers", ["n_nationkey"], ["s_suppkey", "s_acctbal"])


@query("SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) ON o_custkey = c_custkey AND rn = 1")
def include_one(db):
    return db.fetch(Q("customers").include("last_order")).select("c_custkey", "last_order.o_orderkey", "last_order.o_orderdate")


@query("""SELECT c_custkey, rn - 1 AS pos, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
ON o_custkey = c_custkey AND rn <= 3""")
def include_top_k(db):
    df = db.fetch(Q("customers").include("orders", extend=lambda r: r.order("o_totalprice", "DESC").take(3).select("o_orderkey")))
    return _flat(df, "orders", ["c_custkey"], ["o_orderkey"])


@query("SELECT r_regionkey, n_nationkey, s_suppkey FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey")
def include_nested(db):
    df = db.fetch(Q("regions").include("nations", extend=lambda r: r.include("suppliers")))
    one = df.select("r_regionkey", F.explode_outer("nations").alias("n"))
    two = one.select("r_regionkey", F.col("n.n_nationkey").alias("n_nationkey"), F.explode_outer("n.suppliers").alias("s"))
    return two.select("r_regionkey", "n_nationkey", "s.s_suppkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 AND o_orderstatus = 'O'")
def include_extended(db):
    df = db.fetch(Q("customers").include("open", relation="big_orders", extend=lambda r: r.where("o_orderstatus", "=", "O").select("o_orderkey")))
    return _flat(df, "open", ["c_custkey"], ["o_orderkey"]).drop("pos")


@query("SELECT r_regionkey, n_nationkey FROM region, nation WHERE n_nationkey < 3")
def include_uncorrelated(db):
    df = db.fetch(Q("regions").include("some", Q("nations").where("n_nationkey", "<", 3)))
    return _flat(df, "some", ["r_regionkey"], ["n_nationkey"]).drop("pos")


@query(f"SELECT user_id, n_nationkey FROM (SELECT user_id, unnest(places) AS place FROM {_PROFILES}) LEFT JOIN nation ON n_nationkey = place")
def include_in_set(db):
    df = db.fetch(Q("profiles").include("nations", Q("nations").where("n_nationkey", "in", "$1.places")))
    return _flat(df, "nations", ["user_id"], ["n_nationkey"]).drop("pos")


@query(f"SELECT n_nationkey, user_id FROM nation LEFT JOIN (SELECT user_id, unnest(places) AS place FROM {_PROFILES}) ON n_nationkey = place")
def include_has_set(db):
    df = db.fetch(Q("nations").include("users", Q("profiles").where("places", "has", "$1.n_nationkey")))
    return _flat(df, "users", ["n_nationkey"], ["user_id"]).drop("pos")


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50) LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def subquery_many(db):
    df = db.fetch(Q("customers").take(50).subquery_many("pending", Q("orders").where(("o_custkey", "=", "$1.c_custkey"), ("o_orderstatus", "=", "P"))))
    return _flat(df, "pending", ["c_custkey"], ["o_orderkey"]).drop("pos")


@query("SELECT conv_id, turn AS last_turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def subquery_one(db):
    df = db.fetch(Q("chats").subquery_one("last", Q("turns").where("conv_id", "=", "$1.conv_id").order("turn", "DESC").select("turn", "role")))
    return df.select("conv_id", F.col("last.turn").alias("last_turn"), "last.role")


fetch(
    "order_by_relation",
    Q("customers").order(("nation.n_name", "DESC"), ("c_acctbal", "ASC")).take(40).select("c_custkey"),
    "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey ORDER BY n_name DESC, c_acctbal ASC, c_custkey LIMIT 40",
)
fetch(
    "order_by_deep_relation",
    Q("customers").order(("nation.region.r_name", "ASC"), ("c_name", "DESC")).take(40).select("c_custkey"),
    "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey ORDER BY r_name, c_name DESC, c_custkey LIMIT 40",
)

# -- variables, sessions, permissions -------------------------------------------

fetch("vars_query", Q("customers").vars(segment="BUILDING").where("c_mktsegment", "=", "$query.segment").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
fetch("vars_missing", Q("customers").where("c_mktsegment", "=", "$query.segment").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment IS NULL")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 420000")
def vars_global(db):
    return db.with_globals(floor=420000.0).fetch(Q("orders").where("o_totalprice", ">", "$global.floor").select("o_orderkey"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 4)")
def vars_session(db):
    return db.with_session({"nations": [3, 4]}).fetch(Q("customers").where("c_nationkey", "in", "$session.nations").select("c_custkey"))


_CLERK = {"clerk": {"read": (("c_mktsegment", "=", "$role.segment"),), "insert": (("c_acctbal", ">", 0.0),)}, "auditor": {"read": (True,)}}


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0", customers=_CLERK)
def perm_read(db):
    return db.with_session({"role": "clerk", "segment": "MACHINERY"}).fetch(Q("customers").where("c_acctbal", ">", 0.0).select("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE false", customers=_CLERK)
def perm_denied(db):
    return db.with_session({"role": "guest"}).fetch(Q("customers").select("c_custkey"))


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'", customers=_CLERK, orders={"clerk": {"read": (exists("customer"),)}})
def perm_exists(db):
    return db.with_session({"role": "clerk", "segment": "MACHINERY"}).fetch(Q("orders").select("o_orderkey"))


@query("SELECT c_custkey + 10000000 AS c_custkey FROM customer WHERE c_nationkey = 2 AND c_acctbal <= 0", customers=_CLERK)
def perm_insert_violations(db):
    own = db.with_session({"role": "clerk", "segment": "MACHINERY"})
    rows = db.catalog.frame("customers").where("c_nationkey = 2").withColumn("c_custkey", F.col("c_custkey") + 10000000)
    return writes.forbidden(own, "customers", "insert", rows).select("c_custkey")


_KEEPER = {"clerk": {"read": (True,), "update": (("c_mktsegment", "=", "$role.segment"),), "postUpdate": (("c_acctbal", ">=", "$prev.c_acctbal"),), "delete": (exists("orders"), ("c_acctbal", "<", 0.0))}}


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 2 AND c_mktsegment <> 'MACHINERY'", customers=_KEEPER)
def perm_update_violations(db):
    own = db.with_session({"role": "clerk", "segment": "MACHINERY"})
    return writes.forbidden(own, "customers", "update", db.catalog.frame("customers").where("c_nationkey = 2")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 2 AND c_custkey % 3 = 0", customers=_KEEPER)
def perm_post_update_violations(db):
    own = db.with_session({"role": "clerk", "segment": "MACHINERY"})
    before = db.catalog.frame("customers").where("c_nationkey = 2")
    after = before.withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 3 == 0, -1).otherwise(1))
    return writes.forbidden(own, "customers", "postUpdate", after, before).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 2 AND NOT (c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders))", customers=_KEEPER)
def perm_delete_violations(db):
    own = db.with_session({"role": "clerk", "segment": "MACHINERY"})
    return writes.forbidden(own, "customers", "delete", db.catalog.frame("customers").where("c_nationkey = 2")).select("c_custkey")


# -- changes ----------------------------------------------------------------------


def _event_changes(db):
    """Every tenth event deleted, the next patched, copies of the one after inserted under new ids."""
    e = db.catalog.frame("events")
    patched = e.where("event_id % 10 = 1").withColumn("value", F.col("value") + 1).withColumn("event_type", F.lit("patched"))
    added = e.where("event_id % 10 = 2").withColumn("event_id", F.col("event_id") + 1000000000)
    return (
        C.make_changes(e.where("event_id % 10 = 0"), "delete", F.lit(1), [])
        .unionByName(C.make_changes(patched, "update", F.lit(2), ["value", "event_type"]))
        .unionByName(C.make_changes(added, "insert", F.lit(3)))
    )


_AFTER = """(SELECT event_id, ts, user_id, CASE WHEN event_id % 10 = 1 THEN 'patched' ELSE event_type END AS event_type,
CASE WHEN event_id % 10 = 1 THEN value + 1 ELSE value END AS value, props FROM events WHERE event_id % 10 <> 0
UNION ALL SELECT event_id + 1000000000, ts, user_id, event_type, value, props FROM events WHERE event_id % 10 = 2)"""


@query(f"SELECT * FROM {_AFTER}")
def tx_overlay(db):
    return C.overlay(db.catalog.frame("events"), _event_changes(db), id_column="event_id")


@query("""SELECT event_id, ts, user_id, CASE WHEN event_id % 10 = 1 THEN 'sent again' ELSE event_type END AS event_type,
CASE WHEN event_id % 10 = 1 THEN value + 1 ELSE value END AS value, props FROM events WHERE event_id % 10 NOT IN (0, 5)
UNION ALL SELECT event_id + 1000000000, ts, user_id, event_type, value, props FROM events WHERE event_id % 10 = 2""")
def outbox_overlay(db):
    e = db.catalog.frame("events")
    second = C.make_changes(e.where("event_id % 10 = 1").withColumn("event_type", F.lit("sent again")), "update", F.lit(1), ["event_type"]).unionByName(C.make_changes(e.where("event_id % 10 = 5"), "delete", F.lit(2), []))
    return C.outbox_overlay(e, _event_changes(db), second, id_column="event_id")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, 'NEW_' || n_name, n_regionkey FROM nation WHERE n_nationkey < 5")
def mut_insert(db):
    rows = db.catalog.frame("nations").where("n_nationkey < 5").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.concat(F.lit("NEW_"), "n_name").alias("n_name"), "n_regionkey")
    return writes.Transaction.begin(db).insert("nations", rows).fetch(Q("nations"))


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def mut_update(db):
    rows = db.catalog.frame("customers").where("c_nationkey = 3").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return writes.Transaction.begin(db).update("customers", rows).fetch(Q("customers"))


@query("SELECT * FROM customer WHERE c_nationkey <> 3")
def mut_delete(db):
    return writes.Transaction.begin(db).delete("customers", db.catalog.frame("customers").where("c_nationkey = 3").select("c_custkey")).fetch(Q("customers"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 4 THEN NULL ELSE n_name END AS n_name, CASE WHEN n_nationkey < 4 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation")
def mut_delete_reinsert(db):
    n = db.catalog.frame("nations")
    some = n.where("n_nationkey < 4")
    parts = C.make_changes(some, "delete", F.lit(1), []).unionByName(C.make_changes(some.withColumn("n_regionkey", F.lit(9)), "insert", F.lit(2), ["n_nationkey", "n_regionkey"]))
    return C.overlay(n, parts, id_column="n_nationkey")


@query(f"SELECT user_id, unnest(list_distinct(list_concat(list_filter(types, lambda x: x <> 'click'), ['vip']))) AS member FROM {_PROFILES}")
def mut_set_merge(db):
    p = db.catalog.frame("profiles")
    state = F.map_from_entries(F.transform("types", lambda t: F.struct(t.alias("key"), F.lit(True).alias("value"))))
    patch = F.create_map(F.lit("click"), F.lit(False), F.lit("vip"), F.lit(True))
    return p.select("user_id", F.explode(C.set_members(C.merge_set(state, patch))).alias("member"))


@query("""SELECT n_nationkey, n_name, n_regionkey, 'open' AS state, true AS same, true AS dated, '7' AS version FROM nation WHERE n_nationkey < 0
UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey, 'open', true, true, '7' FROM nation""")
def mut_default_stored(db):
    """Two reads of inserted rows find the same defaults; ids are of version 7 and times those of the write."""
    n = db.catalog.frame("nations")
    attrs = {"n_nationkey": S.number(), "n_name": S.string(), "n_regionkey": S.number(), "state": S.string(default="open"), "made": S.date(default={"fn": "now"}), "token": S.string(default={"fn": "uuidv7"}), "tag": S.string(default={"fn": "nanoid"})}
    own = Database(K.Catalog({"offices": n.where("false").selectExpr("*", "'' AS state", "current_timestamp() AS made", "'' AS token", "'' AS tag")}), S.Schema.of(S.Collection("offices", attrs, id="n_nationkey")))
    after = own.insert("offices", n.withColumn("n_nationkey", F.col("n_nationkey") + 100))
    one, two = after.fetch(Q("offices")), after.fetch(Q("offices")).select(F.col("n_nationkey").alias("id"), F.struct("made", "token", "tag").alias("second"))
    dated = F.abs(F.unix_millis("made") - F.conv(F.substring(F.translate("token", "-", ""), 1, 12), 16, 10).cast("long")) < 1
    return one.join(two, F.col("n_nationkey") == F.col("id")).select("n_nationkey", "n_name", "n_regionkey", "state", (F.struct("made", "token", "tag") == F.col("second")).alias("same"), dated.alias("dated"), F.substring("token", 15, 1).alias("version"))


def _contact_rows(db):
    return db.catalog.frame("contacts").where("c_custkey % 3 = 0").select("c_custkey")


_CONTACTS = """SELECT c_custkey, {name} AS name, {nation} AS nation, {segment} AS segment FROM customer"""


def _contacts(db):
    return db.fetch(Q("contacts")).select("c_custkey", "profile.name", F.col("profile.home.c_nationkey").alias("nation"), F.col("profile.home.c_mktsegment").alias("segment"))


@query(_CONTACTS.format(name="c_name", nation="CASE WHEN c_custkey % 3 = 0 THEN 99 ELSE c_nationkey END", segment="c_mktsegment"))
def mut_record_merge(db):
    rows = _contact_rows(db).select("c_custkey", F.struct(F.struct(F.lit(99).alias("c_nationkey")).alias("home")).alias("profile"))
    return _contacts(writes.Transaction.begin(db).update("contacts", rows).db)


@query(_CONTACTS.format(name="CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END", nation="c_nationkey", segment="c_mktsegment"))
def mut_record_null(db):
    rows = _contact_rows(db).select("c_custkey", F.struct(F.lit(None).cast("string").alias("name")).alias("profile"))
    return _contacts(writes.Transaction.begin(db).update("contacts", rows).db)


@query(_CONTACTS.format(name="c_name", nation="CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE c_nationkey END", segment="CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END"))
def mut_record_assign(db):
    rows = _contact_rows(db).select("c_custkey", F.struct(F.struct(F.lit(7).alias("c_nationkey")).alias("home")).alias("profile"))
    return _contacts(writes.Transaction.begin(db).update("contacts", rows, whole=("profile.home",)).db)


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer")
def mut_update_fn(db):
    tx = writes.Transaction.begin(db).update_where("customers", ("c_acctbal", "<", 0.0), {"c_acctbal": -F.col("c_acctbal"), "c_mktsegment": F.lower("c_mktsegment")})
    return tx.fetch(Q("customers"))


@query("""SELECT event_id, 'update' AS op, CASE WHEN event_type = 'click' THEN 'value' ELSE 'event_type,value' END AS fields FROM events WHERE event_id % 10 = 1
UNION ALL SELECT event_id, 'delete', '' FROM events WHERE event_id % 10 = 0""")
def changes_effective(db):
    e = db.catalog.frame("events")
    patched = e.where("event_id % 10 = 1").withColumn("value", F.col("value") + 1).withColumn("event_type", F.lit("click"))
    nothing, gone = e.where("event_id % 10 = 2"), e.where("event_id % 10 = 0")
    parts = C.make_changes(patched, "update", F.lit(1), ["value", "event_type"]).unionByName(C.make_changes(nothing, "update", F.lit(2), ["value"]))
    parts = parts.unionByName(C.make_changes(gone.unionByName(gone.withColumn("event_id", F.col("event_id") + 1000000000)), "delete", F.lit(3), []))
    return C.effective(e, parts, "event_id").select("event_id", "op", F.array_join(F.array_sort("fields"), ",").alias("fields"))


@query("""SELECT event_id, CASE WHEN event_id % 10 IN (0, 5) THEN 'delete' WHEN event_id >= 1000000000 THEN 'insert' ELSE 'update' END AS op,
CASE WHEN event_id % 10 = 1 THEN 'sent again' WHEN event_id >= 1000000000 THEN event_type END AS event_type
FROM (SELECT event_id, event_type FROM events WHERE event_id % 10 IN (0, 1, 5) UNION ALL SELECT event_id + 1000000000, event_type FROM events WHERE event_id % 10 = 2)""")
def merge_changes(db):
    e = db.catalog.frame("events")
    second = C.make_changes(e.where("event_id % 10 = 1").withColumn("event_type", F.lit("sent again")), "update", F.lit(1), ["event_type"]).unionByName(C.make_changes(e.where("event_id % 10 = 5"), "delete", F.lit(2), []))
    return C.merge_changes(_event_changes(db), second, id_column="event_id").select("event_id", "op", "event_type")


@query("""SELECT event_id, 'delete' AS op, '' AS changed FROM events WHERE event_id % 10 = 0
UNION ALL SELECT event_id, 'update', 'event_type,value' FROM events WHERE event_id % 10 = 1
UNION ALL SELECT event_id + 1000000000, 'insert', NULL FROM events WHERE event_id % 10 = 2""")
def diff_snapshots(db):
    e = db.catalog.frame("events")
    found = C.diff(e, C.overlay(e, _event_changes(db), id_column="event_id"), "event_id")
    names = F.array_join(F.array_sort("changed"), ",")
    return found.select("event_id", "op", F.when(F.col("op") == "update", names).when(F.col("op") == "delete", "").alias("changed"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def lww_latest(db):
    log = db.catalog.frame("events").select("user_id", "ts", "event_id", "event_type", "value")
    return C.lww_latest(log, ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_type", "value")


@query("""SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_id % 3 <> 0) AS value, arg_max(event_type, (ts, event_id)) FILTER (event_id % 2 = 0) AS event_type FROM events GROUP BY user_id""")
def lww_fold(db):
    e = db.catalog.frame("events")
    log = e.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value"))).withColumn("event_type", F.when(F.col("event_id") % 2 == 0, F.col("event_type")))
    return C.lww_fold(log, ["user_id"], F.struct("ts", "event_id"), ["value", "event_type"])


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'click' ELSE event_type END AS event_type FROM events""")
def lww_stamped(db):
    e = db.catalog.frame("events").select("event_id", "event_type")
    stamps = e.select("event_id", (F.col("event_id") % 2 * 10).alias("stamp"))
    rows = e.where("event_id % 4 in (0, 1)").withColumn("event_type", F.lit("click"))
    changes = C.make_changes(rows, "update", F.lit(0), ["event_type"]).withColumn("stamp", F.lit(5).cast("long"))
    return C.apply_stamped(e, stamps, changes, "event_id")[0]


@query("""SELECT event_id, 'set' AS op FROM events WHERE event_type = 'click' AND (event_id % 3 <> 0 OR event_id % 5 = 0)
UNION ALL SELECT event_id, 'delete' FROM events WHERE event_type <> 'click' AND event_id % 3 = 0""")
def checkpoint_delta(db):
    e = db.catalog.frame("events")
    result = db.fetch(Q("events").where("event_type", "=", "click"))
    stamps = e.select("event_id", F.when(F.col("event_id") % 5 == 0, 2).otherwise(1).alias("stamp"))
    return C.checkpoint_delta(result, e.where("event_id % 3 = 0").select("event_id"), stamps, F.lit(1), "event_id")


# -- live queries --------------------------------------------------------------------


def _part(db, n):
    return _event_changes(db).where({1: "op = 'insert'", 2: "op = 'update'", 3: "op = 'delete'"}[n])


_CLICKS = Q("events").where("event_type", "in", ["click", "patched"]).select("event_id", "value")


@query("SELECT event_id, value FROM (SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id + 1000000000, event_type, value FROM events WHERE event_id % 10 = 2) WHERE event_type = 'click'")
def ivm_insert(db):
    return live.View.open(db, _CLICKS).apply({"events": _part(db, 1)}).result()


@query("SELECT event_id, CASE WHEN event_id % 10 = 1 THEN value + 1 ELSE value END AS value FROM events WHERE event_type = 'click' OR event_id % 10 = 1")
def ivm_update(db):
    return live.View.open(db, _CLICKS).apply({"events": _part(db, 2)}).result()


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND event_id % 10 <> 0")
def ivm_delete(db):
    return live.View.open(db, _CLICKS).apply({"events": _part(db, 3)}).result()


@query("SELECT event_id, value FROM events WHERE event_type = 'click' AND event_id % 10 <> 0 ORDER BY value DESC, event_id LIMIT 40")
def ivm_limit_backfill(db):
    return live.View.open(db, _CLICKS.order("value", "DESC").take(40)).apply({"events": _part(db, 3)}).result()


@query("""SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 0 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 3 <> 0)
ON s_nationkey = n_nationkey""")
def ivm_include(db):
    s = db.catalog.frame("suppliers")
    part = C.make_changes(s.where("s_suppkey % 3 = 0"), "delete", F.lit(1), []).unionByName(C.make_changes(s.where("s_suppkey % 3 = 1").withColumn("s_nationkey", F.lit(0)), "update", F.lit(2), ["s_nationkey"]))
    df = live.View.open(db, Q("nations").include("suppliers")).apply({"suppliers": part}).result()
    return _flat(df, "suppliers", ["n_nationkey"], ["s_suppkey"]).drop("pos")


@query(f"SELECT event_id, value FROM {_AFTER} WHERE event_type IN ('click', 'patched') ORDER BY value DESC, event_id LIMIT 40")
def ivm_after_changes(db):
    view = live.View.open(db, _CLICKS.order("value", "DESC").take(40))
    for n in (3, 2, 1):
        view = view.apply({"events": _part(db, n)})
    return view.result()


@query("""SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000 AND s_suppkey % 3 <> 0 AND s_suppkey % 3 <> 1)
OR n_nationkey = 0 AND EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 5000 AND s_suppkey % 3 = 1)""")
def ivm_exists(db):
    s = db.catalog.frame("suppliers")
    part = C.make_changes(s.where("s_suppkey % 3 = 0"), "delete", F.lit(1), []).unionByName(C.make_changes(s.where("s_suppkey % 3 = 1").withColumn("s_nationkey", F.lit(0)), "update", F.lit(2), ["s_nationkey"]))
    return live.View.open(db, Q("nations").where(exists("suppliers", ("s_acctbal", ">", 5000.0))).select("n_nationkey", "n_name")).apply({"suppliers": part}).result()


# -- sync ------------------------------------------------------------------------------


def _outbox(db):
    """Deletes and patches that were sent, and inserts and one more patch since."""
    e = db.catalog.frame("events")
    more = C.make_changes(e.where("event_id % 10 = 1").withColumn("event_type", F.lit("sent again")), "update", F.lit(1), ["event_type"])
    sent = sync.Outbox().write({"events": _part(db, 3)}).write({"events": _part(db, 2)}).lock()
    return sent.write({"events": _part(db, 1)}).write({"events": more})


def _events_after(where, event_type, value, inserted=True):
    more = "UNION ALL SELECT event_id + 1000000000, event_type, value FROM events WHERE event_id % 10 = 2" if inserted else ""
    return f"SELECT event_id, {event_type} AS event_type, {value} AS value FROM events WHERE {where} {more}"


_SHOWN = Q("events").select("event_id", "event_type", "value")


@query(_events_after("event_id % 10 <> 0", "CASE WHEN event_id % 10 = 1 THEN 'patched' ELSE event_type END", "CASE WHEN event_id % 10 = 1 THEN value + 1 ELSE value END", False))
def outbox_acknowledge(db):
    """What is confirmed after the server's answer."""
    return _outbox(db).acknowledge(db)[1].fetch(_SHOWN)


@query(_events_after("event_id % 10 <> 0", "CASE WHEN event_id % 10 = 1 THEN 'sent again' ELSE event_type END", "CASE WHEN event_id % 10 = 1 THEN value + 1 ELSE value END"))
def outbox_rebase(db):
    """Sending failed: all is sent as one the next time, and the client sees the same."""
    again = _outbox(db).rebase().lock()
    return db.apply_changes(again.to_send(db)).fetch(_SHOWN)


@query(_events_after("true", "CASE WHEN event_id % 10 = 1 THEN 'sent again' ELSE event_type END", "value"))
def outbox_roll_back(db):
    return _outbox(db).roll_back().seen(db).fetch(_SHOWN)


@query("""SELECT 'suppliers' AS collection, s_suppkey AS id, 'delete' AS op FROM supplier WHERE s_nationkey < 3 AND s_acctbal <= 5000
UNION ALL SELECT 'suppliers', s_suppkey, 'insert' FROM supplier WHERE s_nationkey IN (3, 4) AND s_acctbal <= 5000
UNION ALL SELECT 'nations', n_nationkey, 'delete' FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'nations', n_nationkey, 'insert' FROM nation WHERE n_nationkey IN (3, 4)""")
def sync_union_diff(db):
    """A query of one connection moves to other nations; suppliers that another query has too stay."""
    some = lambda *w: sync.entity_frames(db.fetch(Q("nations").where(*w).include("suppliers")), "nations", {"suppliers": ("suppliers", {})})
    rich = sync.entity_frames(db.fetch(Q("suppliers").where("s_acctbal", ">", 5000.0)), "suppliers")
    held, _ = sync.Connection(db).answer("rich", rich)
    held, _ = held.answer("near", some("n_nationkey", "<", 3))
    _, out = held.answer("near", some("n_nationkey", "in", [3, 4]))
    parts = [out[n].select(F.lit(n).alias("collection"), F.col(c).cast("long").alias("id"), "op") for n, c in (("suppliers", "s_suppkey"), ("nations", "n_nationkey"))]
    return parts[0].unionByName(parts[1])


@query("""SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000 AND EXISTS (
SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey < c_nationkey)""")
def rel_value_path(db):
    """The value is a path through a relationship of the parent."""
    return db.fetch(Q("orders").where(("o_totalprice", ">", 300000.0), exists("lines", ("l_suppkey", "<", "$1.customer.c_nationkey"))).select("o_orderkey"))


# -- the rest --------------------------------------------------------------------------


_COUNTED = {n: t for n, t in TABLES.items()} | {"graded": "documents", "contacts": "customer"}
_DISTINCT = {"chats": ("conversations", "conv_id"), "profiles": ("events", "user_id")}


@query(" UNION ALL ".join([f"SELECT '{n}' AS collection, count(*) AS count FROM {t}" for n, t in _COUNTED.items()] + [f"SELECT '{n}', count(DISTINCT {c}) FROM {t}" for n, (t, c) in _DISTINCT.items()]))
def collection_stats(db):
    return db.stats()


@query("SELECT 'regions' AS collection, r_regionkey::VARCHAR AS id FROM region UNION ALL SELECT 'nations', n_nationkey::VARCHAR FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'suppliers', s_suppkey::VARCHAR FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def results_to_entities(db):
    df = db.fetch(Q("regions").include("nations", extend=lambda r: r.include("suppliers")))
    return C.results_to_entities(df, "regions", "r_regionkey", {"nations": ("nations", "n_nationkey", {"suppliers": ("suppliers", "s_suppkey", {})})})


@query("""SELECT c_custkey::VARCHAR AS id, 'contacts' AS collection, 'c_custkey' AS attribute, c_custkey::VARCHAR AS value FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'contacts', 'profile.name', c_name FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'contacts', 'profile.home.c_nationkey', c_nationkey::VARCHAR FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'contacts', 'profile.home.c_mktsegment', c_mktsegment FROM customer""")
def entities_to_triples(db):
    return C.entities_to_triples(db.catalog.frame("contacts"), "contacts", "c_custkey").select("id", "collection", F.array_join("attribute", ".").alias("attribute"), "value")


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","region":{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}}' AS json
FROM nation JOIN region ON r_regionkey = n_regionkey""")
def serialize_json(db):
    return K.serialize(db.fetch(Q("nations").include("region").select("n_nationkey", "n_name")))


@query("""SELECT 'regions' AS collection, r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'regions', r_regionkey + 100, lower(r_name) FROM region
UNION ALL SELECT 'nations', n_nationkey, n_name FROM nation UNION ALL SELECT 'nations', n_nationkey + 100, n_name FROM nation""")
def bulk_insert(db):
    regions = db.catalog.frame("regions").select((F.col("r_regionkey") + 100).alias("r_regionkey"), F.lower("r_name").alias("r_name"))
    nations = db.catalog.frame("nations").withColumn("n_nationkey", F.col("n_nationkey") + 100)
    after = writes.bulk_insert(db, {"regions": regions, "nations": nations})
    parts = [after.fetch(Q(n)).select(F.lit(n).alias("collection"), F.col(i).alias("id"), F.col(c).alias("name")) for n, i, c in (("regions", "r_regionkey", "r_name"), ("nations", "n_nationkey", "n_name"))]
    return parts[0].unionByName(parts[1])


@query("""SELECT doc_id AS id, 'quality' AS attribute, 'missing' AS issue FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'lang', 'enum' FROM documents WHERE lang NOT IN ('en', 'de')""")
def validate_rows(db):
    attrs = {"doc_id": S.number(), "lang": S.string(enum=("en", "de")), "source": S.string(nullable=True), "n_chars": S.number(), "quality": S.number(), "toxic": S.number(optional=True)}
    return writes.violations(db.catalog.frame("graded"), attrs, "doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def schema_check_enum(db):
    return evolve.unsafe_rows(db, evolve.Edit("orders", "o_orderstatus", "enum narrowed", "attribute satisfies enum", ("O", "F"))).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def schema_check_not_null(db):
    return evolve.unsafe_rows(db, evolve.Edit("graded", "quality", "nullable removed", "attribute without null")).select("doc_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND event_id % 10 IN (0, 1)")
def sync_status_pending(db):
    return C.by_sync_status(db.fetch(Q("events").where("event_type", "=", "click")), _event_changes(db), "pending", "event_id").select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND event_id % 10 NOT IN (0, 1)")
def sync_status_confirmed(db):
    return C.by_sync_status(db.fetch(Q("events").where("event_type", "=", "click")), _event_changes(db), "confirmed", "event_id").select("event_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
