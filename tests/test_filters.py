"""Filter operators against golden results and against the rules written in plain Python."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark import schema as S
from tidemark.db import Database
from tidemark.plans.ast import Q, and_, exists, normalize, or_, simplified
from tidemark.sources.catalog import Catalog


def db_of(spark, values, kind, attr=None):
    rows = [(f"id{i}", v, i) for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, f"id string, attr {kind}, idx int")
    return Database(Catalog({"test": frame}), S.Schema.of(S.Collection("test", {"attr": attr} if attr else {})))


def hits(db, *filters):
    return sorted(r["idx"] for r in db.fetch(Q("test").where(*filters)).collect())


NUMBERS = [1.0, 2.0, 2.0, 3.0, 4.0, None, None]
SHORT = [1.0, 2.0, 3.0, 4.0, None]


@pytest.mark.parametrize(
    ("values", "op", "value", "want"),
    [
        (NUMBERS, "=", 2, [1, 2]), (NUMBERS, "=", None, [5, 6]), (NUMBERS[:5], "=", None, []),
        (NUMBERS, "!=", 2, [0, 3, 4, 5, 6]), (NUMBERS, "!=", None, [0, 1, 2, 3, 4]),
        (SHORT, ">", 2, [2, 3]), (SHORT, ">", None, [0, 1, 2, 3]), (SHORT, ">=", 2, [1, 2, 3]), (SHORT, ">=", None, [0, 1, 2, 3, 4]),
        (SHORT, "<", 3, [0, 1, 4]), (SHORT, "<", None, []), (SHORT, "<=", 3, [0, 1, 2, 4]), (SHORT, "<=", None, [4]),
        (NUMBERS[:5], "in", [2, 4], [1, 2, 4]), (NUMBERS, "in", [], []), (NUMBERS, "in", None, []),
        (SHORT, "nin", [2, 4], [0, 2, 4]), (SHORT, "nin", [], [0, 1, 2, 3, 4]), (SHORT, "nin", [2, None], [0, 2, 3, 4]), (SHORT, "nin", None, [0, 1, 2, 3, 4]),
        (SHORT, "isDefined", True, [0, 1, 2, 3]), (SHORT, "isDefined", False, [4]),
    ],
)
def test_number_golden(spark, values, op, value, want):
    assert hits(db_of(spark, values, "double"), "attr", op, value) == want


def test_like(spark):
    values = ["Ford", "ford F-150", "É.a", "a\nb", "a_b", "a%b", None, "", "back\\slash", "a\n"]
    db = db_of(spark, values, "string")
    cases = {"ford%": [0, 1], "%o_d": [0], "é.%": [2], "é_a": [2], "%": [0, 1, 2, 4, 5, 7, 8], "a_b": [4, 5], "a": [], "": [7], "back\\%": [8], None: []}
    for pattern, want in cases.items():
        assert hits(db, "attr", "like", pattern) == want, pattern
        assert hits(db, "attr", "nlike", pattern) == [i for i in range(len(values)) if i not in want], pattern


def test_sets(spark):
    db = db_of(spark, [["a", "b"], ["b", "c"], ["c", "d"], None, []], "array<string>")
    assert hits(db, "attr", "has", "b") == hits(db, "attr", "=", "b") == [0, 1]
    assert hits(db, "attr", "has", None) == []
    assert hits(db, "attr", "!has", "b") == [2, 3, 4]
    assert hits(db, "attr", "in", ["a", "d"]) == [0, 2]
    assert hits(db, "attr", "!=", "a") == [0, 1, 2]
    assert hits(db, "attr", "isDefined", False) == [3]
    assert hits(db, "attr", ">", "c") == [2]
    assert hits(db, "attr", "like", "A") == [0]
    numbers = db_of(spark, [[1.0, 2.0], [3.0], None], "array<double>")
    assert hits(numbers, "attr", "in", [2, 9]) == [0] and hits(numbers, "attr", ">=", 2) == [0, 1]


def test_dates(spark):
    days = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)] + [None]
    for kind in ("timestamp", "timestamp_ntz"):
        db = db_of(spark, days, kind)
        assert hits(db, "attr", ">", "2024-01-01") == [1, 2]
        assert hits(db, "attr", "<=", datetime.datetime(2024, 1, 2)) == [0, 1, 3]
        assert hits(db, "attr", "=", "2024-01-03") == [2]


def test_json(spark):
    values = ['{"a": 5}', '{"a": "5"}', '{"a": true}', '{"a": null}', "{}", '{"a": {"b": 1}}', '{"a": [1, "x"]}', None, "not json", '{"a": 7.5}']
    db = db_of(spark, values, "string", S.json())
    assert hits(db, "attr.a", "=", 5) == [0]
    assert hits(db, "attr.a", "=", "5") == [1]
    assert hits(db, "attr.a", "=", True) == [2]
    assert hits(db, "attr.a", ">", 5) == [1, 2, 9]  # strings and booleans are above numbers
    assert hits(db, "attr.a", "<", 6) == [0, 3, 4, 5, 6, 7, 8]
    assert hits(db, "attr.a", "isDefined", False) == [3, 4, 7, 8]
    assert hits(db, "attr.a", "in", [5, "5"]) == [0, 1] and 0 not in hits(db, "attr.a", "nin", [5])
    assert hits(db, "attr.a.b", "=", 1) == [5]
    assert hits(db, "attr.a", "has", "x") == [6]
    assert hits(db, "attr.a", "like", "5%") == [1]


def test_json_order(spark):
    db = db_of(spark, ["1", '"2"', "3"], "string", S.json())
    order = lambda d: [r["idx"] for r in d.fetch(Q("test").order("attr", "ASC")).collect()]
    assert order(db) == [0, 2, 1]
    assert order(db_of(spark, ["1", "{}", "3"], "string", S.json())) == [1, 0, 2]


# -- random filters against the rules in plain Python ---------------------------------


def rule(op, c, v):
    if op == "isDefined":
        return (c is not None) == bool(v)
    if op in ("in", "nin"):
        hit = c is not None and v is not None and c in [x for x in v if x is not None]
        return hit if op == "in" else not hit
    if op in ("like", "nlike"):
        hit = c is not None and v is not None and re.fullmatch("".join(".*" if x == "%" else "." if x == "_" else re.escape(x) for x in v), c, re.I) is not None
        return hit if op == "like" else not hit
    rank = lambda x: (x is not None, x)
    equal = c == v
    if op in ("=", "!="):
        return equal if op == "=" else not equal
    less = not equal and (c is None or (v is not None and rank(c) < rank(v)))
    if op in ("<", "<="):
        return less or (equal and op == "<=")
    return not less and (not equal or op == ">=")


def random_filter(rng, depth=0):
    if depth < 2 and rng.random() < 0.4:
        return (rng.choice([and_, or_]))(*[random_filter(rng, depth + 1) for _ in range(rng.randint(1, 3))])
    if rng.random() < 0.05:
        return rng.random() < 0.5
    if rng.random() < 0.5:
        op = rng.choice(["=", "!=", "<", "<=", ">", ">=", "in", "nin", "isDefined"])
        v = rng.sample([1, 2, 3, None], 2) if "in" in op and op != "isDefined" else rng.choice([True, False]) if op == "isDefined" else rng.choice([1, 2, 3, 4, None])
        return ("n", op, v)
    op = rng.choice(["=", "!=", "<", ">", ">=", "<=", "like", "nlike", "in", "nin"])
    v = rng.sample(["a", "ab", "B", None], 2) if op in ("in", "nin") else rng.choice(["a%", "_b", "%", "B", None]) if "like" in op else rng.choice(["a", "ab", "B", None])
    return ("s", op, v)


def evaluate(f, row):
    from tidemark.plans.ast import Cond, Group

    if isinstance(f, bool):
        return f
    if isinstance(f, Group):
        got = [evaluate(x, row) for x in f.filters]
        return all(got) if f.mode == "and" else any(got) if got else True
    assert isinstance(f, Cond)
    return rule(f.op, row[f.path], f.value)


def test_random_filters(spark):
    rng = random.Random(11)
    rows = [(f"{i}-{s}", n, s) for i, n in enumerate([1, 2, 3, 4, None]) for s in ["a", "ab", "B", "b", "", None]]
    frame = spark.createDataFrame(rows, "id string, n int, s string").cache()
    db = Database(Catalog({"t": frame}))
    for _ in range(60):
        f = random_filter(rng)
        (tree,) = normalize([f])
        want = sorted(i for i, n, s in rows if evaluate(tree, {"n": n, "s": s}))
        assert sorted(r["id"] for r in db.fetch(Q("t").where([f])).collect()) == want, f
        plain = db.fetch(Q("t").where([f]))
        assert plain.count() == len(want)


def test_simplified():
    a, b = ("x", "=", 1), ("y", "=", 2)
    n = lambda *f: normalize(f)
    assert simplified(n(and_(a, and_(b, True)), [a])) == n([a], [b])
    assert simplified(n(or_(a, True))) == () and simplified(n(and_(a, False))) == (False,)
    assert simplified(n(or_(or_(a, b), [a]))) == (or_(a, b),)
    assert simplified(n(or_())) == () and simplified(n(or_(False, False))) == (False,)
    assert simplified(n(exists(Q("c").where(False)))) == (False,)


def test_invalid_filters(spark):
    db = db_of(spark, [1.0], "double")
    for bad in (("attr", "like", "x"), ("nope", "=", 1), ("attr", "has", 1), ("attr", "in", 5)):
        with pytest.raises(errors.InvalidFilterError):
            db.fetch(Q("test").where(*bad))
    with pytest.raises(errors.InvalidFilterError):
        Q("test").where([("attr", "~", 1)])
    with pytest.raises(errors.CollectionNotFoundError):
        db.fetch(Q("nothing"))


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string"), F.col("id").alias("n"), F.lit("x").alias("wide")).write.parquet(f"{tmp_path}/t.parquet")
    db = Database(Catalog.parquet(spark, str(tmp_path), {"t": "t"}))
    plan = db.fetch(Q("t").where(("n", ">", 3), ("id", "in", ["4", "5"])).select("id"))._jdf.queryExecution().toString()
    assert "GreaterThan(n,3)" in plan and "In(id, [4,5])" in plan and "wide" not in plan[plan.index("ReadSchema") :]
