"""Relational queries against results that follow from the fixtures."""

import pytest

from tidemark import errors
from tidemark import schema as S
from tidemark.db import Database
from tidemark.plans.ast import Q, and_, exists, or_
from tidemark.sources.catalog import Catalog


@pytest.fixture(scope="module")
def school(spark):
    departments = [("1", "CS", "f1"), ("2", "Math", "f2"), ("3", "English", "f3"), ("4", "History", None)]
    classes = [(f"{d}-{lv}", f"{n} {lv}", lv, b, d) for d, n, b in (("1", "CS", "Voter"), ("2", "Math", "Voter2"), ("3", "English", "Old"), ("4", "History", "Old")) for lv in (101, 201, 301)]
    faculty = [("f1", "Dr. A"), ("f2", "Dr. B"), ("f3", "Dr. C")]
    users = [("u1", "Alice", ["u2", "u3"]), ("u2", "Bob", ["u1"]), ("u3", "Charlie", [])]
    posts = [("p1", "Hello", "u1", ["x", "y"]), ("p2", "World", "u2", ["y"]), ("p3", "Foo", "u1", [])]
    branches = [("a", None), ("b", None), ("c", "a")]
    frames = {
        "departments": spark.createDataFrame(departments, "id string, name string, dept_head_id string"),
        "classes": spark.createDataFrame(classes, "id string, name string, level int, building string, department_id string"),
        "faculty": spark.createDataFrame(faculty, "id string, name string"),
        "users": spark.createDataFrame(users, "id string, name string, friend_ids array<string>"),
        "posts": spark.createDataFrame(posts, "id string, content string, author_id string, topics array<string>"),
        "branches": spark.createDataFrame(branches, "id string, branch_id string"),
    }
    schema = S.Schema.of(
        S.Collection("departments", relationships={"classes": S.many("classes", ("department_id", "=", "$id")), "head": S.by_id("faculty", "$dept_head_id")}),
        S.Collection("classes", relationships={"department": S.by_id("departments", "$department_id")}),
        S.Collection("faculty"),
        S.Collection("users", relationships={"posts": S.many("posts", ("author_id", "=", "$id")), "friends": S.many("users", ("id", "in", "$friend_ids"))}),
        S.Collection("posts", relationships={"author": S.by_id("users", "$author_id")}),
        S.Collection("branches"),
    )
    return Database(Catalog(frames), schema)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_paths_and_exists(school):
    assert ids(school.fetch(Q("departments").where("classes.building", "=", "Voter"))) == ["1"]
    assert sorted(ids(school.fetch(Q("classes").where("department.name", "=", "CS")))) == ["1-101", "1-201", "1-301"]
    assert sorted(ids(school.fetch(Q("classes").where("department.head.name", "like", "dr. b")))) == ["2-101", "2-201", "2-301"]
    both = Q("departments").where(("classes.building", "=", "Old"), ("classes.level", ">", 300))
    assert sorted(ids(school.fetch(both))) == ["3", "4"]
    either = Q("departments").where(or_(("name", "=", "CS"), exists("head", ("name", "=", "Dr. C"))))
    assert sorted(ids(school.fetch(either))) == ["1", "3"]
    mixed = Q("departments").where(or_(and_(exists("classes", ("building", "=", "Old")), ("name", "like", "h%")), exists("head", ("name", "=", "Dr. A"))))
    assert sorted(ids(school.fetch(mixed))) == ["1", "4"]


def test_order_by_relation(school):
    got = ids(school.fetch(Q("classes").order(("department.name", "DESC"), ("name", "ASC"))))
    assert got == [f"{d}-{lv}" for d in "2431" for lv in (101, 201, 301)]
    deep = ids(school.fetch(Q("classes").order(("department.head.name", "ASC"), ("level", "DESC")).take(4)))
    assert deep == ["4-301", "4-201", "4-101", "1-301"]  # no head comes first
    with pytest.raises(errors.InvalidOrderClauseError):
        school.fetch(Q("departments").order("classes.name", "ASC"))


def test_includes(school):
    got = {r["id"]: r for r in school.fetch(Q("departments").include("classes", extend=lambda q: q.order("level", "DESC").take(2).select("level")).include("head")).collect()}
    assert [x["level"] for x in got["1"]["classes"]] == [301, 201]
    assert got["4"]["head"] is None and got["1"]["head"]["name"] == "Dr. A"
    nested = school.fetch(Q("users").include("posts", extend=lambda q: q.include("author")).include("friends")).collect()
    by = {r["id"]: r for r in nested}
    assert [(p["id"], p["author"]["name"]) for p in by["u1"]["posts"]] == [("p1", "Alice"), ("p3", "Alice")]
    assert by["u3"]["posts"] == [] and by["u3"]["friends"] == []
    assert [f["name"] for f in by["u1"]["friends"]] == ["Bob", "Charlie"]
    selected = school.fetch(Q("users").select("name").include("posts", extend=lambda q: q.select("content"))).collect()
    assert selected[0].asDict().keys() == {"name", "posts"}


def test_null_keys(school):
    q = Q("branches").subquery_many("below", Q("branches").where("branch_id", "=", "$1.branch_id").where("id", "!=", "$1.id"))
    got = {r["id"]: [x["id"] for x in r["below"]] for r in school.fetch(q).collect()}
    assert got == {"a": ["b"], "b": ["a"], "c": []}
    assert sorted(ids(school.fetch(Q("branches").where(exists(Q("branches").where("id", "=", "$1.branch_id")))))) == ["c"]


def test_grandparents(school):
    q = Q("users").subquery_many("mine", Q("posts").where("author_id", "=", "$1.id").subquery_many("others", Q("posts").where(("author_id", "=", "$2.id"), ("id", "!=", "$1.id"))))
    got = {r["id"]: {p["id"]: [o["id"] for o in p["others"]] for p in r["mine"]} for r in school.fetch(q).collect()}
    assert got == {"u1": {"p1": ["p3"], "p3": ["p1"]}, "u2": {"p2": []}, "u3": {}}
    deep = Q("users").where(exists(Q("posts").where(("author_id", "=", "$1.id"), exists(Q("users").where(("id", "in", "$2.friend_ids"), ("name", "!=", "$1.content"))))))
    assert sorted(ids(school.fetch(deep))) == ["u1", "u2"]


def test_uncorrelated_and_theta(school):
    assert len(ids(school.fetch(Q("users").where(exists(Q("posts").where("content", "=", "Foo")))))) == 3
    assert ids(school.fetch(Q("users").where(exists(Q("posts").where("content", "=", "none"))))) == []
    assert sorted(ids(school.fetch(Q("users").where(exists(Q("posts").where("author_id", ">", "$1.id")))))) == ["u1"]
    assert ids(school.fetch(Q("branches").where(exists(Q("branches").where("branch_id", "<", "$1.branch_id"))))) == ["c"]
    one = school.fetch(Q("faculty").include("first", Q("users").order("name", "DESC").take(1), "one")).collect()
    assert {r["first"]["name"] for r in one} == {"Charlie"}


def test_cursor_limit_select(school):
    q = Q("classes").order(("building", "ASC"), ("level", "DESC"))
    whole = ids(school.fetch(q))
    first = school.fetch(q.take(5)).collect()
    rest = ids(school.fetch(q.after((first[-1]["building"], first[-1]["level"]))))
    assert [r["id"] for r in first] + [i for i in rest if i not in whole[:5]] == whole[: 5 + len(rest)] or set(rest) < set(whole)
    assert ids(school.fetch(Q("users").take(0))) == [] and ids(school.fetch(Q("users").take(2))) == ["u1", "u2"]
    assert school.fetch_by_id("users", "u2")["name"] == "Bob" and school.fetch_by_id("users", "zz") is None
    for bad, error in (
        (Q("users").after(("x",)), errors.InvalidAfterClauseError),
        (Q("users").order("name", "ASC").after((1, 2)), errors.InvalidAfterClauseError),
        (Q("posts").order("author.name", "ASC").after(("x",)), errors.InvalidAfterClauseError),
        (Q("users").take(-1), errors.InvalidLimitError),
        (Q("users").select("posts"), errors.InvalidSelectClauseError),
        (Q("users").select("nope"), errors.InvalidSelectClauseError),
        (Q("users").include("nope"), errors.RelationNotFoundError),
        (Q("users").order("friend_ids", "ASC"), errors.InvalidOrderClauseError),
        (Q("users").where(exists("nope")), errors.RelationNotFoundError),
        (Q("users").where("posts", "=", 1), errors.InvalidFilterError),
    ):
        with pytest.raises(error):
            school.fetch(bad)


def test_builder_is_immutable():
    base = Q("a").where("x", "=", 1)
    assert base.where("y", "=", 2).filters != base.filters and len(base.filters) == 1
    assert base.order("x", "ASC").order("y", "DESC").ordering == (("x", "ASC"), ("y", "DESC"))
    assert base.select("x").select("y").selected == ("y",) and base.where(None) == base
    assert Q("a").by_id("1").by_id(["2"]).filters == Q("a").by_id(["2"]).filters


def test_permissions(school):
    own = S.Schema.of(
        S.Collection("users", permissions={"user": {"read": (or_(("id", "=", "$role.user_id"), ("friend_ids", "has", "$role.user_id")),)}}),
        S.Collection("posts", relationships={"author": S.by_id("users", "$author_id")}, permissions={"user": {"read": (exists("author"),), "insert": (("author_id", "=", "$role.user_id"),)}}),
        roles={"user": {"role": "user", "user_id": "$user_id"}},
    )
    db = Database(school.catalog, own)
    me = db.with_session({"role": "user", "user_id": "u2"})
    assert sorted(ids(me.fetch(Q("users")))) == ["u1", "u2"]
    assert sorted(ids(me.fetch(Q("posts")))) == ["p1", "p2", "p3"]
    assert sorted(ids(db.with_session({"role": "user", "user_id": "u3"}).fetch(Q("posts")))) == ["p1", "p3"]
    assert ids(db.with_session({"role": "other"}).fetch(Q("users"))) == []
    assert len(ids(db.with_session({"role": "other"}, skip_rules=True).fetch(Q("users")))) == 3


def test_variables(school):
    assert ids(school.fetch(Q("users").vars(n="Bob").where("name", "=", "$query.n"))) == ["u2"]
    assert ids(school.fetch(Q("users").where("name", "=", "$query.n"))) == []
    assert ids(school.with_globals(n="Bob").fetch(Q("users").where("name", "=", "$global.n"))) == ["u2"]
    s = school.with_session({"who": {"name": "Alice"}, "scope": "a b"})
    assert ids(s.fetch(Q("users").where("name", "=", "$session.who.name"))) == ids(s.fetch(Q("users").where("name", "=", "$token.who.name"))) == ["u1"]
    assert s.claims["_scope"] == ["a", "b"]


def test_roles():
    assert S.match_role({"a": "$x", "b": {"c": "$y"}}, {"a": 1, "b": {"c": 2}, "z": 0}) == {"x": 1, "y": 2}
    assert S.match_role({"a": "$x", "b": "$x"}, {"a": 1, "b": 2}) is None and S.match_role({"a": "$x"}, {}) is None


def test_catalogue_registers_sql_for_each_query():
    from tidemark import catalogue

    assert catalogue.queries().keys() == catalogue.oracle_sql().keys()
