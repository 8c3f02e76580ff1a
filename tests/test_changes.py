"""Changes, writes, live queries and schema evolution."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark import schema as S
from tidemark.db import Database
from tidemark.operators import changes as C
from tidemark.operators import evolve, sync, writes
from tidemark.operators.clock import HybridClock, stamp_column
from tidemark.plans.ast import Q, exists, identity
from tidemark.plans.compile import Compiler
from tidemark.plans.prepare import with_evidence
from tidemark.sources import catalog as K
from tidemark.streaming import live

KIND = "id string, g string, n int"


def replay(base, changes):
    """The rules one change at a time."""
    state = {r[0]: dict(zip(("id", "g", "n"), r)) for r in base}
    for seq, op, fields, *row in sorted(changes):
        i, new = row[0], dict(zip(("id", "g", "n"), row))
        if op == "delete":
            state.pop(i, None)
        elif op == "insert" or i in state:
            state.setdefault(i, {"id": i, "g": None, "n": None}).update({f: new[f] for f in fields if f != "id"})
    return sorted(tuple(v.values()) for v in state.values())


def random_changes(rng, n, known):
    out = []
    for seq in range(n):
        i = rng.choice(known)
        op = rng.choice(["insert", "update", "update", "delete"])
        fields = [] if op == "delete" else sorted({"id", *rng.sample(["g", "n"], rng.randint(0, 2))}) if op == "insert" else rng.sample(["g", "n"], rng.randint(1, 2))
        out.append((seq, op, fields, i, rng.choice(["a", "b", None]), rng.randint(0, 9)))
    return out


SCHEMA = "seq long, op string, fields array<string>, " + KIND


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_overlay_by_replay(spark):
    rng = random.Random(5)
    for _ in range(12):
        base = [(f"i{k}", rng.choice(["a", "b", None]), k) for k in range(6)]
        changes = random_changes(rng, 14, [f"i{k}" for k in range(9)])
        frame = spark.createDataFrame(base, KIND)
        part = spark.createDataFrame(changes, SCHEMA)
        want = sorted(replay(base, changes), key=str)
        assert rows(C.overlay(frame, part)) == want
        first, second = part.where("seq < 7"), part.where("seq >= 7")
        assert rows(C.overlay(C.overlay(frame, first), second)) == want


def test_merge_is_the_same_as_one_after_the_other(spark):
    base = [("x", "a", 1), ("y", "b", 2), ("z", "c", 3)]
    one = [(1, "update", ["g"], "x", "new", None), (2, "delete", [], "y", None, None), (3, "insert", ["id", "n"], "w", None, 5)]
    two = [(1, "update", ["n"], "x", None, 8), (2, "insert", ["id", "g"], "y", "again", None), (3, "delete", [], "w", None, None)]
    frame, a, b = spark.createDataFrame(base, KIND), spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA)
    want = rows(C.overlay(C.overlay(frame, a), b))
    # y was deleted and came back, so that what it was is not to be seen
    assert ("x", "new", 8) in want and ("y", "again", None) in want and not any(r[0] == "w" for r in want)
    merged = C.merge_changes(a, b)
    assert {r["id"]: r["op"] for r in merged.collect()} == {"x": "update", "y": "insert", "w": "delete"}
    assert rows(C.outbox_overlay(frame, a, b)) == want


def test_diff_and_sets(spark):
    a, b = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), ("3", None, 3)], KIND), spark.createDataFrame([("2", "b", 5), ("3", None, 3), ("4", "d", 4)], KIND)
    assert rows(C.diff(a, b)) == [("1", "delete", ["g", "n"]), ("2", "update", ["n"]), ("4", "insert", ["g", "n"])]
    df = spark.createDataFrame([({"a": True, "b": True}, ["b", "c"])], "old map<string,boolean>, members array<string>")
    patch = C.set_assignment(F.col("old"), F.col("members"))
    row = df.select(patch.alias("p"), C.set_members(C.merge_set(F.col("old"), patch)).alias("m")).first()
    assert row["p"] == {"a": False, "b": True, "c": True} and row["m"] == ["b", "c"]


def test_stamps(spark):
    base = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], KIND)
    stamps = spark.createDataFrame([("1", (10, 0, "c")), ("2", (10, 0, "c"))], "id string, stamp struct<ms:bigint,logical:int,client:string>")
    changes = [(0, "update", ["n"], "1", None, 7, (10, 0, "b")), (0, "update", ["n"], "2", None, 8, (10, 1, "a")), (0, "insert", ["id", "g"], "3", "new", None, (1, 0, "a"))]
    part = spark.createDataFrame(changes, SCHEMA + ", stamp struct<ms:bigint,logical:int,client:string>")
    after, held = C.apply_stamped(base, stamps, part)
    assert rows(after) == [("1", "a", 1), ("2", "b", 8), ("3", "new", None)]
    assert {r["id"]: tuple(r["stamp"]) for r in held.collect()} == {"1": (10, 0, "c"), "2": (10, 1, "a"), "3": (1, 0, "a")}


@pytest.fixture
def shop(spark):
    items = spark.createDataFrame([(f"i{k}", "ab"[k % 2], k) for k in range(8)], KIND)
    groups = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, name string")
    schema = S.Schema.of(
        S.Collection("items", {"id": S.identifier(), "g": S.string(nullable=True, enum=("a", "b", "c")), "n": S.number(default=0)}),
        S.Collection("groups", {"id": S.identifier(), "name": S.string()}, relationships={"items": S.many("items", ("g", "=", "$id"))}),
    )
    return Database(K.Catalog({"items": items, "groups": groups}), schema)


QUERIES = (
    Q("items").where("g", "=", "a"),
    Q("items").where("n", ">", 3).order("n", "DESC"),
    Q("items").where("g", "!=", "c").order(("g", "ASC"), ("n", "DESC")).take(3),
    Q("items").take(2).select("n"),
    Q("groups").include("items"),
    Q("groups").include("items", extend=lambda r: r.order("n", "DESC").take(2)).order("name", "DESC"),
    Q("groups").where(exists("items", ("n", ">", 5))),
    Q("groups").where(exists("items", ("n", ">", 5))).include("items").order("name", "DESC"),
)


def test_kept_results_equal_fetches(spark, shop):
    rng = random.Random(3)
    for q in QUERIES:
        view = live.View.open(shop, q)
        for _ in range(2):
            part = spark.createDataFrame(random_changes(rng, 6, [f"i{k}" for k in range(11)]), SCHEMA)
            view = view.apply({"items": part})
        got, want = view.result().collect(), view.db.fetch(q).collect()
        if not q.ordering and q.limit is None:
            got, want = sorted(got, key=str), sorted(want, key=str)
        assert got == want, q


def test_stream(spark, shop, tmp_path):
    parts = [(0, "insert", ["id", "g", "n"], "new", "a", 50), (1, "delete", [], "i7", None, None)]
    for k, p in enumerate(parts):
        spark.createDataFrame([p], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    seen = []
    running = live.live_query(shop, Q("items").order("n", "DESC").take(3), "items", stream, f"{tmp_path}/state", lambda df, d: seen.append(([r["id"] for r in df.collect()], d.count())), availableNow=True)
    running.awaitTermination(60)
    assert seen[-1][0] == ["new", "i6", "i5"] and len(seen) >= 1


def test_pages(shop):
    q = Q("items").order("n", "ASC")
    one = live.page(shop, q, 3)
    two = live.page(shop, q, 3, one.last)
    assert [r["n"] for r in one.rows.collect()] == [0, 1, 2] and one.has_next and not one.has_previous
    assert [r["n"] for r in two.rows.collect()] == [3, 4, 5] and two.has_next and two.has_previous
    back = live.page(shop, q, 3, two.first, backwards=True)
    assert [r["n"] for r in back.rows.collect()] == [0, 1, 2] and not back.has_previous
    more, has = live.expanding(shop, q, 6)
    assert more.count() == 6 and has


def test_transactions(spark, shop):
    tx = writes.Transaction.begin(shop).insert("items", spark.createDataFrame([("x", "a")], "id string, g string"))
    assert tuple(tx.db.fetch_by_id("items", "x")) == ("x", "a", 0) and shop.fetch_by_id("items", "x") is None
    tx = tx.update("items", spark.createDataFrame([("x", 9.0), ("none", 1.0)], "id string, n double")).delete("items", spark.createDataFrame([("i0",)], "id string"))
    after = tx.commit()
    assert after.fetch_by_id("items", "x")["n"] == 9 and after.fetch_by_id("items", "i0") is None and after.fetch_by_id("items", "none") is None
    assert tx.delete_all("items").fetch(Q("items")).count() == 0
    with pytest.raises(errors.ValidationError):
        tx.insert("items", spark.createDataFrame([("y", "zzz")], "id string, g string"))
    with pytest.raises(errors.ValidationError):
        tx.update("items", spark.createDataFrame([("x", 1)], "id string, nope int"))
    made = writes.with_defaults(spark.createDataFrame([("a",), ("b",)], "g string"), shop.schema.collections["items"].attrs).collect()
    assert len({r["id"] for r in made}) == 2 and all(len(r["id"]) == 21 for r in made)


def test_write_permissions(spark, shop):
    rules = {"user": {"read": (True,), "insert": (("g", "=", "$role.g"),), "update": (("g", "=", "$role.g"),), "postUpdate": (("n", "<", 100),), "delete": (False,)}}
    schema = S.Schema.of(S.Collection("items", permissions=rules), S.Collection("groups"), roles={"user": {"g": "$g"}})
    tx = writes.Transaction.begin(Database(shop.catalog, schema).with_session({"g": "a"}))
    tx.insert("items", spark.createDataFrame([("q", "a", 1)], KIND))
    tx.update("items", spark.createDataFrame([("i0", 5)], "id string, n int"))
    for bad in (
        lambda: tx.insert("items", spark.createDataFrame([("q", "b", 1)], KIND)),
        lambda: tx.update("items", spark.createDataFrame([("i1", 5)], "id string, n int")),
        lambda: tx.update("items", spark.createDataFrame([("i0", 500)], "id string, n int")),
        lambda: tx.delete("items", spark.createDataFrame([("i0",)], "id string")),
    ):
        with pytest.raises(errors.WritePermissionError):
            bad()


def test_previous_state_in_rules(spark, shop):
    rules = {"user": {"update": (True,), "postUpdate": (("n", ">", "$prev.n"),)}}
    db = Database(shop.catalog, S.Schema.of(S.Collection("items", permissions=rules), S.Collection("groups"), roles={"user": {"g": "$g"}})).with_session({"g": "a"})
    assert db.update("items", spark.createDataFrame([("i3", 4)], "id string, n int")).with_session(None, skip_rules=True).fetch_by_id("items", "i3")["n"] == 4
    with pytest.raises(errors.WritePermissionError):
        db.update("items", spark.createDataFrame([("i3", 2)], "id string, n int"))


def test_subscriptions(spark, shop):
    heard = {"items": [], "groups": []}
    subs = live.Subscriptions(shop)
    end = subs.subscribe(Q("items").where("g", "=", "a").order("n", "ASC"), lambda df: heard["items"].append([r["id"] for r in df.collect()]))
    subs.subscribe(Q("groups"), lambda df: heard["groups"].append(df.count()))
    subs.buffer({"items": spark.createDataFrame([(1, "insert", ["id", "g", "n"], "z", "a", 1)], SCHEMA)})
    subs.buffer({"items": spark.createDataFrame([(1, "insert", ["id", "g", "n"], "y", "b", 1)], SCHEMA)})
    assert len(heard["items"]) == 1
    subs.update()
    assert heard["items"] == [["i0", "i2", "i4", "i6"], ["i0", "z", "i2", "i4", "i6"]] and heard["groups"] == [3]
    end()
    subs.buffer({"items": spark.createDataFrame([(1, "delete", [], "z", None, None)], SCHEMA)})
    subs.update()
    assert len(heard["items"]) == 2 and subs.db.fetch_by_id("items", "z") is None and subs.db.clear().fetch(Q("items")).count() == 0


def test_clock_and_identity(spark, shop):
    times = iter([5, 5, 3, 9])
    clock = HybridClock("c", now=lambda: next(times))
    got = [clock.next(), clock.next(), clock.next()]
    clock.observe((20, 0, "other"))
    got.append(clock.next())
    assert got == sorted(got) == [(5, 0, "c"), (5, 1, "c"), (5, 2, "c"), (20, 1, "c")]
    assert spark.range(1).select(stamp_column(got[0]) < stamp_column(got[1])).first()[0]
    a, b = ("x", "=", 1), ("y", "=", 2)
    assert identity(Q("t").where(a).where(b).select("p", "q")) == identity(Q("t").where(b).where(a).select("q", "p")) != identity(Q("t").where(a).select("q", "p"))
    assert identity(Q("t").order("x", "ASC")) != identity(Q("t").order("x", "DESC"))
    q = with_evidence(shop.prepared(Q("groups").where(exists("items", ("n", ">", 5)))))
    rows_ = Compiler(shop.catalog.frame, shop.context()).compile(q).collect()
    assert {r["id"]: [x["id"] for x in r["_exists_0"]] for r in rows_} == {"a": ["i6"], "b": ["i7"]}


def test_evolution(shop):
    items, groups = shop.schema.collections["items"], shop.schema.collections["groups"]
    change = lambda **attrs: S.Schema.of(S.Collection("items", {**items.attrs, **attrs}), groups)
    assert evolve.override_schema(shop, change(extra=S.string(nullable=True))).code == "SUCCESS"
    assert evolve.override_schema(shop, change(g=S.string(nullable=True, enum=("a",)))).code == "EXISTING_DATA_MISMATCH"
    narrowed = change(g=S.string(nullable=True, enum=("a", "b")))
    assert evolve.override_schema(shop, narrowed).code == "SCHEMA_COMPATIBILITY_MISMATCH"
    assert evolve.override_schema(shop, narrowed, fail_on_incompatible=False).code == "SUCCESS"
    assert evolve.override_schema(shop, change(bad=S.Attr("set", of="json"))).code == "SCHEMA_INVALID"
    assert evolve.override_schema(shop, change(must=S.number())).code == "EXISTING_DATA_MISMATCH"
    kinds = {e.change for e in evolve.diff_schemas(shop.schema, S.Schema.of(S.Collection("items", {"id": S.identifier(), "g": S.number()})))}
    assert kinds == {"collection removed", "type changed", "required attribute removed"}
    assert S.json_schema(shop.schema)["properties"]["items"]["properties"]["g"] == {"type": ["string", "null"], "enum": ["a", "b", "c"]}
    with pytest.raises(errors.SchemaError):
        S.checked(S.Schema.of(S.Collection("1bad", relationships={"r": S.many("none")})))


def test_files(spark, shop, tmp_path):
    K.write_snapshot(shop.catalog, f"{tmp_path}/s", S.json_schema(shop.schema))
    back = K.read_snapshot(spark, f"{tmp_path}/s", {n: shop.catalog.types(n) for n in ("items", "groups")})
    assert rows(back.frame("items")) == rows(shop.catalog.frame("items"))
    (tmp_path / "bulk.json").write_text('{"items": [{"id": "z", "g": "a", "n": 1}], "groups": []}')
    bulk = K.read_bulk(spark, f"{tmp_path}/bulk.json", {n: shop.catalog.types(n) for n in ("items", "groups")})
    assert writes.bulk_insert(shop, bulk).fetch_by_id("items", "z")["g"] == "a"
    df = shop.fetch(Q("groups").include("items"))
    again = K.deserialize(K.serialize(df), df.schema)
    assert sorted(again.collect(), key=str) == sorted(df.collect(), key=str)
    assert {r["collection"]: r["count"] for r in shop.stats().collect()} == {"items": 8, "groups": 3}
    found = rows(C.results_to_entities(df, "groups", "id", {"items": ("items", "id", {})}))
    assert len(found) == 11
    triples = C.entities_to_triples(shop.catalog.frame("groups"), "groups", "id").collect()
    assert ("a", "groups", ["name"], "A", None) in [tuple(t) for t in triples]


RECORD = "id string, g string, p struct<a:int,b:string,c:struct<x:int,y:int>>"


def replay_records(base, changes):
    """The rules for records one change at a time; a change is (op, id, [(path, value)])."""
    state = {k: {"id": k, **v} for k, v in base.items()}
    for op, i, sets in changes:
        if op == "delete":
            state.pop(i, None)
            continue
        if op == "update" and i not in state:
            continue
        row = state.setdefault(i, {"id": i, "g": None, "p": None})
        for path, value in sets:
            at, (*above, leaf) = row, path.split(".")
            for part in above:
                if at[part] is None:
                    at[part] = {"p": {"a": None, "b": None, "c": None}, "c": {"x": None, "y": None}}[part]
                at = at[part]
            at[leaf] = value
    return state


def test_records_merge_by_replay(spark):
    rng = random.Random(8)
    record = lambda: rng.choice([None, {"a": rng.randint(0, 9), "b": rng.choice(["s", None]), "c": rng.choice([None, {"x": 1, "y": None}])}])
    values = {"g": lambda: rng.choice(["a", None]), "p": record, "p.a": lambda: rng.choice([None, 5]), "p.b": lambda: "n", "p.c": lambda: rng.choice([None, {"x": 7, "y": 8}]), "p.c.x": lambda: rng.choice([None, 3])}
    base = {f"i{k}": {"g": "a", "p": record()} for k in range(5)}
    changes = []
    for _ in range(60):
        path = rng.choice(list(values))
        changes.append((rng.choice(["insert", "update", "update", "update", "delete"]), f"i{rng.randint(0, 7)}", [(path, values[path]())]))
    frame = spark.createDataFrame([(k, v["g"], v["p"]) for k, v in base.items()], RECORD)
    rows_ = []
    for seq, (op, i, sets) in enumerate(changes):
        row = replay_records({i: {"g": None, "p": None}}, [("update", i, sets)])[i]
        rows_.append((seq, op, [] if op == "delete" else [p for p, _ in sets], i, row["g"], row["p"]))
    part = spark.createDataFrame(rows_, "seq long, op string, fields array<string>, " + RECORD)
    want = sorted(map(str, (tuple(v.values()) for v in replay_records(base, changes).values())))
    plain = lambda df: sorted(str((r["id"], r["g"], r["p"].asDict(True) if r["p"] is not None else None)) for r in df.collect())
    assert plain(C.overlay(frame, part)) == want
    first, second = part.where("seq < 25"), part.where("seq >= 25")
    assert plain(C.overlay(frame, first, second)) == want
    assert plain(C.overlay(frame, C.merge_changes(first, second))) == want
    assert plain(C.overlay(C.overlay(frame, first), C.effective(C.overlay(frame, first), second))) == want


def test_defaults_are_stored(spark):
    attrs = {"id": S.identifier("uuidv7"), "t": S.date(default={"fn": "now"}), "u": S.string(default={"fn": "uuidv4"}), "k": S.string(default={"fn": "nanoid", "args": [9]}), "n": S.number(default=4.0), "s": S.set_of("string", default={"fn": "empty"})}
    schema = S.Schema.of(S.Collection("t", attrs))
    db = Database(K.Catalog({"t": K.empty(spark, schema, "t")}), schema).insert("t", spark.range(50).select())
    one, two = rows(db.fetch(Q("t"))), rows(db.fetch(Q("t")))
    assert one == two and len({r[0] for r in one}) == 50 == len({r[2] for r in one}) and len({r[1] for r in one}) == 1
    for i, t, u, k, n, s in one:
        assert i[14] == "7" and i[19] in "89ab" and u[14] == "4" and len(k) == 9 and n == 4.0 and s == []
        assert abs(int(i.replace("-", "")[:12], 16) / 1000 - t.timestamp()) < 0.002


def test_patches_of_records_and_functions(spark):
    contact = S.record({"name": S.string(), "age": S.number(nullable=True)})
    schema = S.Schema.of(S.Collection("c", {"id": S.string(), "p": contact}))
    db = Database(K.Catalog({"c": spark.createDataFrame([("1", ("a", 3.0)), ("2", ("b", 4.0))], "id string, p struct<name:string,age:double>")}), schema)
    get = lambda d: {r["id"]: tuple(r["p"]) for r in d.fetch(Q("c")).collect()}
    assert get(db.update("c", spark.createDataFrame([("1", (9.0,))], "id string, p struct<age:double>"))) == {"1": ("a", 9.0), "2": ("b", 4.0)}
    assert get(db.update("c", spark.createDataFrame([("1", (None,))], "id string, p struct<age:double>"))) == {"1": ("a", None), "2": ("b", 4.0)}
    tx = writes.Transaction.begin(db)
    assert get(tx.update("c", spark.createDataFrame([("2", ("z",))], "id string, p struct<name:string>"), whole=("p",)).commit()) == {"1": ("a", 3.0), "2": ("z", None)}
    assert get(db.update_where("c", ("p.age", ">", 3.0), {"p.age": F.col("p.age") * 2})) == {"1": ("a", 3.0), "2": ("b", 8.0)}
    for bad in (lambda: db.update("c", spark.createDataFrame([("1", (None,))], "id string, p struct<name:string>")), lambda: db.update_where("c", (), {"id": "9"})):
        with pytest.raises(errors.TidemarkError):
            bad()


def test_many_writes_stay_one_join(spark, shop):
    db = shop
    for k in range(12):
        db = db.insert("items", spark.createDataFrame([(f"n{k}", "a", k)], KIND))
    assert db.fetch(Q("items")).count() == 20
    plan = db.fetch(Q("items"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and len(db.catalog._parts["items"][1]) <= K.MOST_PARTS + 1


def test_live_plans_reduce_the_collection_first(spark, shop):
    view = live.View.open(shop, Q("items").where("n", ">", 1).order("n", "DESC").take(3))
    for k in range(10):
        view = view.apply({"items": spark.createDataFrame([(k, "update", ["n"], f"i{k % 8}", None, k)], SCHEMA)})
    assert view.rows.collect() == view.db.fetch(view.query.select()).collect()
    assert view.rows._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # it is written
    ids = spark.createDataFrame([("i1",)], "id string")
    some = view.db.catalog.some("items", ids, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert some.index("Join FullOuter") < some.index("Join LeftSemi")  # the reduction is below the join with the changes


def test_stream_folder_does_not_grow(spark, shop, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT", 3)
    for k in range(8):
        spark.createDataFrame([(0, "insert", ["id", "g", "n"], f"new{k}", "a", 50 + k)], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    seen = []
    running = live.live_query(shop, Q("items").where("g", "=", "a"), "items", stream, f"{tmp_path}/state", lambda df, d: seen.append(df.count()), availableNow=True)
    running.awaitTermination(120)
    assert running.exception() is None and seen == list(range(5, 13))
    left = sorted(p.name for p in (tmp_path / "state").iterdir() if p.name != "checkpoint")
    assert len(left) <= 2 * 3 + 3, left


def test_status_and_background(spark, shop):
    heard = []
    subs = live.Subscriptions(shop)
    subs.subscribe_with_status(Q("items").where("g", "=", "a"), lambda df, s: heard.append((s, df.count())))
    subs.subscribe_with_status(Q("items").where("nope", "=", "a"), lambda df, s: heard.append((s.split(":")[0], df.count())))
    end = subs.subscribe_background(Q("items").where("g", "=", "a"))
    assert heard == [("loading", 0), ("fulfilled", 4), ("loading", 0), ("failed", 0)]
    subs.buffer({"items": spark.createDataFrame([(1, "delete", [], "i0", None, None)], SCHEMA)})
    subs.update()
    end()
    assert heard[-1] == ("fulfilled", 3)


def test_outbox_connection_and_handshake(spark, shop):
    change = lambda i, n: {"items": spark.createDataFrame([(0, "update", ["n"], i, None, n)], SCHEMA)}
    box = sync.Outbox().write(change("i0", 10)).lock().write(change("i0", 11)).write(change("i1", 12))
    n_of = lambda db: {r["id"]: r["n"] for r in db.fetch(Q("items").where("id", "in", ["i0", "i1"])).collect()}
    assert box.lock() == box and n_of(box.seen(shop)) == {"i0": 11, "i1": 12} and n_of(box.roll_back().seen(shop)) == {"i0": 11, "i1": 12}
    assert [tuple(r) for r in box.to_send(shop)["items"].select("id", "n").collect()] == [("i0", 10)]
    left, confirmed = box.acknowledge(shop)
    assert n_of(confirmed) == {"i0": 10, "i1": 1} and left.locked == () and len(left.open) == 2
    assert len(box.rebase().open) == 3 and n_of(box.rebase().seen(shop)) == {"i0": 11, "i1": 12}
    old = shop.schema
    items, groups = old.collections["items"], old.collections["groups"]
    wider = S.Schema.of(S.Collection("items", {**items.attrs, "more": S.string(optional=True)}), groups)
    narrower = S.Schema.of(S.Collection("items", {k: a for k, a in items.attrs.items() if k != "g"}), groups)
    assert sync.handshake(None, old)[0] and not sync.handshake(old, None)[0] and sync.handshake(old, old) == (True, ())
    assert sync.handshake(old, wider)[0] and not sync.handshake(old, narrower)[0]
    assert sync.handshake(old, narrower, (sync.schema_hash(old),))[0]


def test_metadata(spark, tmp_path):
    assert K.read_metadata(spark, f"{tmp_path}", "k", 5) == 5
    for value in ({"a": [1]}, ["x"]):
        K.write_metadata(spark, f"{tmp_path}", "k", value)
        assert K.read_metadata(spark, f"{tmp_path}", "k") == value
