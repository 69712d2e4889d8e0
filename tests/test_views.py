"""View, paging, caller and closure operators on small cases."""

import random

import pytest

from factweave.operators import graph as G, routes as R, views as V

rng = random.Random(3)


def pairs(spark, rows, schema="from_ref string, to_ref string"):
    return spark.createDataFrame(rows, schema)


def test_cursors_are_bound_and_signed():
    cursor = V.encode_cursor(b"key", "search", ["a", "b"], {"path": "x", "line": 3})
    assert V.decode_cursor(b"key", "search", ["b", "a"], cursor) == {"path": "x", "line": 3}
    for secret, operation, scope, text in [(b"other", "search", ["a", "b"], cursor), (b"key", "list", ["a", "b"], cursor), (b"key", "search", ["a"], cursor), (b"key", "search", ["a", "b"], "x" + cursor), (b"key", "search", ["a", "b"], "")]:
        with pytest.raises(ValueError):
            V.decode_cursor(secret, operation, scope, text)


def test_callers_dispatch_and_implicit(spark):
    calls = pairs(spark, [("a", "Base.run"), ("b", "Sub.run"), ("c", "Only.go"), ("d", "Cls")])
    overrides = pairs(spark, [("Sub.run", "Base.run"), ("Sub2.run", "Base.run"), ("Impl.go", "Only.go")])
    implicit = pairs(spark, [("Cls.__init__", "Cls")], "member string, owner string")
    got = {(r.callee, r.caller): r.certain for r in V.caller_edges(calls, overrides, implicit).collect()}
    assert got == {
        ("Base.run", "a"): True, ("Sub.run", "b"): True, ("Only.go", "c"): True, ("Cls", "d"): True, ("Sub.run", "a"): False, ("Sub2.run", "a"): False, ("Impl.go", "c"): True, ("Cls.__init__", "d"): True,
    }


def test_importers_take_three_hops(spark):
    chain = pairs(spark, [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("c", "a"), ("a", "c")])
    got = {r.node: r["rank"] for r in V.importers(chain, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"b": 2, "c": 2, "d": 4, "e": 4}


def test_groups_of_a_long_chain(spark):
    edges = [(f"n{k:03}", f"n{k + 1:03}") for k in range(60)] + [("x", "y"), ("z", "y"), ("q", "q")]
    rng.shuffle(edges)
    got = {r.node: r.label for r in V.groups(pairs(spark, edges, "u string, v string")).collect()}
    assert got == {**{f"n{k:03}": "n000" for k in range(61)}, "x": "x", "y": "x", "z": "x", "q": "q"}


def test_new_cycles_are_those_that_were_not(spark):
    before = pairs(spark, [("a", "b"), ("x", "y"), ("y", "x")], "a string, b string")
    now = pairs(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("c", "d"), ("y", "z"), ("e", "e")], "a string, b string")
    assert {(r.a, r.b) for r in V.on_new_cycles(now, before, 9).collect()} == {("b", "c"), ("c", "a")}


def test_lineage_goes_to_the_root_and_refuses_cycles(spark):
    chain = pairs(spark, [(f"d{k}", f"d{k + 1}") for k in range(20)])
    got = {r.ancestor: r.distance for r in G.lineage(chain).filter("node = 'd20'").collect()}
    assert got == {f"d{k}": 20 - k for k in range(20)}
    with pytest.raises(RuntimeError):
        G.lineage(pairs(spark, [("a", "b"), ("b", "a")]), most=8)


def test_package_roots_and_renames(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("z.py",)], "path string")
    got = {r.path: r.root for r in V.package_roots(files, spark.createDataFrame([("a",), ("a/b",)], "dir string")).collect()}
    assert got == {"a/b/c.py": "a/b", "a/x.py": "a", "z.py": None}
    base = spark.createDataFrame([("old.py", "F", "f"), ("old.py", "F", "g")], "path string, kind string, name string")
    working = spark.createDataFrame([("new.py", "F", "f")], "path string, kind string, name string")
    renames = spark.createDataFrame([("old.py", "new.py")], "old string, new string")
    assert [(r.path, r.name) for r in V.removed_declarations(base, working, renames).collect()] == [("new.py", "g")]


def test_first_few_and_pages(spark):
    rows = spark.createDataFrame([("k", n % 50) for n in range(400)], "g string, n long")
    assert [(r["items"], r.n) for r in V.first_few(rows, ["g"], "n", 8).collect()] == [(list(range(8)), 50)]
    table = spark.createDataFrame([(n,) for n in range(10)], "n long")
    assert [(r.n, r.more) for r in V.page(table, ["n"], 4, 3).collect()] == [(4, True), (5, True), (6, True)]
    assert [(r.n, r.more) for r in V.page(table, ["n"], 7, 3).collect()] == [(7, False), (8, False), (9, False)]
    assert V.with_remainder(table, ["n"], 20).filter("remainder != 0").isEmpty()


def test_routes_fit_as_written(spark):
    routes = ["/API/V1/users/:id", "/users/new", "/items/{a}-x/", "/feeds", "/v2/feeds/list", "/ab/:id"]
    requests = ["/users/7", "/users/new", "/items/3", "/feeds", "/other/feeds", "/feeds/list", "/x/feeds/list", "/ab/1", "/users/${id}"]

    def frame(name, values):
        return spark.createDataFrame([(v, [s for s in v.split("/") if s]) for v in values], f"{name} string, segs array<string>")

    got = {}
    for r in R.closest(R.fitting(frame("request", requests), frame("route", routes))).collect():
        got.setdefault(r.request, set()).add((r.route, r.extras))
    assert got == {
        "/users/7": {("/API/V1/users/:id", 2)}, "/users/new": {("/users/new", 0)}, "/items/3": {("/items/{a}-x/", 0)}, "/feeds": {("/feeds", 0)},
        "/feeds/list": {("/v2/feeds/list", 1)}, "/users/${id}": {("/API/V1/users/:id", 2)},
    }
