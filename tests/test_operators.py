"""Operators on small golden graphs and texts."""

import pytest

from factweave.functions import paths as P
from factweave.operators import graph as G, routes as R, search as S, text as T, versions as V
from pyspark.sql import functions as F

CHAIN = [("first", "middle"), ("middle", "last"), ("last", "last")]


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame(CHAIN, "from_ref string, to_ref string").withColumn("kind", F.lit("CALLS"))


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@pytest.mark.parametrize(
    "seed, direction, depth, edges",
    [
        ("last", "INCOMING", 9, {("first", "middle"), ("middle", "last"), ("last", "last")}),
        ("first", "OUTGOING", 9, {("first", "middle"), ("middle", "last"), ("last", "last")}),
        ("middle", "BOTH", 1, {("first", "middle"), ("middle", "last")}),
        ("first", "OUTGOING", 1, {("first", "middle")}),
        ("last", "OUTGOING", 1, {("last", "last")}),
    ],
)
def test_explore_chain(spark, chain, seed, direction, depth, edges):
    found, _ = G.explore(chain, seeds(spark, seed), direction, depth)
    rows = [(r.from_ref, r.to_ref) for r in found.collect()]
    assert set(rows) == edges and len(rows) == len(edges)


def test_frontier_and_empty_graph(spark, chain):
    _, nodes = G.explore(chain, seeds(spark, "first"), "OUTGOING", 1)
    assert {(r.node, r.frontier) for r in nodes.collect()} == {("first", False), ("middle", True)}
    _, nodes = G.explore(chain.limit(0), seeds(spark, "first"), "BOTH", 3)
    assert [r.node for r in nodes.collect()] == ["first"]


def test_certain_path_wins_whatever_its_length(spark):
    certain = spark.createDataFrame([("s", "a"), ("a", "b"), ("b", "top")], "src string, dst string")
    uncertain = spark.createDataFrame([("s", "top"), ("top", "far")], "src string, dst string")
    rows = {r.node: (r.certain, r.level) for r in G.impact(certain, uncertain, seeds(spark, "s"), 5).collect()}
    assert rows["top"] == (True, 3) and rows["far"] == (False, 2)


def test_degree_counts_a_loop_twice(chain):
    assert {r.node: r.degree for r in G.degree(chain).collect()} == {"first": 1, "middle": 2, "last": 3}


def test_terms_split_camel_case():
    assert S.terms("HTTPServer readMe read_me") == ["http", "server", "read", "me"]


def test_paths(spark):
    rows = spark.createDataFrame([("src/tests/a.py",), ("src/a_test.go",), ("src/attest.py",), ("dist/x.js",)], "path string")
    got = rows.select(P.is_test(F.col("path")), P.is_generated(F.col("path")), P.language(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [(True, False, "python"), (True, False, "go"), (False, False, "python"), (False, True, "typescript")]


def test_exact_search_positions(spark):
    files = spark.createDataFrame([("a", "xx.x\n..x.x.x"), ("b", None), ("c", "")], "path string, text string")
    assert {(r.path, r.line_no, r.col_no) for r in T.exact_search(files, ".x").collect()} == {("a", 1, 3), ("a", 2, 2), ("a", 2, 4), ("a", 2, 6)}


def test_working_lines(spark):
    base = spark.createDataFrame([("f", n) for n in (1, 5, 6, 9)], "file string, line long")
    hunks = spark.createDataFrame([("f", 5, 1, 3), ("f", 8, 0, 1)], "file string, base_start long, base_count long, count long")
    assert {r.line: r.working_line for r in V.working_lines(base, hunks, "file").collect()} == {1: 1, 5: None, 6: 8, 9: 12}


def test_route_fit(spark):
    routes = spark.createDataFrame([("/api/v1/feeds/:id",), ("/other/:id",)], "route string").withColumn("segs", R.segments(F.col("route")))
    asked = spark.createDataFrame([("/feeds/7",), ("/nothing/7",)], "request string").withColumn("segs", R.segments(F.col("request")))
    assert [(r.request, r.route, r.extras) for r in R.fitting(asked, routes).collect()] == [("/feeds/7", "/api/v1/feeds/:id", 2)]


def test_diff_hunks_keep_removed_lines_that_look_like_headers(spark):
    from factweave.operators.changes import diff_hunks

    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3,2 +3 @@ f\n--- a comment\n-two\n+new\n@@ -9,0 +9,2 @@\n+p\n+q\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-z"
    new = "--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+n"
    rows = diff_hunks(spark.createDataFrame([(1, diff), (2, None), (3, ""), (4, new)], "k int, diff string"), "k").collect()
    assert sorted(tuple(r) for r in rows) == [
        (1, "x", "CHANGED", 3, 2, 3, 1, ["-- a comment", "two"]),
        (1, "x", "CHANGED", 9, 0, 9, 2, []),
        (1, "y", "DELETED", 1, 1, 0, 0, ["z"]),
        (4, "n", "ADDED", 0, 0, 1, 1, []),
    ]


def test_keeps_sequence(spark):
    from pyspark.sql import functions as F

    from factweave.operators.changes import keeps_sequence

    rows = spark.createDataFrame([(list("abc"), list("axbyc"), True), (list("abc"), list("acb"), False), ([], list("a"), True), (list("aa"), list("a"), False)], "old array<string>, new array<string>, want boolean")
    assert rows.filter(keeps_sequence(F.col("old"), F.col("new")) != F.col("want")).count() == 0


def test_replay_closure_follows_shared_files(spark):
    from factweave.operators.changes import replay_closure

    reads = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 3), ("e", None), ("f", None)], "context string, file int")
    found = replay_closure(reads, spark.createDataFrame([("a",), ("e",)], "context string"))
    assert {tuple(r) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2), ("e", 0)}


def test_store_publishes_whole_versions_and_retains_some(spark, tmp_path):
    from factweave.sources import store

    folder = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    assert sorted(map(tuple, store.publish(df, folder, "1").collect()), key=repr) == sorted([(1, "a"), (2, None), (2, None)], key=repr)
    store.publish(df.limit(0), folder, "2")
    assert store.publish(df, folder, "2").count() == 0
    assert store.versions(spark, folder) == ["1", "2"]
    assert store.retain(spark, folder, {"2"}) == ["1"]
    assert store.versions(spark, folder) == ["2"]


def test_ledger_of_a_folder_of_files(spark, tmp_path):
    from factweave.streaming.ledger import kept_current, last_checks

    rows = [(i, f"2024-01-0{1 + i % 5} 00:00:00", i % 3, ("click", "purchase", "view")[i % 4 % 3]) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).to_timestamp("ts"))
    events.repartition(70).write.parquet(f"{tmp_path}/events.parquet")
    got = kept_current(spark, f"file://{tmp_path}/events.parquet")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, last_checks(events).collect()))


def shuffled_bytes(spark):
    """Bytes that all stages so far have written to shuffles."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def weighted(spark, seed, count, vocabulary, id_type="long"):
    import random

    rng = random.Random(seed)
    rows = [(k, f"w{int(rng.paretovariate(0.5)) % vocabulary}") for k in range(count) for _ in range(rng.randrange(1, 30))]
    rows = sorted({(i, w): rng.random() + 0.01 for i, w in rows}.items())
    return spark.createDataFrame([(i, w, x) for (i, w), x in rows], "id long, word string, w double").withColumn("id", F.col("id").cast(id_type))


def plain_cosines(left, right):
    out, norms = {}, [{}, {}]
    for rows, norm in zip((left, right), norms):
        for r in rows:
            norm[r.id] = norm.get(r.id, 0) + r.w * r.w
    for a in left:
        for b in right:
            if a.word == b.word:
                out[a.id, b.id] = out.get((a.id, b.id), 0) + a.w * b.w / (norms[0][a.id] * norms[1][b.id]) ** 0.5
    return out


@pytest.mark.parametrize("id_type", ["long", "string"])
def test_similar_rows_equal_plain_sums(spark, id_type):
    from factweave.operators import similarity as M

    left, right = weighted(spark, 1, 60, 40, id_type), weighted(spark, 2, 45, 60, id_type)
    a, b = left.collect(), right.collect()
    nulls = spark.createDataFrame([(None, "w1", 1.0), ("7", None, 1.0)], "id string, word string, w double").withColumn("id", F.col("id").cast(id_type))
    for got, want in (
        (M.similar_pairs(left.union(nulls), right, 0.3), plain_cosines(a, b)),
        (M.similar_pairs(left, left, 0.3), plain_cosines(a, a)),
        (M.similar_within(left.union(nulls), 0.3), {k: v for k, v in plain_cosines(a, a).items() if k[0] < k[1]}),
        (M.similar_within(left, 0.3, 30_000_000), {k: v for k, v in plain_cosines(a, a).items() if k[0] < k[1]}),
        (M.similar_within(left.limit(0), 0.3), {}),
        (M.similar_pairs(left, right.limit(0), 0.3), {}),
    ):
        rows, want = got.collect(), {k: v for k, v in want.items() if v >= 0.3}
        assert {(r.left_id, r.right_id): pytest.approx(r.cosine) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("cells, products, cost", [(2_000_000, 1_000_000, 40), (100, 7, 40), (100, 7, 1), (5000, 50, 0), (3, 1, 1000)])
def test_similar_rows_in_steps(monkeypatch, cells, products, cost):
    import numpy as np
    import pyarrow as pa

    from factweave.operators import similarity as M

    rng = np.random.default_rng(3)
    full = [rng.random((n, 30)) * (rng.random((n, 30)) < rng.random(30)) for n in (40, 25)]
    blocks = []
    for x, skipped in zip(full, (0, 5)):
        x[:, 29 - skipped] = 0
        x[:, 0] = 1
        words = [k for k in range(30) if x[:, k].any()]
        parts = [dict(ids=list(range(len(x))) if k == 0 else [], words=[f"w{k}"], counts=np.array([np.count_nonzero(x[:, k])], "<i4").tobytes(), docs=np.flatnonzero(x[:, k]).astype("<i4").tobytes(), w=x[x[:, k] > 0, k].tobytes()) for k in words]
        kinds = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("counts", pa.binary()), ("docs", pa.binary()), ("w", pa.binary())])
        blocks.append(M._Block(pa.Table.from_pylist(parts, kinds)))
    for name, value in (("CELLS", cells), ("PRODUCTS", products), ("CELLS_A_PRODUCT", cost)):
        monkeypatch.setattr(M, name, value)
    one, two = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in full)
    want, got = one @ two.T, np.zeros((40, 25))
    for x, y, cosine in M._hits(*blocks, 0.5):
        assert not got[x, y].any()
        got[x, y] = cosine
    assert np.allclose(got, np.where(want >= 0.5, want, 0))


def test_similar_rows_shuffle_postings_not_pairs(spark):
    from factweave.operators import similarity as M

    words = spark.range(3000).select("id", F.explode(F.array_append(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.concat(F.lit("common"), k)), F.concat(F.lit("own"), F.expr("id div 2")))).alias("word"))
    rows = M.weights(words).union(spark.range(1).select((F.col("id") - 1).alias("id"), F.lit("own0").alias("word"), F.lit(1.0).alias("w")))
    common = words.filter("word like 'common%'").select("id", "word", F.lit(0.01).alias("w"))
    rows = rows.union(common)
    before = shuffled_bytes(spark)
    found = M.similar_pairs(rows, rows, 0.9).filter("left_id < right_id").count()
    assert found == 1500 + 2
    used = shuffled_bytes(spark) - before
    assert used < 8_000_000, used
