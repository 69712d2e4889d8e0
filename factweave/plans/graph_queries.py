"""Queries of graph operators over the driver tables, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.paths import allowed, is_test
from factweave.operators import graph as G, views as V
from factweave.sources.driver_tables import FACTS_SQL, fact_graph, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def facts_sql(rest: str, ctes: str = "") -> str:
    return f"WITH RECURSIVE {FACTS_SQL}{', ' + ctes if ctes else ''} {rest}"


def seeds(spark, *refs: str):
    return spark.createDataFrame([(r,) for r in refs], "node string")


SCOPE = ["ASIA", "catalog"]


def search_sql(edges: str, seed: str, depth: int) -> str:
    return f"""e AS ({edges}), walk AS (
      SELECT '{seed}' AS node, 0 AS level UNION SELECT e.dst, walk.level + 1 FROM walk JOIN e ON e.src = walk.node WHERE walk.level < {depth}
    ), reached AS (SELECT node, min(level) AS level FROM walk GROUP BY node)"""


UP = "SELECT DISTINCT to_ref AS src, from_ref AS dst FROM relations WHERE kind IN ('CALLS', 'CONTAINS')"
DOWN = "SELECT DISTINCT from_ref AS src, to_ref AS dst FROM relations WHERE kind IN ('CALLS', 'CONTAINS')"


def calls(spark, sf_dir):
    return fact_graph(spark, sf_dir).relations.filter(F.col("kind").isin("CALLS", "CONTAINS"))


@query("callers_depth8", facts_sql("SELECT node, level, level = 8 AS frontier FROM reached", search_sql(UP, "P:17", 8)))
def callers(spark, sf_dir):
    return G.explore(calls(spark, sf_dir), seeds(spark, "P:17"), "INCOMING", 8)[1]


@query("callees_depth3", facts_sql("SELECT node, level, level = 3 AS frontier FROM reached", search_sql(DOWN, "C:7", 3)))
def callees(spark, sf_dir):
    return G.explore(calls(spark, sf_dir), seeds(spark, "C:7"), "OUTGOING", 3)[1]


BOTH = f"{UP} UNION {DOWN}"


@query("bfs_both_depth2", facts_sql("SELECT node, level, level = 2 AS frontier FROM reached", search_sql(BOTH, "O:1", 2)))
def both(spark, sf_dir):
    return G.explore(calls(spark, sf_dir), seeds(spark, "O:1"), "BOTH", 2)[1]


@query("explored_edges", facts_sql(
    "SELECT DISTINCT r.from_ref, r.to_ref, r.kind, r.path FROM relations r JOIN reached ON r.to_ref = node AND level < 2 WHERE r.kind IN ('CALLS', 'CONTAINS')", search_sql(UP, "P:17", 2)))
def explored_edges(spark, sf_dir):
    return G.explore(calls(spark, sf_dir), seeds(spark, "P:17"), "INCOMING", 2)[0]


SCOPED = "SELECT DISTINCT to_ref AS src, from_ref AS dst FROM relations WHERE kind IN ('CALLS', 'CONTAINS') AND (path = 'ASIA' OR path LIKE 'ASIA/%' OR path = 'catalog' OR path LIKE 'catalog/%')"


@query("scoped_bfs", facts_sql("SELECT node, level, level = 6 AS frontier FROM reached", search_sql(SCOPED, "P:17", 6)))
def scoped(spark, sf_dir):
    return G.explore(calls(spark, sf_dir).filter(allowed(F.col("path"), SCOPE)), seeds(spark, "P:17"), "INCOMING", 6)[1]


PRIORITY_SQL = "CASE kind WHEN 'CONTAINS' THEN 1 WHEN 'READS' THEN 2 WHEN 'REFERENCES' THEN 3 ELSE 0 END"


@query("edges_project_scope", facts_sql(f"""SELECT from_ref, to_ref, kind, path, {PRIORITY_SQL} AS priority,
  row_number() OVER (PARTITION BY path ORDER BY {PRIORITY_SQL}, from_ref, to_ref) AS position FROM relations WHERE path = 'ASIA' OR path LIKE 'ASIA/%'"""))
def edges_in_scope(spark, sf_dir):
    from pyspark.sql import Window

    rows = fact_graph(spark, sf_dir).relations.filter(allowed(F.col("path"), ["ASIA"])).withColumn("priority", G.lookup(F.col("kind"), G.PRIORITY))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("priority", "from_ref", "to_ref")))


@query("degree_top", facts_sql("""SELECT node, count(*) AS degree FROM (SELECT from_ref AS node FROM relations UNION ALL SELECT to_ref FROM relations)
  GROUP BY node ORDER BY degree DESC, node LIMIT 20"""))
def degree_top(spark, sf_dir):
    return G.degree(fact_graph(spark, sf_dir).relations).orderBy(F.desc("degree"), "node").limit(20)


UNRESOLVED = "(from_ref[-1:] IN ('3', '7'))"
EXTERNAL = "(from_ref[-1:] = '7')"


def resolved_calls(spark, sf_dir):
    """Calls; those from orders that end in 3 or 7 count as unresolved, in 7 as the library's."""
    last = F.substr(F.col("from_ref"), F.lit(-1))
    return fact_graph(spark, sf_dir).relations.filter("kind = 'CALLS'").withColumn("resolved", ~last.isin("3", "7")).withColumn("library", last == "7")


@query("call_resolution_by_path", facts_sql(f"""SELECT path, count(*) AS calls, count(*) FILTER (WHERE NOT {UNRESOLVED}) AS resolved, count(*) FILTER (WHERE {EXTERNAL}) AS library
  FROM relations WHERE kind = 'CALLS' GROUP BY path"""))
def by_path(spark, sf_dir):
    return resolved_calls(spark, sf_dir).groupBy("path").agg(F.count("*").alias("calls"), F.count_if("resolved").alias("resolved"), F.count_if("library").alias("library"))


@query("resolution_by_language", facts_sql(f"""SELECT split_part(path, '/', 1) AS language, count(*) AS calls,
  CAST(floor(100.0 * count(*) FILTER (WHERE NOT {UNRESOLVED}) / count(*)) AS BIGINT) AS percent FROM relations WHERE kind = 'CALLS' GROUP BY 1"""))
def by_language(spark, sf_dir):
    per_path = by_path(spark, sf_dir)
    rows = per_path.groupBy(F.substring_index("path", "/", 1).alias("language")).agg(F.sum("calls").alias("calls"), F.sum("resolved").alias("resolved"))
    return rows.select("language", "calls", F.floor(F.lit(100) * F.col("resolved") / F.col("calls")).alias("percent"))


@query("module_import_matrix", facts_sql("""SELECT split_part(a.path, '/', 1) AS from_module, split_part(b.path, '/', 1) AS to_module, count(*) AS imports
  FROM relations r JOIN objects a ON a.entity_ref = r.from_ref JOIN objects b ON b.entity_ref = r.to_ref WHERE r.kind = 'IMPORTS' GROUP BY 1, 2"""))
def matrix(spark, sf_dir):
    g = fact_graph(spark, sf_dir)
    files = g.objects.filter("kind = 'FILE'").select(F.col("entity_ref"), F.substring_index("path", "/", 1).alias("module"))
    rows = g.relations.filter("kind = 'IMPORTS'").select("from_ref", "to_ref")
    a, b = files.withColumnsRenamed({"entity_ref": "from_ref", "module": "from_module"}), files.withColumnsRenamed({"entity_ref": "to_ref", "module": "to_module"})
    return rows.join(a, "from_ref").join(b, "to_ref").groupBy("from_module", "to_module").agg(F.count("*").alias("imports"))


@query("import_listing", facts_sql("""SELECT DISTINCT a.path AS from_path, b.path AS to_path FROM relations r JOIN objects a ON a.entity_ref = r.from_ref
  LEFT JOIN objects b ON b.entity_ref = r.to_ref WHERE r.kind = 'IMPORTS' AND a.path NOT LIKE '%/tests/%'"""))
def import_listing(spark, sf_dir):
    g = fact_graph(spark, sf_dir)
    names = g.objects.filter("kind = 'FILE'").select("entity_ref", "path")
    rows = g.relations.filter("kind = 'IMPORTS'").select("from_ref", "to_ref")
    a, b = names.withColumnsRenamed({"entity_ref": "from_ref", "path": "from_path"}), names.withColumnsRenamed({"entity_ref": "to_ref", "path": "to_path"})
    return rows.join(a, "from_ref").join(b, "to_ref", "left").filter(~is_test(F.col("from_path"))).select("from_path", "to_path").distinct()


@query("module_sizes", facts_sql("SELECT split_part(path, '/', 1) AS module, count(DISTINCT path) AS files, count(*) AS objects FROM objects GROUP BY 1"))
def module_sizes(spark, sf_dir):
    return fact_graph(spark, sf_dir).objects.groupBy(F.substring_index("path", "/", 1).alias("module")).agg(F.countDistinct("path").alias("files"), F.count("*").alias("objects"))


CUTOFF = "1996-01-01"


def nation_calls(spark, sf_dir):
    """Dependencies between nations (customer's to supplier's) of each order."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"), "o_orderdate", "o_custkey")
    )


NATION_CALLS = "nc AS (SELECT c_nationkey AS a, s_nationkey AS b, o_orderdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


@query("new_module_edges", f"WITH {NATION_CALLS} SELECT o_custkey, b, count(*) AS uses FROM nc WHERE o_orderdate >= TIMESTAMP '{CUTOFF}' AND (o_custkey, b) NOT IN (SELECT (o_custkey, b) FROM nc WHERE o_orderdate < TIMESTAMP '{CUTOFF}') GROUP BY 1, 2")
def new_module_edges(spark, sf_dir):
    rows = nation_calls(spark, sf_dir).select("o_custkey", "b", "o_orderdate")
    now = rows.filter(F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp")).groupBy("o_custkey", "b").agg(F.count("*").alias("uses"))
    return G.new_edges(now, rows.filter(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp")), ["o_custkey", "b"])


#: The base version holds the orders before this date, the working version all.
CYCLE_DATE = "1995-01-05"


@query("new_cycles", f"""WITH RECURSIVE {NATION_CALLS}, before AS (SELECT DISTINCT a, b FROM nc WHERE o_orderdate < TIMESTAMP '{CYCLE_DATE}' AND a <> b), now AS (SELECT DISTINCT a, b FROM nc WHERE a <> b),
  was AS (SELECT a, b FROM before UNION SELECT was.a, before.b FROM was JOIN before ON was.b = before.a), is_ AS (SELECT a, b FROM now UNION SELECT is_.a, now.b FROM is_ JOIN now ON is_.b = now.a)
  SELECT a, b FROM now WHERE (a, b) NOT IN (SELECT (a, b) FROM before) AND (b, a) IN (SELECT (a, b) FROM is_) AND (b, a) NOT IN (SELECT (a, b) FROM was)""")
def cycles(spark, sf_dir):
    """Dependencies between nations that the version of all orders has over that of the first days, and that close a new cycle."""
    rows = nation_calls(spark, sf_dir).select("a", "b", "o_orderdate")
    return V.on_new_cycles(rows, rows.filter(F.col("o_orderdate") < F.lit(CYCLE_DATE).cast("timestamp")), 25)


@query("lineage_of_orders", facts_sql("""SELECT node, ancestor, distance FROM up WHERE node LIKE 'O:%'""", """
  parent AS (SELECT DISTINCT to_ref AS node, from_ref AS ancestor FROM relations WHERE kind = 'CONTAINS'),
  up AS (SELECT node, ancestor, 1 AS distance FROM parent UNION ALL SELECT up.node, parent.ancestor, distance + 1 FROM up JOIN parent ON up.ancestor = parent.node)"""))
def lineage(spark, sf_dir):
    return G.lineage(fact_graph(spark, sf_dir).relations.filter("kind = 'CONTAINS'")).filter(F.col("node").startswith("O:"))


@query("owner_rollup", facts_sql("SELECT 'C:' || o_custkey AS owner, count(*) + 1 AS declarations FROM owned GROUP BY 1 UNION ALL SELECT entity_ref, 1 FROM objects WHERE kind = 'CLASS' AND entity_ref NOT IN (SELECT 'C:' || o_custkey FROM owned)"))
def owner_rollup(spark, sf_dir):
    g = fact_graph(spark, sf_dir)
    return G.owners(g.objects.filter("kind != 'FUNCTION'"), g.relations.filter("kind = 'CONTAINS'"), F.col("kind") == "CLASS").groupBy("owner").agg(F.count("*").alias("declarations"))


@query("qualified_names", facts_sql("SELECT 'O:' || o_orderkey AS node, r_name || '.' || n_name || '.' || c_name || '.Order#' || o_orderkey AS qualified FROM orders JOIN customers c ON o_custkey = c_custkey JOIN places p ON c.c_nationkey = p.n_nationkey"))
def qualified(spark, sf_dir):
    g = fact_graph(spark, sf_dir)
    names = g.objects.select("entity_ref", "name")
    up = G.lineage(g.relations.filter("kind = 'CONTAINS'")).filter(F.col("node").startswith("O:"))
    chain = up.join(names.select(F.col("entity_ref").alias("ancestor"), "name"), "ancestor").groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name"))).alias("chain"))
    own = names.select(F.col("entity_ref").alias("node"), F.col("name").alias("own"))
    return chain.join(own, "node").select("node", F.concat_ws(".", F.array_join(F.transform("chain", lambda x: x["name"]), "."), "own").alias("qualified"))


@query("scope_members", facts_sql("SELECT n_path AS scope, 'C:' || c_custkey AS member FROM customers UNION ALL SELECT n_path, 'S:' || s_suppkey FROM suppliers"))
def scope_members(spark, sf_dir):
    """Addressable members (classes) right below files."""
    g = fact_graph(spark, sf_dir)
    files = g.objects.filter("kind = 'FILE'").select(F.col("entity_ref").alias("from_ref"), F.col("path").alias("scope"))
    return g.relations.filter("kind = 'CONTAINS'").select("from_ref", F.col("to_ref").alias("member")).join(files, "from_ref").select("scope", "member")


FOCUS_SQL = """
w AS (SELECT from_ref AS src, to_ref AS dst, CASE kind WHEN 'CALLS' THEN 1200 WHEN 'IMPORTS' THEN 800 ELSE 250 END AS weight FROM relations),
fe AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM w UNION ALL SELECT dst, src, weight FROM w) GROUP BY 1, 2),
f0 AS (SELECT 'P:17' AS node, CAST(1800 AS BIGINT) AS score),
f1 AS (SELECT dst AS node, max(floor(least(score, weight) / 1)) AS score FROM fe JOIN f0 ON src = node WHERE dst NOT IN (SELECT node FROM f0) GROUP BY 1),
f2 AS (SELECT dst AS node, max(floor(least(score, weight) / 2)) AS score FROM fe JOIN f1 ON src = node WHERE dst NOT IN (SELECT node FROM f0) AND dst NOT IN (SELECT node FROM f1) GROUP BY 1)"""


@query("search_focus", facts_sql("SELECT node, CAST(score AS BIGINT) AS score FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2)", FOCUS_SQL))
def focus(spark, sf_dir):
    return G.focus(fact_graph(spark, sf_dir).relations, seeds(spark, "P:17"))


def impact_edges(spark, sf_dir):
    """Edges from callee to caller: orders of even keys call for certain, others perhaps; containers run their members."""
    g = fact_graph(spark, sf_dir)
    up = g.relations.filter("kind in ('CALLS', 'CONTAINS')").select(F.col("to_ref").alias("src"), F.col("from_ref").alias("dst"), "kind")
    sure = (F.col("kind") == "CONTAINS") | (F.substring_index("dst", ":", -1).cast("long") % 2 == 0)
    return up.filter(sure).select("src", "dst"), up.filter(~sure).select("src", "dst")


IMPACT_SQL = """
iu AS (SELECT to_ref AS src, from_ref AS dst, kind = 'CONTAINS' OR CAST(split_part(from_ref, ':', 2) AS BIGINT) % 2 = 0 AS sure FROM relations WHERE kind IN ('CALLS', 'CONTAINS')),
sw AS (SELECT 'S:3' AS node, 0 AS level UNION SELECT dst, level + 1 FROM sw JOIN iu ON src = node WHERE sure AND level < 4),
aw AS (SELECT 'S:3' AS node, 0 AS level UNION SELECT dst, level + 1 FROM aw JOIN iu ON src = node WHERE level < 4),
s AS (SELECT node, min(level) AS level FROM sw GROUP BY 1), a AS (SELECT node, min(level) AS level FROM aw GROUP BY 1),
hit AS (SELECT node, level, true AS certain FROM s UNION ALL SELECT node, level, false FROM a WHERE node NOT IN (SELECT node FROM s))"""


def impacted(spark, sf_dir, depth: int = 4):
    certain, uncertain = impact_edges(spark, sf_dir)
    return G.impact(certain, uncertain, seeds(spark, "S:3"), depth)


@query("impact_trace", facts_sql("SELECT node, level, certain FROM hit", IMPACT_SQL))
def impact_trace(spark, sf_dir):
    return impacted(spark, sf_dir)


@query("impact_entries", facts_sql("SELECT node, certain FROM hit WHERE node NOT IN (SELECT to_ref FROM relations WHERE kind IN ('CALLS', 'CONTAINS'))", IMPACT_SQL))
def impact_entries(spark, sf_dir):
    certain, uncertain = impact_edges(spark, sf_dir)
    return G.entry_points(impacted(spark, sf_dir), certain.unionByName(uncertain)).select("node", "certain")


@query("impact_tests_ranked", facts_sql("SELECT o.path, min(level) / 10.0 AS rank, count(*) AS names FROM hit JOIN objects o ON o.entity_ref = node WHERE o.path LIKE '%/tests/%' GROUP BY 1", IMPACT_SQL))
def impact_tests(spark, sf_dir):
    """Test paths among the impact, ranked by their nearest declaration."""
    objects = fact_graph(spark, sf_dir).objects.select(F.col("entity_ref").alias("node"), "path")
    rows = impacted(spark, sf_dir).join(objects, "node").filter(is_test(F.col("path")))
    return rows.groupBy("path").agg((F.min("level") / 10).alias("rank"), F.count("*").alias("names"))


@query("impact_areas", facts_sql("SELECT split_part(o.path, '/', 1) AS area, count(DISTINCT o.path) AS paths, count(*) AS declarations, bool_or(certain) AS certain FROM hit JOIN objects o ON o.entity_ref = node GROUP BY 1", IMPACT_SQL))
def impact_areas(spark, sf_dir):
    objects = fact_graph(spark, sf_dir).objects.select(F.col("entity_ref").alias("node"), "path")
    rows = impacted(spark, sf_dir).join(objects, "node").withColumn("area", F.substring_index("path", "/", 1))
    return rows.groupBy("area").agg(F.countDistinct("path").alias("paths"), F.count("*").alias("declarations"), F.bool_or("certain").alias("certain"))


@query("untested_changes", facts_sql("""SELECT 'P:' || p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN owned ON l_orderkey = o_orderkey WHERE path LIKE '%/tests/%')"""))
def untested(spark, sf_dir):
    """Parts that no order below a test path calls."""
    g = fact_graph(spark, sf_dir)
    tested = g.relations.filter("kind = 'CALLS'").filter(is_test(F.col("path"))).select(F.col("to_ref").alias("node"))
    return g.objects.filter("kind = 'FUNCTION'").select(F.col("entity_ref").alias("node")).join(tested, "node", "left_anti")


@query("name_only_calls", """SELECT e.event_type, regexp_extract(p.p_name, '([A-Za-z]+)$', 1) AS member, count(*) AS calls FROM events e
  JOIN part p ON p.p_partkey = 1 + e.user_id GROUP BY 1, 2""")
def name_only(spark, sf_dir):
    """Calls by member name only: the last word of the part that an event's user number points to."""
    member = F.regexp_extract("p_name", r"([A-Za-z]+)$", 1)
    part = table(spark, sf_dir, "part").select("p_partkey", member.alias("member"))
    return table(spark, sf_dir, "events").join(part, F.col("p_partkey") == F.col("user_id") + 1).groupBy("event_type", "member").agg(F.count("*").alias("calls"))


@query("implemented_contracts", """WITH m AS (SELECT DISTINCT o_custkey AS t, l_returnflag AS name, l_linestatus AS sig FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  c AS (SELECT DISTINCT p_brand AS contract, l_returnflag AS name, l_linestatus AS sig FROM lineitem JOIN part ON l_partkey = p_partkey),
  cw AS (SELECT *, count(*) OVER (PARTITION BY contract) AS wanted FROM c)
  SELECT t AS type_ref, contract AS contract_ref FROM m JOIN cw USING (name, sig) GROUP BY 1, 2 HAVING count(*) = max(cw.wanted)""")
def implemented(spark, sf_dir):
    """Customers whose orders have every kind of line that a brand's parts are ordered in."""
    items = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_returnflag": "name", "l_linestatus": "signature"})
    orders, part = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    members = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("type_ref"), "name", "signature")
    contracts = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("contract_ref"), "name", "signature")
    return G.divide(members, contracts)
