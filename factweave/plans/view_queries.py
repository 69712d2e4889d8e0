"""Queries of view, paging, caller and closure operators over the driver tables, with oracles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from factweave.functions.lineage import settled
from factweave.functions import paths as P
from factweave.functions.paths import is_test
from factweave.operators import graph as G, views as V
from factweave.plans.graph_queries import facts_sql, resolved_calls, seeds
from factweave.sources.driver_tables import fact_graph, table

QUERIES, ORACLES = {}, {}
CUTOFF = "1996-01-01"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def ref(letter: str, key: str):
    return F.concat(F.lit(letter + ":"), F.col(key).cast("string"))


def before(column: str = "o_orderdate"):
    return F.col(column) < F.lit(CUTOFF).cast("timestamp")


def items_of(spark, sf_dir):
    """Line items with their orders' customer, date and priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


ITEMS = "items AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


# --- lists and groups

def verb_sql(direction: str, kind: str = "kind") -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.VERBS[direction].items()) + " ELSE 'references' END"


@query("edge_verbs", facts_sql(f"""SELECT from_ref AS node, {verb_sql('out')} AS verb, count(*) AS edges FROM relations GROUP BY ALL
  UNION ALL SELECT to_ref, {verb_sql('in')}, count(*) FROM relations GROUP BY ALL"""))
def edge_verbs(spark, sf_dir):
    """What each declaration does to others, and what is done to it."""
    r = fact_graph(spark, sf_dir).relations
    out = r.select(F.col("from_ref").alias("node"), V.verb(F.col("kind"), "out").alias("verb"))
    back = r.filter("to_ref is not null").select(F.col("to_ref").alias("node"), V.verb(F.col("kind"), "in").alias("verb"))
    return out.unionByName(back).groupBy("node", "verb").agg(F.count("*").alias("edges"))


@query("documentation_lists", """SELECT l_orderkey, to_json(list(l_linenumber ORDER BY l_linenumber))::VARCHAR AS notes FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def documentation_lists(spark, sf_dir):
    """Notes of one kind of each file (an order's returned lines), as a JSON list."""
    rows = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey")
    return rows.agg(F.to_json(F.array_sort(F.collect_list("l_linenumber"))).alias("notes"))


@query("nav_documents", """SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY l_linenumber, p_name) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def nav_documents(spark, sf_dir):
    """The text of a file's names, in their order."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    listed = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("names"))
    return listed.select("l_orderkey", F.array_join(F.transform("names", lambda x: x["p_name"]), " ").alias("text"))


@query("site_lists", """WITH s AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber) AS r, count(*) OVER (PARTITION BY l_partkey) AS n FROM s)
  SELECT l_partkey, string_agg(l_linenumber::VARCHAR, ', ' ORDER BY l_linenumber) FILTER (WHERE r <= 4) || CASE WHEN max(n) > 4 THEN ' +' || (max(n) - 4) ELSE '' END AS sites FROM n GROUP BY 1""")
def site_lists(spark, sf_dir):
    """Distinct lines that use a part: the first four and how many more."""
    rows = V.first_few(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_linenumber", 4)
    more = F.when(F.col("n") > 4, F.concat(F.lit(" +"), (F.col("n") - 4).cast("string"))).otherwise(F.lit(""))
    return rows.select("l_partkey", F.concat(F.array_join(F.transform("items", lambda x: x.cast("string")), ", "), more).alias("sites"))


@query("relationship_groups", facts_sql(f"""SELECT from_ref AS owner, {verb_sql('out', 'r.kind')} AS verb, coalesce(o.path, '(outside)') AS file, count(*) AS targets, min(to_ref) AS first
  FROM relations r LEFT JOIN objects o ON r.to_ref = o.entity_ref GROUP BY ALL"""))
def relationship_groups(spark, sf_dir):
    """Edges grouped by owner and verb, then by the target's file."""
    g = fact_graph(spark, sf_dir)
    files = g.objects.select("entity_ref", F.col("path").alias("file"))
    rows = g.relations.join(files, F.col("to_ref") == F.col("entity_ref"), "left")
    rows = rows.select(F.col("from_ref").alias("owner"), V.verb(F.col("kind"), "out").alias("verb"), F.coalesce("file", F.lit("(outside)")).alias("file"), "to_ref")
    return rows.groupBy("owner", "verb", "file").agg(F.count("*").alias("targets"), F.min("to_ref").alias("first"))


@query("unresolved_targets", facts_sql("""SELECT to_ref AS target, count(*) FILTER (WHERE from_ref[-1:] = '7') AS library, count(*) FILTER (WHERE from_ref[-1:] = '3') AS unknown
  FROM relations WHERE kind = 'CALLS' AND from_ref[-1:] IN ('3', '7') GROUP BY 1"""))
def unresolved_targets(spark, sf_dir):
    """Unresolved calls by their target's text, a library's apart."""
    rows = resolved_calls(spark, sf_dir).filter("not resolved").groupBy(F.col("to_ref").alias("target"))
    return rows.agg(F.count_if("library").alias("library"), F.count_if(~F.col("library")).alias("unknown"))


@query("trace_stops", facts_sql("""SELECT CASE WHEN from_ref[-1:] = '7' THEN 'computed key' WHEN from_ref[-1:] = '3' THEN 'no implementation' ELSE 'function value' END AS reason, to_ref AS target, count(*) AS stops
  FROM relations WHERE kind = 'CALLS' AND from_ref[-1:] IN ('3', '7', '9') GROUP BY ALL"""))
def trace_stops(spark, sf_dir):
    """Where a trace cannot go on, by reason and target."""
    last = F.substr(F.col("from_ref"), F.lit(-1))
    rows = fact_graph(spark, sf_dir).relations.filter((F.col("kind") == "CALLS") & last.isin("3", "7", "9"))
    reason = F.when(last == "7", F.lit("computed key")).when(last == "3", F.lit("no implementation")).otherwise(F.lit("function value"))
    return rows.groupBy(reason.alias("reason"), F.col("to_ref").alias("target")).agg(F.count("*").alias("stops"))


@query("grouped_notes", """WITH d AS (SELECT DISTINCT event_type, user_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM d)
  SELECT event_type AS kind, count(*) AS n, string_agg(user_id::VARCHAR, ', ' ORDER BY user_id) FILTER (WHERE r <= 8) AS subjects FROM r GROUP BY 1""")
def grouped_notes(spark, sf_dir):
    """Notes of one kind as one line with the first eight subjects."""
    rows = V.first_few(table(spark, sf_dir, "events"), ["event_type"], "user_id", 8)
    return rows.select(F.col("event_type").alias("kind"), "n", F.array_join(F.transform("items", lambda x: x.cast("string")), ", ").alias("subjects"))


@query("entries_by_label", f"""WITH {ITEMS}, e AS (SELECT l_partkey, l_suppkey AS label, o_orderdate < TIMESTAMP '{CUTOFF}' AS certain, l_orderkey, l_linenumber FROM items)
  SELECT l_partkey, label, certain, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, label ORDER BY certain DESC, l_orderkey, l_linenumber) AS r FROM e) WHERE r = 1""")
def entries_by_label(spark, sf_dir):
    """One entry for each label: a certain one before others, then the first."""
    rows = items_of(spark, sf_dir).select("l_partkey", F.col("l_suppkey").alias("label"), before().alias("certain"), "l_orderkey", "l_linenumber")
    best = F.min(F.struct((~F.col("certain")).alias("uncertain"), "l_orderkey", "l_linenumber")).alias("e")
    return rows.groupBy("l_partkey", "label").agg(best).select("l_partkey", "label", (~F.col("e.uncertain")).alias("certain"), "e.l_orderkey")


@query("left_without_callers", facts_sql("SELECT DISTINCT l_partkey FROM u WHERE base AND l_partkey NOT IN (SELECT l_partkey FROM u WHERE NOT base)",
    f"u AS (SELECT l_partkey, o_orderdate < TIMESTAMP '{CUTOFF}' AS base FROM lineitem JOIN owned ON l_orderkey = o_orderkey JOIN orders USING (o_orderkey) WHERE path NOT LIKE '%/tests/%')"))
def left_without_callers(spark, sf_dir):
    """Parts whose last caller outside of tests went between the versions (orders before and since a date)."""
    paths = fact_graph(spark, sf_dir).objects.filter("kind = 'METHOD'").select(F.col("start").alias("p_key"), "path")
    rows = items_of(spark, sf_dir).join(paths, F.col("l_orderkey") == F.col("p_key")).filter(~is_test(F.col("path")))
    sides = rows.groupBy("l_partkey").agg(F.bool_or(before()).alias("base"), F.bool_or(~before()).alias("working"))
    return sides.filter("base and not working").select("l_partkey")


@query("sibling_ordinals", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS ordinal FROM lineitem")
def sibling_ordinals(spark, sf_dir):
    """Order of siblings with one name in their scope."""
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).alias("ordinal"))


# --- orders, limits, pages

@query("members_in_source_order", """SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'N', l_returnflag, l_linenumber, l_partkey) AS INT) AS position FROM lineitem""")
def members_in_source_order(spark, sf_dir):
    """Members of a scope: those of the home file (flag N) first, then by file and position."""
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_returnflag") != "N", "l_returnflag", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("position"))


@query("capped_list", """SELECT p_partkey, p_size, (SELECT greatest(count(*) - 20, 0) FROM part) AS remainder FROM part ORDER BY p_size DESC, p_partkey LIMIT 20""")
def capped_list(spark, sf_dir):
    """A report's list: the first twenty and how many more."""
    return V.with_remainder(table(spark, sf_dir, "part").select("p_partkey", "p_size"), [F.desc("p_size"), F.asc("p_partkey")], 20)


@query("offset_page", """SELECT c_custkey, c_name, (SELECT count(*) FROM customer) > 120 AS more FROM customer ORDER BY c_name, c_custkey LIMIT 40 OFFSET 80""")
def offset_page(spark, sf_dir):
    return V.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 80, 40)


@query("keyset_page", """SELECT s_name, s_suppkey FROM supplier WHERE s_name > 'Supplier#000000003' ORDER BY s_name LIMIT 25""")
def keyset_page(spark, sf_dir):
    return V.after(table(spark, sf_dir, "supplier").select("s_name", "s_suppkey"), "s_name", "Supplier#000000003", 25)


@query("resumed_scan", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2)""")
def resumed_scan(spark, sf_dir):
    """What a scan has left behind its cursor (file, line)."""
    return V.resumed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], (100, 2))


@query("directory_tiers", """SELECT coalesce(source, '') AS directory, sum(octet_length(text::BLOB))::BIGINT AS bytes,
  CASE WHEN sum(octet_length(text::BLOB)) <= 24576 THEN 'detailed' WHEN sum(octet_length(text::BLOB)) <= 65536 THEN 'compact' ELSE 'modules' END AS tier FROM documents WHERE text IS NOT NULL GROUP BY 1""".replace("text::BLOB", "encode(text)"))
def directory_tiers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return V.tiers(docs.select(F.coalesce("source", F.lit("")).alias("directory"), F.octet_length("text").cast("long").alias("bytes")))


# --- sets

@query("fact_paths", facts_sql("SELECT path FROM objects UNION SELECT path FROM relations"))
def fact_paths(spark, sf_dir):
    """Paths that have any facts."""
    g = fact_graph(spark, sf_dir)
    return g.objects.select("path").unionByName(g.relations.select("path")).distinct()


@query("candidate_paths", """SELECT DISTINCT p_brand || '/' || p_type AS path FROM part WHERE p_brand || '/' || p_type IN (SELECT p_brand || '/' || p_type FROM part WHERE list_contains(string_split(p_name, ' '), 'red'))
  AND p_brand || '/' || p_type IN (SELECT p_brand || '/' || p_type FROM part WHERE list_contains(string_split(p_name, ' '), 'widget'))""")
def candidate_paths(spark, sf_dir):
    """Documents (the names of a brand's parts of one type) that hold both terms, by posting lists."""
    docs = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("path"), F.split("p_name", " ").alias("words"))
    return V.containing_all(docs, ["red", "widget"])


@query("candidate_objects", """SELECT p_partkey, p_name FROM part WHERE p_brand || '/' || p_type IN (SELECT p_brand || '/' || p_type FROM part WHERE list_contains(string_split(p_name, ' '), 'red'))
  AND p_brand || '/' || p_type IN (SELECT p_brand || '/' || p_type FROM part WHERE list_contains(string_split(p_name, ' '), 'widget'))""")
def candidate_objects(spark, sf_dir):
    """Objects in the candidate documents."""
    part = table(spark, sf_dir, "part").withColumn("path", F.concat_ws("/", "p_brand", "p_type"))
    return part.join(candidate_paths(spark, sf_dir), "path", "left_semi").select("p_partkey", "p_name")


@query("moved_out_names", f"""WITH {ITEMS} SELECT DISTINCT l_suppkey, p_name FROM items JOIN part ON l_partkey = p_partkey WHERE o_orderdate < TIMESTAMP '{CUTOFF}'
  EXCEPT SELECT DISTINCT l_suppkey, p_name FROM items JOIN part ON l_partkey = p_partkey WHERE o_orderdate >= TIMESTAMP '{CUTOFF}'""")
def moved_out_names(spark, sf_dir):
    """Names that a file (a supplier) had in the base version and has no longer."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = items_of(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    sides = rows.groupBy("l_suppkey", "p_name").agg(F.bool_or(before()).alias("base"), F.bool_or(~before()).alias("working"))
    return sides.filter("base and not working").select("l_suppkey", "p_name")


@query("removed_after_renames", f"""WITH {ITEMS}, d AS (SELECT p_brand AS path, p_type AS kind, p_name AS name, o_orderdate < TIMESTAMP '{CUTOFF}' AS base FROM items JOIN part ON l_partkey = p_partkey)
  SELECT DISTINCT CASE path WHEN 'Brand#1' THEN 'Brand#2' WHEN 'Brand#3' THEN 'Brand#4' ELSE path END AS path, kind, name FROM d WHERE base EXCEPT SELECT path, kind, name FROM d WHERE NOT base""")
def removed_after_renames(spark, sf_dir):
    """Declarations (brand, type, name) of the base that the working version lacks, where two files were renamed."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("path"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"))
    rows = items_of(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    renames = spark.createDataFrame([("Brand#1", "Brand#2"), ("Brand#3", "Brand#4")], "old string, new string")
    return V.removed_declarations(rows.filter(before()), rows.filter(~before()), renames)


# --- joins

@query("context_inputs", """WITH c AS (SELECT l_orderkey AS context, list(DISTINCT l_partkey) AS inputs FROM lineitem GROUP BY 1), u AS (SELECT context, unnest(inputs) AS input FROM c)
  SELECT p_brand AS file, count(*) AS contexts, count(DISTINCT input) AS inputs FROM u JOIN part ON input = p_partkey GROUP BY 1""")
def context_inputs(spark, sf_dir):
    """Contexts keep their input files in an array: how many contexts and inputs each brand has."""
    contexts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("inputs"))
    rows = contexts.select("l_orderkey", F.explode("inputs").alias("input")).join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("file")), F.col("input") == F.col("p_partkey"))
    return rows.groupBy("file").agg(F.count("*").alias("contexts"), F.countDistinct("input").alias("inputs"))


@query("contexts_with_results", """SELECT c_custkey, count(o_orderkey) AS results, coalesce(max(o_orderstatus), 'NONE') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def contexts_with_results(spark, sf_dir):
    """All contexts, with their results or none."""
    results = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("results"), F.max("o_orderstatus").alias("status"))
    rows = table(spark, sf_dir, "customer").join(results, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("status", F.lit("NONE")).alias("status"))


@query("nearest_package_root", facts_sql("""SELECT p.path, max_by(m.dir, length(m.dir)) AS root FROM (SELECT DISTINCT path FROM objects) p LEFT JOIN m ON p.path = m.dir OR starts_with(p.path, m.dir || '/') GROUP BY 1""",
    "m AS (SELECT r_name AS dir FROM region WHERE r_regionkey % 2 = 0 UNION SELECT n_path FROM places WHERE length(n_name) < 7)"))
def nearest_package_root(spark, sf_dir):
    """Manifests lie in every other region and in nations of short names; each path's nearest one above."""
    g = fact_graph(spark, sf_dir)
    number = F.substring_index("entity_ref", ":", -1).cast("int")
    found = g.objects.filter(((F.col("kind") == "PACKAGE") & (number % 2 == 0)) | ((F.col("kind") == "FILE") & (F.length("name") < 7)))
    return V.package_roots(g.objects.select("path").distinct(), found.select(F.col("path").alias("dir")))


@query("mirrored_tests", facts_sql("""SELECT DISTINCT f.path, t.path AS test FROM customers t JOIN objects f ON f.path = t.n_path || '/customer' WHERE t.path LIKE '%/tests/%'"""))
def mirrored(spark, sf_dir):
    """Directories and the test directories that mirror them."""
    paths = fact_graph(spark, sf_dir).objects.select("path").distinct()
    tests = paths.filter(is_test(F.col("path"))).withColumn("tree", F.regexp_extract("path", "^(.*?)/tests/", 1))
    return V.mirrored_tests(paths.filter(~is_test(F.col("path"))), tests)


@query("nested_parents", """WITH s AS (SELECT DISTINCT l_orderkey AS place, l_linenumber AS ref, l_linenumber - CAST(floor(l_quantity) AS INT) % 4 AS start, l_linenumber + CAST(floor(l_quantity) AS INT) % 5 AS "end" FROM lineitem)
  SELECT a.place, a.ref, arg_min(b.ref, (b."end" - b.start) * 1000 - b.ref) AS parent FROM s a LEFT JOIN s b ON a.place = b.place AND a.ref <> b.ref AND b.start <= a.start AND b."end" >= a."end"
    AND (b.start <> a.start OR b."end" <> a."end" OR b.ref < a.ref) GROUP BY ALL""")
def nested(spark, sf_dir):
    """The innermost span around each span of a file."""
    q = F.col("l_quantity").cast("int")
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("place"), F.col("l_linenumber").alias("ref"), (F.col("l_linenumber") - q % 4).alias("start"), (F.col("l_linenumber") + q % 5).alias("end"))
    return V.nested_parents(spans.distinct())


# --- callers, closures

OVERRIDES = "ov AS (SELECT 'P:' || p_partkey AS member, 'P:' || first_value(p_partkey) OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS base FROM part), o AS (SELECT *, count(*) OVER (PARTITION BY base) = 1 AS sole FROM ov WHERE member <> base)"


def overrides(spark, sf_dir):
    """Parts of one brand and name override the first of them."""
    part = table(spark, sf_dir, "part")
    base = part.groupBy(F.col("p_brand").alias("b_brand"), F.col("p_name").alias("b_name")).agg(F.min("p_partkey").alias("base"))
    rows = part.join(base, (F.col("p_brand") == F.col("b_brand")) & (F.col("p_name") == F.col("b_name"))).filter("p_partkey != base")
    return rows.select(ref("P", "p_partkey").alias("from_ref"), ref("P", "base").alias("to_ref"))


@query("dispatch_edges", f"WITH {OVERRIDES} SELECT base, member, sole FROM o")
def dispatch_edges(spark, sf_dir):
    return V.overridden(overrides(spark, sf_dir))


@query("callers_of", facts_sql("""SELECT callee, caller, bool_or(certain) AS certain FROM (
    SELECT to_ref AS callee, from_ref AS caller, true AS certain FROM relations WHERE kind = 'CALLS' UNION ALL SELECT member, from_ref, sole FROM o JOIN relations ON kind = 'CALLS' AND to_ref = base) GROUP BY 1, 2""", OVERRIDES))
def callers_of(spark, sf_dir):
    """Direct and dispatched callers of every declaration."""
    calls = fact_graph(spark, sf_dir).relations.filter("kind = 'CALLS'")
    return V.caller_edges(calls, overrides(spark, sf_dir))


@query("implicit_callers", facts_sql("""SELECT 'O:' || o_orderkey AS callee, r.from_ref AS caller FROM orders JOIN relations r ON r.kind = 'CONTAINS' AND r.to_ref = 'C:' || o_custkey WHERE o_orderstatus = 'F'"""))
def implicit_callers(spark, sf_dir):
    """Finished orders run where their customer is used, as constructors do: the users of the class are their callers."""
    g = fact_graph(spark, sf_dir)
    implicit = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(ref("O", "o_orderkey").alias("member"), ref("C", "o_custkey").alias("owner"))
    holders = g.relations.filter("kind = 'CONTAINS'")
    none = g.relations.filter("kind = 'OVERRIDES'")
    rows = V.caller_edges(holders, none, implicit)
    return rows.join(implicit.select(F.col("member").alias("callee"), F.col("owner")), "callee").filter("caller != owner").select("callee", "caller")


@query("uses_without_calls", f"WITH {OVERRIDES} SELECT base AS node, count(*) AS uses FROM o GROUP BY 1")
def uses_without_calls(spark, sf_dir):
    """Uses of a declaration that are no calls."""
    relations = fact_graph(spark, sf_dir).relations.unionByName(overrides(spark, sf_dir).select("*", F.lit("OVERRIDES").alias("kind"), F.lit("catalog").alias("path")))
    return relations.filter(F.col("kind").isin(*V.USES_WITHOUT_CALLS)).groupBy(F.col("to_ref").alias("node")).agg(F.count("*").alias("uses"))


@query("test_entries", facts_sql("SELECT DISTINCT node FROM walk WHERE node LIKE 'O:%'", """e AS (SELECT to_ref AS src, from_ref AS dst FROM relations WHERE kind = 'CALLS' AND (path LIKE '%/tests/%' OR path = 'catalog')),
  walk AS (SELECT 'S:3' AS node, 0 AS level UNION SELECT e.dst, level + 1 FROM walk JOIN e ON e.src = node WHERE level < 4)"""))
def test_entries(spark, sf_dir):
    """Up to four calls from a supplier's code to test methods, through test code and the catalog."""
    calls = fact_graph(spark, sf_dir).relations.filter((F.col("kind") == "CALLS") & (is_test(F.col("path")) | (F.col("path") == "catalog")))
    return G.bfs(settled(G.directed(calls, "INCOMING")), seeds(spark, "S:3"), 4).filter(F.col("node").startswith("O:")).select("node")


@query("importer_closure", facts_sql("""SELECT node, CASE WHEN min(level) = 1 THEN 2 ELSE 4 END AS rank FROM walk WHERE level > 0 AND node <> 'S:5' GROUP BY 1""",
    "walk AS (SELECT 'S:5' AS node, 0 AS level UNION SELECT from_ref, level + 1 FROM walk JOIN relations ON to_ref = node WHERE level < 3 AND kind = 'CALLS')"))
def importer_closure(spark, sf_dir):
    """What imports a changed file: rank 2 directly, 4 over up to three steps."""
    return V.importers(fact_graph(spark, sf_dir).relations.filter("kind = 'CALLS'"), seeds(spark, "S:5"))


@query("module_groups", "SELECT 'C:' || c_custkey AS node, min('C:' || c_custkey) OVER (PARTITION BY c_nationkey) AS label FROM customer UNION ALL SELECT 'N:' || c_nationkey, min('C:' || c_custkey) FROM customer GROUP BY c_nationkey")
def module_groups(spark, sf_dir):
    """Modules that a workspace (a nation) joins, by least labels."""
    return V.groups(table(spark, sf_dir, "customer").select(ref("C", "c_custkey").alias("u"), ref("N", "c_nationkey").alias("v")))


# --- paths

NAMES = [
    "a/yarn.lock", "pkg/pom.xml", "requirements-dev.txt", "db/Migrations/01.py", "x/schema.SQL", ".env.local", "k8s/app.YML", "web/Index.HTML", "run.sh", "style.SCSS", "vendor/lib/", "README.md", "LICENSE-MIT",
    "image.png", "src/a.test.ts", "src/TestCase.java", "src/TestÜber.java", "src/__tests__/b.jsx", "src/generated/c.go", "e2e/login.e2e-spec.ts", "pkg/a_test.go", "test_x.py", "IT1.kt", "docs/Guide.rst", "setup.cfg",
]


def kind_sql() -> str:
    rules = lambda table: " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{k}'" for k, p in table.items())
    return f"CASE {rules(P.NON_CODE)} WHEN doc_id % 7 = 0 THEN 'binary file' WHEN regexp_matches(path, '{P.DOCUMENTATION}') THEN NULL {rules(P.UNANALYZED)} ELSE 'unanalyzed file' END"


def flag_sql(pattern: str) -> str:
    return f"regexp_matches(path, '{pattern}')"


@query("unmapped_kinds", f"""WITH f AS (SELECT doc_id, ({NAMES!r})[doc_id % {len(NAMES)} + 1] AS path FROM documents)
  SELECT path, {kind_sql()} AS kind, {flag_sql(P.TEST_PATH)} AS test, {flag_sql(P.RUNNABLE_TEST)} AS runnable, {flag_sql(P.GENERATED_PATH)} AS generated, {flag_sql(P.MIGRATION_PATH)} AS migration, count(*) AS n FROM f GROUP BY ALL""")
def unmapped_kinds(spark, sf_dir):
    """What files are by their names (dealt to documents in turn; every seventh is binary)."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select("doc_id", name.alias("path"))
    path = F.col("path")
    flags = [P.is_test(path).alias("test"), P.is_runnable_test(path).alias("runnable"), P.is_generated(path).alias("generated"), P.is_migration(path).alias("migration")]
    return files.groupBy("path", P.unmapped_kind(path, F.col("doc_id") % 7 == 0).alias("kind"), *flags).agg(F.count("*").alias("n"))


# --- functions

@query("json_fields", """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("digests_and_encodings", """SELECT p_partkey, sha1(p_name) AS sha1, md5(p_name) AS md5, sha256(p_name) AS sha256, base64(encode(p_name)) AS b64, lower(hex(encode(p_name))) AS hex FROM part""")
def digests_and_encodings(spark, sf_dir):
    data = F.col("p_name").cast("binary")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.sha1(data).alias("sha1"), F.md5(data).alias("md5"), F.sha2(data, 256).alias("sha256"), F.base64(data).alias("b64"), F.lower(F.hex(data)).alias("hex")
    )
