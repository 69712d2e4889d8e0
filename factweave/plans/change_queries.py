"""Queries of change, store, view and ledger operators over the driver tables, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F, Window

from factweave.functions import paths as P
from factweave.operators import changes as C
from factweave.plans.graph_queries import facts_sql
from factweave.plans.text_queries import FILES, TEST_SQL, files
from factweave.sources import store
from factweave.sources.driver_tables import fact_graph, table
from factweave.streaming import ledger

QUERIES, ORACLES = {}, {}
CUTOFF = "1996-01-01"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- diffs and edits

@query("diff_hunks", """SELECT conv_id, 'conv/' || conv_id || '.txt' AS path, 'CHANGED' AS status, CAST(turn * 10 + 1 AS INT) AS base_start, CAST(len(l) AS INT) AS base_count,
    CAST(turn * 10 + 1 AS INT) AS now_start, 1 AS now_count, array_to_string(l, chr(10)) AS removed
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL)""")
def diff_hunks(spark, sf_dir):
    """Each turn as the removed lines of a hunk, written as a diff and read again."""
    turns = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null and text is not null")
    old = F.split("text", "\n")
    at = (F.col("turn") * 10 + 1).cast("string")
    head = F.format_string("@@ -%s,%d +%s @@", at, F.size(old), at)
    name = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".txt"))
    hunk = F.concat_ws("\n", F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name), head, F.array_join(F.transform(old, lambda x: F.concat(F.lit("-"), x)), "\n"), F.lit("+now"))
    found = C.diff_hunks(turns.select("conv_id", hunk.alias("diff")), "conv_id")
    return found.withColumn("removed", F.array_join("removed", "\n"))


@query("existing_tests_changed")
def existing_tests_changed(spark, sf_dir):
    """For each turn, whether the next one keeps its words in order (an edit that only adds)."""
    t = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = t.withColumn("next", F.lead("text").over(w)).filter("text is not null and next is not null")
    return rows.select("conv_id", "turn", C.keeps_sequence(F.split("text", r"\s+"), F.split("next", r"\s+")).alias("only_added"))


@query("replay_closure", """WITH RECURSIVE reads AS (SELECT DISTINCT c_custkey AS context, p_brand || '/' || p_type AS file
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
  c(context) AS (SELECT min(context) FROM reads UNION SELECT b.context FROM c JOIN reads a ON a.context = c.context JOIN reads b ON a.file = b.file)
  SELECT context FROM c WHERE context IS NOT NULL""")
def replay_closure(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    reads = items.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    reads = reads.select(F.col("c_custkey").alias("context"), F.concat_ws("/", "p_brand", "p_type").alias("file"))
    return C.replay_closure(reads, reads.agg(F.min("context").alias("context")).filter("context is not null")).select("context")


# --- removed and changed declarations

@query("outermost_removed", facts_sql("""SELECT ref FROM removed r WHERE NOT EXISTS (SELECT 1 FROM relations c JOIN removed p ON c.from_ref = p.ref WHERE c.kind = 'CONTAINS' AND c.to_ref = r.ref)""",
    "removed AS (SELECT 'C:' || c_custkey AS ref FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'O:' || o_orderkey FROM orders WHERE o_orderstatus = 'P')"))
def outermost_removed(spark, sf_dir):
    ref = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string")).alias("ref")
    removed = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(ref("C:", "c_custkey"))
    removed = removed.unionByName(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(ref("O:", "o_orderkey")))
    return C.outermost(removed, fact_graph(spark, sf_dir).relations.filter("kind = 'CONTAINS'"))


def part_users(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query("callers_before_after", f"""WITH u AS (SELECT l_partkey, o_custkey, bool_or(o_orderdate >= DATE '{CUTOFF}') AS now, bool_or(o_orderdate < DATE '{CUTOFF}') AS before FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
  SELECT l_partkey, count(*) FILTER (before) AS before, count(*) FILTER (now) AS now, count(*) FILTER (now AND NOT before) AS gained, count(*) FILTER (before AND NOT now) AS lost FROM u GROUP BY 1""")
def callers_before_after(spark, sf_dir):
    return C.users_before_after(part_users(spark, sf_dir), "l_partkey", "o_custkey", F.col("o_orderdate") >= F.lit(CUTOFF).cast("date"))


@query("still_used_removed", f"""SELECT p_partkey, count(*) AS uses, min(o_orderkey) AS first_user FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  WHERE p_size > 45 AND o_orderdate >= DATE '{CUTOFF}' GROUP BY 1""")
def still_used_removed(spark, sf_dir):
    removed = table(spark, sf_dir, "part").filter("p_size > 45").select("p_partkey")
    used = part_users(spark, sf_dir).filter(F.col("o_orderdate") >= F.lit(CUTOFF).cast("date"))
    return used.join(removed, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey").agg(F.count("*").alias("uses"), F.min("o_orderkey").alias("first_user"))


NAMES_SQL = """l AS (SELECT page_id, lower(unnest(regexp_extract_all(html, 'href="/([a-zA-Z]+)"', 1))) AS name FROM pages),
  d AS (SELECT name, bool_or(role = 'user') AS now FROM (SELECT role, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM conversations) GROUP BY 1)"""


def linked_names(spark, sf_dir):
    names = F.explode(F.regexp_extract_all("html", F.lit('href="/([a-zA-Z]+)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", names.alias("link")).select("page_id", F.lower("link").alias("name"))


def declared_names(spark, sf_dir):
    """Words of conversations as names, and whether the later version (the user's turns) has them too."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    return table(spark, sf_dir, "conversations").select("role", words.alias("name")).groupBy("name").agg(F.bool_or(F.col("role") == "user").alias("now"))


@query("broken_template_links", f"WITH {NAMES_SQL} SELECT name, count(*) AS broken FROM l JOIN d USING (name) WHERE NOT now GROUP BY 1")
def broken_template_links(spark, sf_dir):
    """Links to names that the base declares and that the later version does not."""
    gone = declared_names(spark, sf_dir).filter("not now")
    return linked_names(spark, sf_dir).join(gone, "name", "left_semi").groupBy("name").agg(F.count("*").alias("broken"))


@query("missing_packages", f"WITH {NAMES_SQL} SELECT name, count(*) AS uses, count(DISTINCT page_id) AS pages FROM l ANTI JOIN d USING (name) GROUP BY 1")
def missing_packages(spark, sf_dir):
    """Names that pages link to and that nothing declares."""
    used = linked_names(spark, sf_dir).join(declared_names(spark, sf_dir), "name", "left_anti")
    return used.groupBy("name").agg(F.count("*").alias("uses"), F.countDistinct("page_id").alias("pages"))


# --- references and views

@query("references_by_kind", facts_sql("""SELECT r.to_ref, r.kind, coalesce(c.from_ref, r.from_ref) AS owner, count(*) AS sites FROM relations r LEFT JOIN relations c ON c.kind = 'CONTAINS' AND c.to_ref = r.from_ref
  WHERE r.kind <> 'CONTAINS' GROUP BY 1, 2, 3"""))
def references_by_kind(spark, sf_dir):
    """Uses of all declarations at once, by kind and by the declaration that holds the site."""
    relations = fact_graph(spark, sf_dir).relations
    holder = relations.filter("kind = 'CONTAINS'").select(F.col("to_ref").alias("held"), F.col("from_ref").alias("holder"))
    uses = relations.filter("kind != 'CONTAINS'").join(holder, F.col("from_ref") == F.col("held"), "left")
    return uses.groupBy("to_ref", "kind", F.coalesce("holder", "from_ref").alias("owner")).agg(F.count("*").alias("sites"))


@query("imported_by", facts_sql(f"""SELECT r.to_ref, count(DISTINCT r.from_ref) FILTER (NOT {TEST_SQL}) AS importers, count(DISTINCT r.from_ref) FILTER ({TEST_SQL}) AS tests FROM relations r WHERE kind IN ('IMPORTS', 'CALLS') GROUP BY 1"""))
def imported_by(spark, sf_dir):
    used = fact_graph(spark, sf_dir).relations.filter("kind in ('IMPORTS', 'CALLS')")
    test = P.is_test(F.col("path"))
    per = used.groupBy("to_ref", "from_ref").agg(F.bool_or(test).alias("test"), F.bool_or(~test).alias("code"))
    return per.groupBy("to_ref").agg(F.count_if("code").alias("importers"), F.count_if("test").alias("tests"))


@query("members_elsewhere", facts_sql("""SELECT p.path AS home, c.path AS path, count(*) AS members FROM relations r JOIN objects p ON p.entity_ref = r.from_ref JOIN objects c ON c.entity_ref = r.to_ref
  WHERE r.kind = 'CONTAINS' AND p.path <> c.path GROUP BY 1, 2"""))
def members_elsewhere(spark, sf_dir):
    g = fact_graph(spark, sf_dir)
    home = g.objects.select(F.col("entity_ref").alias("from_ref"), F.col("path").alias("home"))
    member = g.objects.select(F.col("entity_ref").alias("to_ref"), "path")
    held = g.relations.filter("kind = 'CONTAINS'").select("from_ref", "to_ref").join(home, "from_ref").join(member, "to_ref")
    return held.filter("home != path").groupBy("home", "path").agg(F.count("*").alias("members"))


@query("support_tests", facts_sql(f"""SELECT p.path AS dir, count(*) AS tests FROM (SELECT DISTINCT path FROM objects WHERE kind IN ('FILE', 'PACKAGE')) p JOIN objects t ON starts_with(t.path, p.path || '/') WHERE {TEST_SQL.replace('path', 't.path')} GROUP BY 1"""))
def support_tests(spark, sf_dir):
    """Tests at or below each directory: a test meets the directories by the prefixes of its own path."""
    objects = fact_graph(spark, sf_dir).objects
    dirs = objects.filter("kind in ('FILE', 'PACKAGE')").select(F.col("path").alias("dir")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tests = objects.filter(P.is_test(F.col("path")) & (F.size(parts) > 1)).groupBy("path").agg(F.count("*").alias("n")).select("n", F.explode(above).alias("dir"))
    return tests.join(dirs, "dir").groupBy("dir").agg(F.sum("n").alias("tests"))


@query("object_notes", """SELECT conv_id, turn, CAST(rk AS INT) AS rank, bytes FROM (SELECT *, CAST(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY rk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn, text) AS rk FROM conversations) WHERE rk <= 5) WHERE bytes <= 8192""")
def object_notes(spark, sf_dir):
    kind = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    notes = C.top_notes(table(spark, sf_dir, "conversations"), "conv_id", [kind, F.col("turn"), F.col("text")], "text")
    return notes.select("conv_id", "turn", "rank", F.col("bytes").cast("long").alias("bytes"))


@query("overview_text", facts_sql("""SELECT n_path AS path, n_path || ': ' || count(*) FILTER (kind = 'CLASS') || ' classes, ' || count(*) FILTER (kind = 'METHOD') || ' methods' AS line
  FROM objects JOIN places ON starts_with(path, n_path || '/') GROUP BY 1"""))
def overview_text(spark, sf_dir):
    """The line of each module in a directory view."""
    rows = fact_graph(spark, sf_dir).objects.filter("path not like 'catalog/%'").withColumn("parts", F.split("path", "/")).filter("size(parts) > 2")
    module = F.array_join(F.slice("parts", 1, 2), "/").alias("path")
    per = rows.groupBy(module).agg(F.count_if(F.col("kind") == "CLASS").alias("c"), F.count_if(F.col("kind") == "METHOD").alias("m"))
    return per.select("path", F.format_string("%s: %d classes, %d methods", "path", "c", "m").alias("line"))


# --- store and ledger

@query("upsert_roles", """SELECT text, conv_id, role FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY CASE role WHEN 'assistant' THEN 0 ELSE 1 END, conv_id, turn, role) AS rn FROM conversations) WHERE rn = 1""")
def upsert_roles(spark, sf_dir):
    rank = F.when(F.col("role") == "assistant", 0).otherwise(1)
    return C.upsert(table(spark, sf_dir, "conversations"), "text", rank, [F.col("conv_id"), F.col("turn"), F.col("role")]).select("text", "conv_id", "role")


@query("parent_version", f"""WITH {FILES}, d AS (SELECT DISTINCT split_part(path, '/', 2) AS version, sha256(text) AS digest FROM files WHERE text IS NOT NULL), now AS (SELECT digest FROM d WHERE version = (SELECT max(version) FROM d)),
  s AS (SELECT version, count(*) AS own, count(*) FILTER (digest IN (SELECT digest FROM now)) AS shared FROM d WHERE version < (SELECT max(version) FROM d) GROUP BY 1)
  SELECT version, own + (SELECT count(*) FROM now) - 2 * shared AS differing FROM s ORDER BY differing, version DESC LIMIT 1""")
def parent_version(spark, sf_dir):
    """Of the earlier versions (sources) the one that differs in the fewest texts from the last."""
    d = files(spark, sf_dir).filter("text is not null and path is not null").select(F.element_at(F.split("path", "/"), 2).alias("version"), F.sha2("text", 256).alias("digest")).distinct()
    last = d.agg(F.max("version").alias("last"))
    marked = d.crossJoin(F.broadcast(last))  # one row
    per = marked.groupBy("digest", "last").agg(F.collect_set("version").alias("among"))  # as many as there are versions
    per = per.withColumn("in_last", F.array_contains("among", F.col("last")))
    rows = per.select("in_last", "last", F.explode("among").alias("version"))
    sizes = rows.groupBy("version", "last").agg(F.count("*").alias("own"), F.count_if("in_last").alias("shared"))
    size = sizes.filter("version = last").select(F.col("own").alias("now"))
    differing = sizes.filter("version < last").crossJoin(F.broadcast(size)).select("version", (F.col("own") + F.col("now") - 2 * F.col("shared")).alias("differing"))
    return differing.orderBy("differing", F.desc("version")).limit(1)


@query("store_publish", facts_sql("SELECT kind, count(*) AS n, count(DISTINCT path) AS paths FROM objects GROUP BY 1"))
def store_publish(spark, sf_dir):
    """Objects published as a version, checked, and read from there."""
    folder = ledger.new_folder(spark, "store")
    held = store.publish(fact_graph(spark, sf_dir).objects, folder, "1")
    return held.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


@query("streamed_ledger", """SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_check, max(CASE WHEN event_type = 'click' THEN ts END) AS last_edit, count(*) FILTER (event_type = 'click') AS edits FROM events GROUP BY 1""")
def streamed_ledger(spark, sf_dir):
    return ledger.kept_current(spark, f"{sf_dir}/events.parquet")
