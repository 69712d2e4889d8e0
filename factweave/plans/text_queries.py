"""Queries of search, text, version, similarity and route operators over the driver tables, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F, Window

from factweave.functions import paths as P
from factweave.operators import graph as G, routes as R, search as S, similarity as M, text as T, versions as V
from factweave.plans.graph_queries import facts_sql
from factweave.sources.driver_tables import fact_graph, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- search

DEGREE = "deg AS (SELECT node, count(*) AS degree FROM (SELECT from_ref AS node FROM relations UNION ALL SELECT to_ref FROM relations) GROUP BY 1)"
TEST_SQL = "regexp_matches(path, '(^|/)(__tests__|tests?|fixtures?|testfixtures|e2e|testdata)(/|$)', 'i')"
KIND_SQL = "CASE kind WHEN 'CLASS' THEN 600 WHEN 'FUNCTION' THEN 550 WHEN 'METHOD' THEN 550 WHEN 'FILE' THEN 350 ELSE 100 END"


def score_sql(literal: str, words: list[str], keep: str) -> str:
    matched = " + ".join(f"CAST(contains(lower(name), '{w}') OR contains(lower(path), '{w}') AS INT)" for w in words)
    per = " + ".join(f"CASE WHEN contains(lower(name), '{w}') THEN 2000 WHEN contains(lower(path), '{w}') THEN 300 ELSE 0 END" for w in words)
    stem = "regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '')"
    return f"""{DEGREE}, rows AS (SELECT o.*, coalesce(degree, 0) AS degree, {matched} AS matched FROM objects o LEFT JOIN deg ON node = entity_ref WHERE kind <> 'METHOD'),
    scored AS (SELECT entity_ref, kind, name, path, degree, matched, CAST(greatest(
      CASE WHEN lower(name) = '{literal}' THEN 12000 WHEN starts_with(lower(name), '{literal}') THEN 9000 WHEN contains(lower(name), '{literal}') THEN 7000 ELSE 0 END,
      CASE WHEN kind = 'FILE' AND lower({stem}) = '{literal}' THEN 11000 ELSE 0 END)
      + CASE WHEN contains(lower(path), '{literal}') THEN 2500 ELSE 0 END + floor(4000 * matched / {len(words)}.0) + {per} + {KIND_SQL} + least(1200, degree * 20)
      + CASE WHEN {TEST_SQL} THEN -5000 ELSE 300 END + 300 AS BIGINT) AS score FROM rows WHERE {keep})"""


def searchable(spark, sf_dir):
    g = fact_graph(spark, sf_dir)
    rows = g.objects.filter("kind != 'METHOD'").join(G.degree(g.relations), F.col("entity_ref") == F.col("node"), "left")
    return rows.select("entity_ref", "kind", "name", "path", F.lit(None).cast("string").alias("doc"), F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(None).cast("long").alias("focus"))


OUT = ["entity_ref", "name", "path", "matched", "score"]


def register_search(name: str, text: str, mode: str, keep: str) -> None:
    words = S.terms(text)

    @query(name, facts_sql("SELECT entity_ref, name, path, CAST(matched AS INT) AS matched, score FROM scored", score_sql(text.lower(), words, keep)))
    def run(spark, sf_dir):
        return S.ranked(searchable(spark, sf_dir), text, mode).select(*OUT)


register_search("search_any", "redWidget", "ANY", "matched > 0")
register_search("search_all", "europe customer", "ALL", "matched = 2")
register_search("search_literal", "brand#1", "LITERAL", "contains(lower(name), 'brand#1') OR contains(lower(path), 'brand#1')")


@query("search_diversified", facts_sql("""SELECT entity_ref, path, score, rank_in_path, final_score FROM (
  SELECT *, score - greatest(0, rank_in_path - 3) * 400 AS final_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY score DESC, entity_ref) AS INT) AS rank_in_path FROM scored))
  ORDER BY final_score DESC, path, entity_ref LIMIT 200""", score_sql("asia", ["asia"], "matched > 0")))
def search_diversified(spark, sf_dir):
    return S.top(S.diversified(S.ranked(searchable(spark, sf_dir), "ASIA")), 200).select("entity_ref", "path", "score", "rank_in_path", "final_score")


@query("trigram_candidates", """WITH g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(2, length(text) - 1)), lambda i: substr(lower(text), i, 3)))) AS gram FROM documents WHERE length(text) >= 3)
  SELECT doc_id, count(*) AS grams FROM g WHERE gram IN ('lic', 'ice', 'cen', 'ens', 'nse') GROUP BY 1 HAVING count(*) = 5""")
def trigram_candidates(spark, sf_dir):
    return S.trigram_candidates(table(spark, sf_dir, "documents"), "doc_id", "text", "license")


# --- files and text

FILES = "files AS (SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, doc_id, text FROM documents)"


def files(spark, sf_dir):
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), "doc_id", "text")


@query("exact_text_search", f"""WITH {FILES}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM files),
  p AS (SELECT path, line_no, line, string_split(line, 'Apache') AS parts FROM l WHERE contains(line, 'Apache')),
  k AS (SELECT *, unnest(range(1, len(parts))) AS k FROM p)
  SELECT path, line_no, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * 6 + 1 AS INT) AS col_no, substr(line, greatest(1, col_no - 250), col_no - greatest(1, col_no - 250) + 256) AS excerpt FROM k""")
def exact_text_search(spark, sf_dir):
    return T.exact_search(files(spark, sf_dir), "Apache")


@query("read_line_range", f"WITH {FILES} SELECT path, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS range, len(string_split(text, chr(10))) AS n_lines FROM files WHERE len(string_split(text, chr(10))) >= 2")
def read_line_range(spark, sf_dir):
    return T.line_range(files(spark, sf_dir), 2, 3)


STATE_SQL = "CASE WHEN text IS NULL THEN 'NOT_READABLE' WHEN contains(text, chr(0)) THEN 'NON_TEXT' ELSE 'TEXT' END"


@query("path_status", f"""WITH {FILES}, st AS (SELECT path, {STATE_SQL} AS s FROM files), wanted AS (SELECT path FROM files UNION ALL SELECT DISTINCT split_part(path, '/', 1) || '/src1' FROM files UNION ALL SELECT DISTINCT split_part(path, '/', 1) || '/none' FROM files),
  dirs AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS d FROM files)
  SELECT w.path, CASE WHEN NOT (w.path LIKE 'en/%' OR w.path LIKE 'de/%') THEN 'RESTRICTED' WHEN s = 'TEXT' THEN 'TEXT_READABLE' WHEN s IS NOT NULL THEN 'KNOWN_NOT_READABLE' WHEN d IS NOT NULL THEN 'DIRECTORY' ELSE 'NOT_INCLUDED' END AS status
  FROM wanted w LEFT JOIN st ON w.path = st.path LEFT JOIN dirs ON w.path = d""")
def path_status(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("entry_state", T.entry_state(F.col("text")))
    top = F.substring_index("path", "/", 1)
    extra = [f.select(F.concat(top, F.lit(x)).alias("path")).distinct() for x in ("/src1", "/none")]
    return T.path_status(f.select("path").unionByName(extra[0]).unionByName(extra[1]), f, ["en", "de"])


@query("list_files_depth2", f"""WITH {FILES}, e AS (SELECT split_part(path, '/', 1) AS path FROM files UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM files) SELECT DISTINCT path, 'DIRECTORY' AS kind FROM e""")
def list_files(spark, sf_dir):
    return T.listing(files(spark, sf_dir), 2)


@query("file_states", f"WITH {FILES} SELECT path, {STATE_SQL} AS entry_state, CASE WHEN {STATE_SQL} = 'TEXT' THEN sha256(text) END AS content_digest, strlen(text) AS byte_length FROM files")
def file_states(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("entry_state", T.entry_state(F.col("text")))
    return f.select("path", "entry_state", F.when(F.col("entry_state") == "TEXT", F.sha2("text", 256)).alias("content_digest"), F.octet_length("text").alias("byte_length"))


@query("coverage_counts", f"WITH {FILES}, s AS (SELECT {STATE_SQL} AS st, strlen(text) AS n FROM files) SELECT count(*) AS total, count(*) FILTER (WHERE st = 'TEXT') AS readable, count(*) FILTER (WHERE st <> 'TEXT') AS skipped, CAST(sum(n) FILTER (WHERE st = 'TEXT') AS BIGINT) AS bytes FROM s")
def coverage_counts(spark, sf_dir):
    f = file_states(spark, sf_dir)
    text = F.col("entry_state") == "TEXT"
    return f.agg(F.count("*").alias("total"), F.count_if(text).alias("readable"), F.count_if(~text).alias("skipped"), F.sum(F.when(text, F.col("byte_length"))).alias("bytes"))


@query("gap_summary", f"WITH {FILES} SELECT {STATE_SQL} AS code, split_part(path, '/', 1) AS area, count(*) AS n FROM files WHERE {STATE_SQL} <> 'TEXT' GROUP BY 1, 2")
def gap_summary(spark, sf_dir):
    f = file_states(spark, sf_dir).filter("entry_state != 'TEXT'")
    return f.groupBy(F.col("entry_state").alias("code"), F.substring_index("path", "/", 1).alias("area")).agg(F.count("*").alias("n"))


@query("extension_histogram", """WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS path FROM pages),
  e AS (SELECT split_part(path, '/', 2) AS grp, CASE WHEN regexp_matches(path, '\\.[A-Za-z0-9]+$') THEN regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) ELSE '' END AS ext FROM p) SELECT grp, ext, count(*) AS n FROM e GROUP BY 1, 2""")
def extension_histogram(spark, sf_dir):
    path = R.path_of(F.col("url"))
    return table(spark, sf_dir, "pages").groupBy(F.split_part(path, F.lit("/"), F.lit(2)).alias("grp"), F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1).alias("ext")).agg(F.count("*").alias("n"))


@query("external_packages", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS package, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, package LIMIT 20")
def external_packages(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(R.host_of(F.col("url")).alias("package")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "package").limit(20)


# --- versions

@query("unit_sharing", f"WITH {FILES} SELECT sha256(text) AS unit_ref, count(*) AS paths, min(path) AS first_path FROM files GROUP BY 1")
def unit_sharing(spark, sf_dir):
    return V.units(files(spark, sf_dir))


VERSION_SQL = f"""{FILES}, a AS (SELECT path, sha256(text) AS d FROM files WHERE doc_id % 10 <> 0), b AS (SELECT path, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS d FROM files WHERE doc_id % 10 <> 2)"""


def two_versions(spark, sf_dir):
    f = files(spark, sf_dir)
    now = f.filter("doc_id % 10 != 0").select("path", F.sha2("text", 256).alias("digest"))
    before = f.filter("doc_id % 10 != 2").select("path", F.sha2(F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return now, before


@query("version_diff", f"WITH {VERSION_SQL} SELECT CASE WHEN b.path IS NULL THEN 'ADDED' WHEN a.path IS NULL THEN 'REMOVED' WHEN a.d = b.d THEN 'SAME' ELSE 'CHANGED' END AS status, count(*) AS files FROM a FULL JOIN b ON a.path = b.path GROUP BY 1")
def version_diff(spark, sf_dir):
    return V.difference(*two_versions(spark, sf_dir))


@query("orphan_units", f"WITH {VERSION_SQL} SELECT DISTINCT d AS digest FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.d = b.d)")
def orphan_units(spark, sf_dir):
    now, before = two_versions(spark, sf_dir)
    return V.orphans(before.select("digest").distinct(), now, "digest")


@query("incremental_equals_full", f"WITH {VERSION_SQL} SELECT count(*) AS files, count(DISTINCT d) AS units FROM a")
def incremental(spark, sf_dir):
    """The present version built from the one before: kept files, then changed and new ones."""
    now, before = two_versions(spark, sf_dir)
    kept = before.join(now, ["path", "digest"], "left_semi")
    fresh = now.join(before, ["path", "digest"], "left_anti")
    return kept.unionByName(fresh).agg(F.count("*").alias("files"), F.countDistinct("digest").alias("units"))


CUT = "1996-01-01"


@query("change_edges", f"""SELECT o_custkey, l_partkey, CAST(min(l_linenumber) AS INT) AS first_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '{CUT}'
  AND NOT EXISTS (SELECT 1 FROM lineitem l2 JOIN orders o2 ON l2.l_orderkey = o2.o_orderkey WHERE o2.o_orderdate < TIMESTAMP '{CUT}' AND o2.o_custkey = orders.o_custkey AND l2.l_partkey = lineitem.l_partkey) GROUP BY 1, 2""")
def change_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    old = F.col("o_orderdate") < F.lit(CUT).cast("timestamp")
    now = rows.filter(~old).groupBy("o_custkey", "l_partkey").agg(F.min("l_linenumber").alias("first_line"))
    return G.new_edges(now, rows.filter(old), ["o_custkey", "l_partkey"])


ROUTE_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


@query("removed_routes", f"SELECT {ROUTE_SQL} AS route FROM pages WHERE page_id % 3 <> 0 EXCEPT SELECT {ROUTE_SQL} FROM pages WHERE page_id % 3 <> 1")
def removed_routes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", R.path_of(F.col("url")).alias("route"))
    return pages.filter("page_id % 3 != 0").select("route").subtract(pages.filter("page_id % 3 != 1").select("route"))


WORDS_SQL = "unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{4,}')))"


@query("stranded_names", f"""WITH removed AS (SELECT DISTINCT {WORDS_SQL} AS name FROM documents WHERE doc_id % 50 = 0), added AS (SELECT DISTINCT {WORDS_SQL} AS name FROM documents WHERE doc_id % 50 = 1),
  mention AS (SELECT doc_id, {WORDS_SQL} AS name FROM documents WHERE doc_id % 50 > 1) SELECT name, count(*) AS mentions FROM mention WHERE name IN (SELECT name FROM removed) AND name NOT IN (SELECT name FROM added) GROUP BY 1""")
def stranded_names(spark, sf_dir):
    """Names of a removed set of documents, not of an added one, that others still mention."""
    names = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), F.lit(1)))).alias("name"))
    removed = names.filter("doc_id % 50 = 0").select("name").distinct().join(names.filter("doc_id % 50 = 1").select("name"), "name", "left_anti")
    return names.filter("doc_id % 50 > 1").join(removed, "name", "left_semi").groupBy("name").agg(F.count("*").alias("mentions"))


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("line_shift", """WITH h AS (SELECT conv_id, turn * 10 AS base_start, CAST(length(text) % 4 AS BIGINT) AS base_count, CAST(length(text) % 7 AS BIGINT) AS cnt FROM conversations),
  l AS (SELECT DISTINCT conv_id, k AS line FROM conversations, range(0, 80, 3) r(k)),
  j AS (SELECT l.conv_id, l.line, max(h.base_start) AS at, sum(h.cnt - h.base_count) AS shift FROM l LEFT JOIN h ON h.conv_id = l.conv_id AND h.base_start <= l.line GROUP BY 1, 2)
  SELECT j.conv_id, j.line, CAST(CASE WHEN j.at IS NULL THEN j.line WHEN j.line < h.base_start + h.base_count THEN NULL ELSE j.line + j.shift END AS BIGINT) AS working_line
  FROM j LEFT JOIN h ON h.conv_id = j.conv_id AND h.base_start = j.at""")
def line_shift(spark, sf_dir):
    size = F.length("text")
    hunks = turns(spark, sf_dir).select("conv_id", (F.col("turn") * 10).alias("base_start"), (size % 4).cast("long").alias("base_count"), (size % 7).cast("long").alias("count"))
    base = turns(spark, sf_dir).select("conv_id").distinct().withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(78), F.lit(3)))).withColumn("line", F.col("line").cast("long"))
    return V.working_lines(base, hunks, "conv_id")


SPANS_SQL = "s AS (SELECT conv_id, conv_id || ':' || turn AS ref, turn * 5 AS start, turn * 5 + 4 + (length(text) % 40) AS stop FROM conversations), q AS (SELECT DISTINCT conv_id, k AS site, k AS pos FROM conversations, range(0, 40, 7) r(k))"


@query("select_innermost", f"WITH {SPANS_SQL} SELECT conv_id, CAST(site AS BIGINT) AS site, ref FROM (SELECT q.conv_id, site, ref, row_number() OVER (PARTITION BY q.conv_id, site ORDER BY stop - start, ref) AS rn FROM q JOIN s ON q.conv_id = s.conv_id AND start <= pos AND pos <= stop) WHERE rn = 1")
def select_innermost(spark, sf_dir):
    t = turns(spark, sf_dir)
    spans = t.select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("ref"), (F.col("turn") * 5).alias("start"), (F.col("turn") * 5 + 4 + F.length("text") % 40).alias("end"))
    sites = t.select("conv_id").distinct().withColumn("site", F.explode(F.sequence(F.lit(0), F.lit(39), F.lit(7)))).withColumn("site", F.col("site").cast("long")).withColumn("at", F.col("site"))
    return V.innermost(sites, spans, "conv_id").select("conv_id", "site", "ref")


@query("changed_innermost", f"""WITH {SPANS_SQL}, c AS (SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM (VALUES (10, 14), (31, 30)) r(a, b) WHERE a <= stop AND start <= b))
  SELECT conv_id, ref FROM c WHERE NOT EXISTS (SELECT 1 FROM c i WHERE i.conv_id = c.conv_id AND i.ref <> c.ref AND i.start >= c.start AND i.stop <= c.stop AND (i.stop - i.start < c.stop - c.start))""")
def changed_innermost(spark, sf_dir):
    """Declarations that changed lines touch, without those that contain another such."""
    spans = turns(spark, sf_dir).select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("ref"), (F.col("turn") * 5).alias("start"), (F.col("turn") * 5 + 4 + F.length("text") % 40).alias("stop"))
    ranges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((10, 14), (31, 30))])
    hit = spans.filter(F.exists(ranges, lambda r: (r["a"] <= F.col("stop")) & (F.col("start") <= r["b"])))
    inner = hit.select(F.col("conv_id").alias("i_conv"), F.col("ref").alias("i_ref"), F.col("start").alias("i_start"), F.col("stop").alias("i_stop"))
    contains = (F.col("conv_id") == F.col("i_conv")) & (F.col("ref") != F.col("i_ref")) & (F.col("i_start") >= F.col("start")) & (F.col("i_stop") <= F.col("stop")) & (F.col("i_stop") - F.col("i_start") < F.col("stop") - F.col("start"))
    return hit.join(inner, contains, "left_anti").select("conv_id", "ref")


@query("adjacent_hits", """WITH m AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w THEN 0 ELSE 1 END AS fresh FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS island FROM m)
  SELECT conv_id, CAST(island AS BIGINT) AS island, role, count(*) AS hits, min(turn) AS first_turn FROM i GROUP BY 1, 2, 3""")
def adjacent_hits(spark, sf_dir):
    rows = V.islands(turns(spark, sf_dir), ["conv_id", "turn", "text"], "role")
    return rows.groupBy("conv_id", "island", "role").agg(F.count("*").alias("hits"), F.min("turn").alias("first_turn"))


@query("page_budget", "SELECT p_brand, p_partkey, used FROM (SELECT p_brand, p_partkey, CAST(sum(strlen(p_name) + 1) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM part) WHERE used <= 500")
def page_budget(spark, sf_dir):
    return V.byte_page(table(spark, sf_dir, "part"), "p_name", "p_brand", ["p_partkey"], 500).select("p_brand", "p_partkey", "used")


@query("latest_versions", "SELECT user_id, event_id, CAST(rn AS INT) AS rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def latest_versions(spark, sf_dir):
    return V.latest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "rn")


@query("unchecked_edits", """WITH c AS (SELECT user_id, max(ts) AS last_check FROM events WHERE event_type = 'purchase' GROUP BY 1)
  SELECT e.user_id, count(*) AS edits FROM events e LEFT JOIN c ON c.user_id = e.user_id WHERE event_type = 'click' AND (last_check IS NULL OR e.ts > last_check) GROUP BY 1""")
def unchecked_edits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id"))
    rows = e.withColumn("last_check", last).filter((F.col("event_type") == "click") & (F.col("last_check").isNull() | (F.col("ts") > F.col("last_check"))))
    return rows.groupBy("user_id").agg(F.count("*").alias("edits"))


@query("compile_breaks_multiset", """WITH n AS (SELECT user_id, event_type FROM events WHERE day(ts) > 15), b AS (SELECT user_id, event_type FROM events WHERE day(ts) <= 15)
  SELECT user_id, event_type, count(*) AS times FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM b) GROUP BY 1, 2""")
def compile_breaks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return V.multiset_difference(e.filter("day(ts) > 15").select("user_id", "event_type"), e.filter("day(ts) <= 15").select("user_id", "event_type"))


# --- similarity and routes

@query("similar_documents", """WITH w AS (SELECT conv_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM conversations),
  c AS (SELECT id, word, count(*) AS c FROM w GROUP BY 1, 2), d AS (SELECT word, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(DISTINCT id) AS n FROM w),
  r AS (SELECT id, word, (1 + ln(c)) * ln((n + 1) / (df + 1)) AS raw FROM c JOIN d USING (word), n), v AS (SELECT id, word, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w FROM r WHERE raw > 0)
  SELECT a.id AS left_id, b.id AS right_id, round(sum(a.w * b.w), 6) AS cosine FROM v a JOIN v b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.15""")
def similar_documents(spark, sf_dir):
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))
    occurrences = turns(spark, sf_dir).agg(F.sum(F.size(found))).first()[0] or 0
    # a conversation's turns come together before words are counted, so the counts need no shuffle
    words = turns(spark, sf_dir).select("conv_id", "text").repartition("conv_id").select(F.col("conv_id").alias("id"), F.explode(found).alias("word"))
    return M.similar_within(M.weights(words), 0.15, occurrences).withColumn("cosine", F.round("cosine", 6))


@query("route_requests", f"""WITH r AS (SELECT DISTINCT {ROUTE_SQL} AS route FROM pages), q AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"?#]*)', 1)) AS request FROM pages)
  SELECT request, count(DISTINCT page_id) AS pages, count(*) AS times, bool_or(request IN (SELECT route FROM r)) AS served FROM q GROUP BY 1""")
def route_requests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    routes = pages.select(R.path_of(F.col("url")).alias("request")).distinct().withColumn("hit", F.lit(True))
    requests = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"?#]*)'), F.lit(1))).alias("request"))
    per = requests.groupBy("request").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("times"))
    return per.join(routes, "request", "left").select("request", "pages", "times", F.coalesce("hit", F.lit(False)).alias("served"))


ROUTE_SQL = f"""WITH links AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="(/[^"?#]*)', 1)) AS link FROM pages),
  routes AS (SELECT route, list_filter(string_split(route, '/'), lambda s: s <> '') AS r FROM (SELECT DISTINCT '/api/v1' || link || '/:id' AS route FROM links)),
  requests AS (SELECT request, list_filter(string_split(request, '/'), lambda s: s <> '') AS q FROM (SELECT DISTINCT link || '/' || (page_id % 5) AS request FROM links)),
  rp AS (SELECT *, list_transform(r, lambda s: regexp_matches(s, '{R.PARAMETER}') OR regexp_matches(s, '{R.LOOSE_PARAMETER}')) AS rv FROM routes),
  qp AS (SELECT *, list_transform(q, lambda s: regexp_matches(s, '{R.PARAMETER}') OR regexp_matches(s, '{R.LOOSE_PARAMETER}')) AS qv FROM requests),
  n AS (SELECT *, least(len(r), len(q)) AS n FROM rp CROSS JOIN qp),
  f AS (SELECT request, route, len(r) + len(q) - 2 * n AS extras, len(list_filter(rv, lambda v: NOT v)) AS literals FROM n WHERE n > 0
    AND len(list_filter(range(n), lambda i: NOT (rv[len(r) - i] OR (NOT qv[len(q) - i] AND r[len(r) - i] = q[len(q) - i])))) = 0
    AND len(list_filter(range(n), lambda i: NOT rv[len(r) - i] AND length(r[len(r) - i]) >= 3)) > 0
    AND (n >= 2 OR len(list_filter(list_concat(r[:len(r) - n], q[:len(q) - n]), lambda s: NOT regexp_matches(s, '{R.MOUNT}'))) = 0))
  SELECT request, route, CAST(extras AS INT) AS extras, CAST(literals AS INT) AS literals FROM (SELECT *, rank() OVER (PARTITION BY request ORDER BY extras, literals DESC) AS k FROM f) WHERE k = 1"""


@query("route_fit", ROUTE_SQL)
def route_fit(spark, sf_dir):
    """Closest routes, mounted below /api/v1 with a number for a parameter, of each requested path."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"?#]*)'), F.lit(1))).alias("link"))
    routes = links.select(F.concat(F.lit("/api/v1"), F.col("link"), F.lit("/:id")).alias("route")).distinct().withColumn("segs", R.segments(F.col("route")))
    requests = links.select(F.concat("link", F.lit("/"), (F.col("page_id") % 5).cast("string")).alias("request")).distinct().withColumn("segs", R.segments(F.col("request")))
    return R.closest(R.fitting(requests, routes))


@query("template_links", """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)[ >]', 1)) AS tag FROM pages) SELECT lower(tag) AS tag, count(*) AS uses, count(DISTINCT page_id) AS pages FROM t GROUP BY 1""")
def template_links(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)[ >]"), F.lit(1))).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("uses"), F.countDistinct("page_id").alias("pages"))


@query("notes_per_object", """SELECT lang, count(*) AS labelled, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS good, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def notes_per_object(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("path_kinds", f"""WITH {FILES} SELECT split_part(path, '/', 1) AS lang, {TEST_SQL} AS test, count(*) AS n FROM files GROUP BY 1, 2""")
def path_kinds(spark, sf_dir):
    return files(spark, sf_dir).groupBy(F.substring_index("path", "/", 1).alias("lang"), P.is_test(F.col("path")).alias("test")).agg(F.count("*").alias("n"))
