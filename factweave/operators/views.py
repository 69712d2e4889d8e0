"""Operators of views and reports: lists, groups, orders, pages, callers, closures, package roots."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.functions.lineage import settled
from factweave.operators.graph import new_edges

# What an edge is called, by its direction and kind.
VERBS = {
    "out": {"CALLS": "calls", "READS": "uses as value", "WRITES": "writes", "IMPORTS": "imports", "EXTENDS": "extends", "IMPLEMENTS": "implements", "OVERRIDES": "dispatched from", "CONTAINS": "contains"},
    "in": {"CALLS": "called by", "READS": "used as value by", "WRITES": "written by", "IMPORTS": "imported by", "EXTENDS": "extended by", "IMPLEMENTS": "implemented by", "OVERRIDES": "dispatches to", "CONTAINS": "member of"},
}
#: Kinds that use a declaration without calling it.
USES_WITHOUT_CALLS = ["EXTENDS", "IMPLEMENTS", "OVERRIDES", "DECORATED_BY"]


def verb(kind: Column, direction: str) -> Column:
    """The label of an edge; a kind without one reads `references`."""
    out = F.lit("references")
    for name, label in VERBS[direction].items():
        out = F.when(kind == name, F.lit(label)).otherwise(out)
    return out


def first_few(rows: DataFrame, group: list[str], item: str, most: int, parts: int = 16) -> DataFrame:
    """group, items (the least `most` distinct ones, in order), n (of distinct ones).

    Each group is cut into parts by a hash of the item, so that no task sorts a whole group.
    """
    distinct = rows.select(*group, item).distinct().withColumn("_part", F.pmod(F.xxhash64(item), F.lit(parts)))
    rank = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(item))
    ranked = distinct.withColumn("_rank", rank)
    per = ranked.groupBy(*group, "_part").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("_rank") <= most, F.col(item))).alias("items"))
    out = per.groupBy(*group).agg(F.sum("n").alias("n"), F.flatten(F.collect_list("items")).alias("items"))  # parts * most items
    return out.select(*group, F.slice(F.array_sort("items"), 1, most).alias("items"), "n")


def with_remainder(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows in an order, with the number of all rows beyond them."""
    total = rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("remainder"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total))  # one row


def page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """One page, with `more`: whether a row follows it."""
    cut = rows.orderBy(*order).offset(offset).limit(size + 1)
    numbered = cut.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # size + 1 rows
    return numbered.withColumn("more", F.max("_n").over(Window.partitionBy()) > size).filter(F.col("_n") <= size).drop("_n")


def after(rows: DataFrame, key: str, last: str, size: int) -> DataFrame:
    """The page that follows a key."""
    return rows.filter(F.col(key) > last).orderBy(key).limit(size)


def resumed(rows: DataFrame, place: list[str], cursor: tuple) -> DataFrame:
    """Rows whose place comes after the cursor's."""
    return rows.filter(F.struct(*place) > F.struct(*[F.lit(v).alias(c) for c, v in zip(place, cursor)]))


def encode_cursor(secret: bytes, operation: str, scope: list[str], place: dict) -> str:
    """A signed cursor, bound to its operation and scope."""
    digest = hashlib.sha256(json.dumps(sorted(scope)).encode()).hexdigest()
    body = json.dumps({"operation": operation, "scope": digest, "place": place}, sort_keys=True, separators=(",", ":")).encode()
    signature = hmac.new(secret, body, hashlib.sha256).digest()
    return ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (body, signature))


def decode_cursor(secret: bytes, operation: str, scope: list[str], cursor: str) -> dict:
    """The cursor's place; ValueError if it is not whole, or was made for another operation or scope."""
    try:
        body, signature = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in cursor.split("."))
    except ValueError as error:
        raise ValueError("malformed cursor") from error
    if not hmac.compare_digest(signature, hmac.new(secret, body, hashlib.sha256).digest()):
        raise ValueError("the cursor's signature is wrong")
    place = json.loads(body)["place"]
    if cursor != encode_cursor(secret, operation, scope, place):
        raise ValueError("the cursor belongs to another query")
    return place


def overridden(overrides: DataFrame) -> DataFrame:
    """base, member, sole: what a call of base may run, and whether nothing else may."""
    edges = overrides.select(F.col("to_ref").alias("base"), F.col("from_ref").alias("member")).distinct()
    count = edges.groupBy(F.col("base").alias("c_base")).agg(F.count("*").alias("n"))
    return edges.join(count, F.col("base") == F.col("c_base")).select("base", "member", (F.col("n") == 1).alias("sole"))


def caller_edges(calls: DataFrame, overrides: DataFrame, implicit: DataFrame | None = None) -> DataFrame:
    """callee, caller, certain: direct calls, calls that dispatch to the callee, and users of a class whose members run implicitly.

    calls: from_ref, to_ref; overrides: from_ref (the member), to_ref (its base); implicit: member, owner.
    A pair that is certain in one way is certain.
    """
    direct = calls.select(F.col("to_ref").alias("callee"), F.col("from_ref").alias("caller"))
    dispatched = overridden(overrides).join(direct, F.col("base") == F.col("callee")).select(F.col("member").alias("callee"), "caller", F.col("sole").alias("certain"))
    out = direct.withColumn("certain", F.lit(True)).unionByName(dispatched)
    if implicit is not None:
        by_owner = implicit.join(direct, F.col("owner") == F.col("callee")).select(F.col("member").alias("callee"), "caller")
        out = out.unionByName(by_owner.withColumn("certain", F.lit(True)))
    return out.groupBy("callee", "caller").agg(F.bool_or("certain").alias("certain"))


def importers(imports: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """node, rank of what imports the seeds: 2 directly, 4 over up to `hops` steps."""
    now = settled(seeds.select("node").distinct())
    seen, out = now, None
    edges = imports.select(F.col("to_ref").alias("node"), F.col("from_ref").alias("importer")).distinct()
    for hop in range(1, hops + 1):
        step = edges.join(now, "node").select(F.col("importer").alias("node")).distinct().join(seen, "node", "left_anti")
        now = settled(step)
        seen = seen.unionByName(now)
        found = now.withColumn("rank", F.lit(2 if hop == 1 else 4))
        out = found if out is None else out.unionByName(found)
    return out


def groups(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, label: the least node that links lead to, by passing least labels on until nothing changes."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other"))
    both = settled(both.unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other"))).distinct())
    labels = settled(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    for _ in range(most_rounds):
        passed = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("passed"))
        # a label's own label shortens long chains
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = labels.join(passed, "node").join(jump, "label", "left")
        new = settled(new.select("node", F.least("label", "passed", "further").alias("new"), "label"))
        changed = not new.filter("new != label").isEmpty()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError("groups did not settle")


def package_roots(files: DataFrame, manifests: DataFrame, deepest: int = 64) -> DataFrame:
    """path, root: the longest manifest directory (column dir) that a file's path lies below; null where there is none."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.least(F.lit(deepest), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    exploded = files.select("path").distinct().select("path", F.explode(above).alias("dir"))
    found = exploded.join(manifests.select("dir").distinct(), "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("root"))
    return files.join(found, "path", "left")


def mirrored_tests(files: DataFrame, tests: DataFrame) -> DataFrame:
    """path, test: files and test files whose directories have one name, the test's below a test tree whose parents lead to the file's.

    files: path (of a directory); tests: path, tree (what is above the test tree).
    """
    f = files.select("path", F.substring_index("path", "/", -1).alias("name"))
    t = tests.select(F.col("path").alias("test"), "tree", F.substring_index("path", "/", -1).alias("name"))
    return f.join(t, "name").filter((F.col("path") != F.col("test")) & F.col("path").startswith(F.concat("tree", F.lit("/")))).select("path", "test")


def nested_parents(spans: DataFrame) -> DataFrame:
    """place, ref, parent: the smallest other span that holds a span; of equal spans the lesser ref holds the other."""
    outer = spans.select(F.col("place").alias("o_place"), F.col("ref").alias("parent"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    holds = (F.col("o_start") <= F.col("start")) & (F.col("o_end") >= F.col("end"))
    same = (F.col("o_start") == F.col("start")) & (F.col("o_end") == F.col("end"))
    joined = spans.join(outer, (F.col("place") == F.col("o_place")) & holds & (F.col("ref") != F.col("parent")) & (~same | (F.col("parent") < F.col("ref"))), "left")
    # of equal spans the one with the greatest ref is innermost
    inner = F.min(F.when(F.col("parent").isNotNull(), F.struct((F.col("o_end") - F.col("o_start")).alias("size"), (-F.col("parent")).alias("neg"))))
    return joined.groupBy("place", "ref").agg(inner.alias("p")).select("place", "ref", (-F.col("p.neg")).alias("parent"))


def renamed(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """rows with the path that a file has now."""
    moves = renames.select(F.col("old").alias("r_old"), F.col("new").alias("r_new"))
    return rows.join(moves, F.col("path") == F.col("r_old"), "left").withColumn("path", F.coalesce("r_new", "path")).drop("r_old", "r_new")


def removed_declarations(base: DataFrame, working: DataFrame, renames: DataFrame) -> DataFrame:
    """Declarations (path, kind, name) of the base that the working version has no longer, after renames."""
    return renamed(base, renames).select("path", "kind", "name").distinct().join(working.select("path", "kind", "name").distinct(), ["path", "kind", "name"], "left_anti")


def containing_all(docs: DataFrame, terms: list[str]) -> DataFrame:
    """path of documents (path, words) that hold all terms, by posting lists."""
    postings = docs.select("path", F.explode("words").alias("word")).filter(F.col("word").isin(*terms)).distinct()
    return postings.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") == len(set(terms))).select("path")


def on_new_cycles(now: DataFrame, before: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) of now that before lacks, where a path of `most` edges at most leads back now and did not before."""
    new = settled(new_edges(now.filter("a != b"), before, ["a", "b"]).select("a", "b").distinct())

    def reaches_back(edges: DataFrame) -> DataFrame:
        step = settled(edges.filter("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        seen = front = settled(new.select(F.col("b").alias("origin"), F.col("b").alias("node")).distinct())
        for _ in range(most):
            front = settled(front.join(step, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct().join(seen, ["origin", "node"], "left_anti"))
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        return seen.select(F.col("origin").alias("b"), F.col("node").alias("a"))

    return new.join(reaches_back(now), ["a", "b"], "left_semi").join(reaches_back(before), ["a", "b"], "left_anti")


def tiers(sizes: DataFrame, detailed: int = 24 * 1024, compact: int = 64 * 1024) -> DataFrame:
    """directory, bytes, tier of rows (directory, bytes): how much of a directory a listing shows."""
    total = sizes.groupBy("directory").agg(F.sum("bytes").alias("bytes"))
    return total.withColumn("tier", F.when(F.col("bytes") <= detailed, F.lit("detailed")).when(F.col("bytes") <= compact, F.lit("compact")).otherwise(F.lit("modules")))
