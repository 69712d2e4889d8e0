"""Graph operators over edges: bounded search, lineage, owners, degree, focus, reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factweave.functions.lineage import settled

# Order of relation kinds, and their weights near a focus.
PRIORITY = {"CALLS": 0, "WRITES": 0, "IMPORTS": 0, "EXTENDS": 0, "IMPLEMENTS": 0, "OVERRIDES": 0, "DECORATED_BY": 0, "CONTAINS": 1, "READS": 2, "REFERENCES": 3}
FOCUS = {"CALLS": 1200, "WRITES": 1200, "READS": 900, "EXTENDS": 900, "IMPLEMENTS": 900, "OVERRIDES": 900, "IMPORTS": 800, "DECORATED_BY": 700, "REFERENCES": 500, "CONTAINS": 250}
FOCUS_SEED = 1800


def lookup(column, table: dict):
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[column]


def directed(relations: DataFrame, direction: str) -> DataFrame:
    """Edges (src, dst) along which a search goes: OUTGOING, INCOMING or BOTH."""
    out = relations.filter("to_ref is not null").select(F.col("from_ref").alias("src"), F.col("to_ref").alias("dst"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"OUTGOING": out, "INCOMING": back, "BOTH": out.unionByName(back)}[direction].distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, level of all nodes within depth steps of the seeds (column node); each node once, at its least level.

    A level joins only the newest nodes to the edges; Spark broadcasts them where they are few.
    """
    frontier = settled(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    seen = frontier
    for level in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = settled(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def explore(relations: DataFrame, seeds: DataFrame, direction: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """(edges touched within the depth, nodes with level and whether they are the frontier)."""
    # written once, so that a level reads edges instead of deriving them anew
    nodes = settled(bfs(settled(directed(relations, direction)), seeds, depth))
    inner = nodes.filter(F.col("level") < depth).select("node")
    sides = {"OUTGOING": ["from_ref"], "INCOMING": ["to_ref"], "BOTH": ["from_ref", "to_ref"]}[direction]
    found = [relations.join(inner, F.col(side) == F.col("node"), "left_semi") for side in sides]
    edges = found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()
    return edges, nodes.withColumn("frontier", F.col("level") == depth)


def lineage(contains: DataFrame, most: int = 64) -> DataFrame:
    """node, ancestor, distance (1 is the parent) by joining the parents' table with itself level by level, up to the roots.

    Containment has no cycles; where levels don't end, RuntimeError.
    """
    parent = settled(contains.select(F.col("to_ref").alias("node"), F.col("from_ref").alias("ancestor")).distinct())
    up = parent.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    out = level = parent.withColumn("distance", F.lit(1))
    for distance in range(2, most + 2):
        level = settled(level.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(distance).alias("distance")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError("containment has a cycle, or more than 64 levels")


def owners(objects: DataFrame, contains: DataFrame, addressable) -> DataFrame:
    """node, owner: the nearest ancestor, or the node itself, that is addressable (a predicate over objects)."""
    able = objects.filter(addressable).select(F.col("entity_ref").alias("ancestor"))
    own = objects.select(F.col("entity_ref").alias("node"), F.col("entity_ref").alias("ancestor"), F.lit(0).alias("distance"))
    chain = own.unionByName(lineage(contains)).join(able, "ancestor")
    return chain.groupBy("node").agg(F.min_by("ancestor", "distance").alias("owner"))


def degree(relations: DataFrame) -> DataFrame:
    """node, degree: edges at both ends; a self-loop counts twice."""
    ends = relations.select(F.col("from_ref").alias("node")).unionByName(relations.filter("to_ref is not null").select(F.col("to_ref").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def focus(relations: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """node, score near the seeds: floor(min(parent's score, edge weight) / distance); nearer nodes win."""
    weight = lookup(F.col("kind"), FOCUS)
    out = relations.filter("to_ref is not null").select(F.col("from_ref").alias("src"), F.col("to_ref").alias("dst"), weight.alias("weight"))
    edges = out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    # written once, so that a hop reads edges instead of deriving them anew
    edges = settled(edges.groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    now = settled(seeds.select("node").distinct().withColumn("score", F.lit(FOCUS_SEED).cast("long")))
    seen = now
    for distance in range(1, hops + 1):
        step = edges.join(now.withColumnRenamed("node", "src"), "src")
        step = step.groupBy(F.col("dst").alias("node")).agg(F.max(F.floor(F.least("score", "weight") / distance)).alias("score"))
        now = settled(step.join(seen, "node", "left_anti"))
        seen = seen.unionByName(now)
    return seen


def divide(members: DataFrame, contracts: DataFrame) -> DataFrame:
    """type_ref, contract_ref of types that have every (name, signature) of a contract: relational division."""
    wanted = contracts.select("contract_ref", "name", "signature").distinct()
    sizes = wanted.groupBy("contract_ref").agg(F.count("*").alias("wanted"))
    have = members.select("type_ref", "name", "signature").distinct().join(wanted, ["name", "signature"]).groupBy("type_ref", "contract_ref").agg(F.count("*").alias("have"))
    return have.join(sizes, "contract_ref").filter("have = wanted").select("type_ref", "contract_ref")


def new_edges(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Edges of now whose key is not in before."""
    return now.join(before.select(*key).distinct(), key, "left_anti")


def impact(certain: DataFrame, uncertain: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, certain, level: reached upwards over certain edges, then over all edges for the rest.

    Edges are (src, dst) from callee to caller. A certain path wins whatever its length.
    """
    edges = settled(certain.withColumn("sure", F.lit(True)).unionByName(uncertain.withColumn("sure", F.lit(False))).distinct())
    sure = settled(bfs(edges.filter("sure").select("src", "dst"), seeds, depth))
    any_ = bfs(edges.select("src", "dst"), seeds, depth)
    rest = any_.join(sure.select("node"), "node", "left_anti")
    return sure.withColumn("certain", F.lit(True)).unionByName(rest.withColumn("certain", F.lit(False)))


def entry_points(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Reached nodes that nothing calls."""
    return reached.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
