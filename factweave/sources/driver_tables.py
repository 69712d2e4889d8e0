"""The driver's tables as a fact graph: objects and relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class FactGraph:
    """objects: entity_ref, kind, name, path, start. relations: from_ref, to_ref, kind, path, start."""

    objects: DataFrame
    relations: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ref(letter: str, key: str):
    return F.concat(F.lit(letter + ":"), F.col(key).cast("string"))


TEST_SEGMENT = "BUILDING"


def fact_graph(spark: SparkSession, sf_dir: str) -> FactGraph:
    t = lambda name: table(spark, sf_dir, name)
    region, nation, customer, supplier, part = (t(n) for n in ("region", "nation", "customer", "supplier", "part"))
    orders, lineitem = t("orders"), t("lineitem")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("n_path", F.concat_ws("/", "r_name", "n_name"))
    places = F.broadcast(places)  # 25 rows at any scale
    customers = customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "path", F.concat("n_path", F.when(F.col("c_mktsegment") == TEST_SEGMENT, F.lit("/tests")).otherwise(F.lit("")), F.lit("/customer"))
    )
    suppliers = supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("path", F.concat("n_path", F.lit("/supplier")))

    def rows(df, ref, kind, name, path, start=F.lit(0)):
        return df.select(ref.alias("entity_ref"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), start.cast("long").alias("start"))

    owned = orders.join(customers.select("c_custkey", "path"), F.col("o_custkey") == F.col("c_custkey"))
    objects = [
        rows(region, _ref("R", "r_regionkey"), "PACKAGE", F.col("r_name"), F.col("r_name")),
        rows(places, _ref("N", "n_nationkey"), "FILE", F.col("n_name"), F.col("n_path")),
        rows(customers, _ref("C", "c_custkey"), "CLASS", F.col("c_name"), F.col("path")),
        rows(suppliers, _ref("S", "s_suppkey"), "CLASS", F.col("s_name"), F.col("path")),
        rows(owned, _ref("O", "o_orderkey"), "METHOD", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), F.col("path"), F.col("o_orderkey")),
        rows(part, _ref("P", "p_partkey"), "FUNCTION", F.col("p_name"), F.concat_ws("/", F.lit("catalog"), "p_brand", "p_type")),
    ]

    def edges(df, a, b, kind, path):
        return df.select(a.alias("from_ref"), b.alias("to_ref"), F.lit(kind).alias("kind"), path.alias("path"))

    calls = lineitem.select("l_orderkey", "l_partkey").distinct().join(owned.select("o_orderkey", "path"), F.col("l_orderkey") == F.col("o_orderkey"))
    supplies = lineitem.select("l_partkey", "l_suppkey").distinct()
    imports = (
        lineitem.select("l_orderkey", "l_suppkey").distinct()
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("c_nationkey", "s_nationkey").distinct().join(places.select("n_nationkey", "n_path"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    relations = [
        edges(places, _ref("R", "n_regionkey"), _ref("N", "n_nationkey"), "CONTAINS", F.col("r_name")),
        edges(suppliers, _ref("N", "s_nationkey"), _ref("S", "s_suppkey"), "CONTAINS", F.col("n_path")),
        edges(customers, _ref("N", "c_nationkey"), _ref("C", "c_custkey"), "CONTAINS", F.col("n_path")),
        edges(owned, _ref("C", "o_custkey"), _ref("O", "o_orderkey"), "CONTAINS", F.col("path")),
        edges(calls, _ref("O", "l_orderkey"), _ref("P", "l_partkey"), "CALLS", F.col("path")),
        edges(supplies, _ref("P", "l_partkey"), _ref("S", "l_suppkey"), "CALLS", F.lit("catalog")),
        edges(imports, _ref("N", "c_nationkey"), _ref("N", "s_nationkey"), "IMPORTS", F.col("n_path")),
    ]
    union = lambda frames: __import__("functools").reduce(DataFrame.unionByName, frames)
    return FactGraph(union(objects), union(relations))


#: The same projection for oracles; put before a query's own CTEs.
FACTS_SQL = f"""
places AS (SELECT n_nationkey, n_regionkey, n_name, r_name, r_name || '/' || n_name AS n_path FROM nation JOIN region ON n_regionkey = r_regionkey),
customers AS (SELECT c_custkey, c_nationkey, c_name, n_path, n_path || CASE WHEN c_mktsegment = '{TEST_SEGMENT}' THEN '/tests' ELSE '' END || '/customer' AS path FROM customer JOIN places ON c_nationkey = n_nationkey),
suppliers AS (SELECT s_suppkey, s_nationkey, s_name, n_path, n_path || '/supplier' AS path FROM supplier JOIN places ON s_nationkey = n_nationkey),
owned AS (SELECT o_orderkey, o_custkey, path FROM orders JOIN customers ON o_custkey = c_custkey),
objects AS (
  SELECT 'R:' || r_regionkey AS entity_ref, 'PACKAGE' AS kind, r_name AS name, r_name AS path, CAST(0 AS BIGINT) AS start FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'FILE', n_name, n_path, 0 FROM places
  UNION ALL SELECT 'C:' || c_custkey, 'CLASS', c_name, path, 0 FROM customers
  UNION ALL SELECT 'S:' || s_suppkey, 'CLASS', s_name, path, 0 FROM suppliers
  UNION ALL SELECT 'O:' || o_orderkey, 'METHOD', 'Order#' || o_orderkey, path, o_orderkey FROM owned
  UNION ALL SELECT 'P:' || p_partkey, 'FUNCTION', p_name, 'catalog/' || p_brand || '/' || p_type, 0 FROM part
),
relations AS (
  SELECT 'R:' || n_regionkey AS from_ref, 'N:' || n_nationkey AS to_ref, 'CONTAINS' AS kind, r_name AS path FROM places
  UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey, 'CONTAINS', n_path FROM suppliers
  UNION ALL SELECT 'N:' || c_nationkey, 'C:' || c_custkey, 'CONTAINS', n_path FROM customers
  UNION ALL SELECT 'C:' || o_custkey, 'O:' || o_orderkey, 'CONTAINS', path FROM owned
  UNION ALL SELECT 'O:' || l_orderkey, 'P:' || l_partkey, 'CALLS', path FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN owned ON l_orderkey = o_orderkey
  UNION ALL SELECT 'P:' || l_partkey, 'S:' || l_suppkey, 'CALLS', 'catalog' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  UNION ALL SELECT DISTINCT 'N:' || c_nationkey, 'N:' || s_nationkey, 'IMPORTS', c.n_path
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customers c ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
)
"""
