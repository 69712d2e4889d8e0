"""Versions: sharing units by digest, differences, retention, multisets, line mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window


def units(files: DataFrame) -> DataFrame:
    """unit_ref, paths, first_path: contents are stored once for each digest."""
    return files.groupBy(F.sha2("text", 256).alias("unit_ref")).agg(F.count("*").alias("paths"), F.min("path").alias("first_path"))


def difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """status, files of two versions (path, digest): SAME, CHANGED, ADDED or REMOVED."""
    a, b = now.select("path", F.col("digest").alias("d_now")), before.select("path", F.col("digest").alias("d_before"))
    status = F.when(F.col("d_before").isNull(), "ADDED").when(F.col("d_now").isNull(), "REMOVED").when(F.col("d_now") == F.col("d_before"), "SAME").otherwise("CHANGED")
    return a.join(b, "path", "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("files"))


def orphans(stored: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return stored.join(used.select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rn") <= n)


def multiset_difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of now beyond their number in before, counted."""
    return now.exceptAll(before).groupBy(*now.columns).agg(F.count("*").alias("times"))


def working_lines(base: DataFrame, hunks: DataFrame, file: str) -> DataFrame:
    """Each base line (file, line) in the working file: shifted by all hunks that end before it, null inside one.

    hunks: file, base_start, base_count, count. The running sum of shifts is joined as of the line.
    """
    order = Window.partitionBy(file).orderBy("base_start")
    shifted = hunks.withColumn("shift", F.sum(F.col("count") - F.col("base_count")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marks = shifted.select(file, F.col("base_start").alias("line"), F.struct("base_start", "base_count", "shift", (F.col("count") - F.col("base_count")).alias("own")).alias("hunk"))
    rows = base.select(file, "line").withColumn("hunk", F.lit(None).cast(marks.schema["hunk"].dataType)).withColumn("is_line", F.lit(1))
    both = marks.withColumn("is_line", F.lit(0)).unionByName(rows)
    last = F.last("hunk", ignorenulls=True).over(Window.partitionBy(file).orderBy("line", "is_line").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("h", last).filter("is_line = 1")
    inside = F.col("line") < F.col("h.base_start") + F.col("h.base_count")
    return out.select(file, "line", F.when(F.col("h").isNull(), F.col("line")).when(inside, F.lit(None)).otherwise(F.col("line") + F.col("h.shift")).alias("working_line"))


def islands(rows: DataFrame, order: list[str], same: str) -> DataFrame:
    """Consecutive rows, in partitions of order[0], with the same value make one island."""
    w = Window.partitionBy(order[0]).orderBy(*order[1:])
    new = F.when(F.col(same).eqNullSafe(F.lag(same).over(w)), 0).otherwise(1)
    return rows.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def innermost(sites: DataFrame, spans: DataFrame, group: str) -> DataFrame:
    """For each site (group, site, at) the smallest span (group, ref, start, end) around it; ties by ref."""
    inside = sites.join(spans, group).filter("start <= at and at <= end")
    rank = F.row_number().over(Window.partitionBy(group, "site").orderBy(F.col("end") - F.col("start"), "ref"))
    return inside.withColumn("rn", rank).filter("rn = 1").drop("rn")


def byte_page(rows: DataFrame, line: str, group: str, order: list[str], budget: int) -> DataFrame:
    """Of each group the longest prefix whose lines, with line ends, fit the budget."""
    used = F.sum(F.octet_length(line) + 1).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).filter(F.col("used") <= budget)
