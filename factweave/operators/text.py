"""Text operators: exact search, ranges, status and listing of files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from factweave.functions.paths import allowed, ancestors


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos")


def exact_search(files: DataFrame, literal: str, around: int = 250) -> DataFrame:
    """path, line_no, col_no, excerpt of each non-overlapping match; columns count from 1.

    A line is cut at the matches; a match starts where the pieces before it, and the matches between, end.
    """
    rows = lines(files.filter(F.col("text").contains(literal))).filter(F.col("line").contains(literal))
    parts = F.split("line", re.escape(literal))
    before = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, p: a + F.length(p)) + (n - 1) * len(literal) + 1)
    rows = rows.select("path", "line_no", "line", F.explode(before).alias("col_no"))
    start = F.greatest(F.lit(1), F.col("col_no") - around)
    return rows.select("path", "line_no", "col_no", F.substr(F.col("line"), start, F.col("col_no") - start + len(literal) + around).alias("excerpt"))


def line_range(files: DataFrame, first: int, count: int) -> DataFrame:
    parts = F.split("text", "\n")
    return files.filter(F.size(parts) >= first).select("path", F.array_join(F.slice(parts, first, count), "\n").alias("range"), F.size(parts).alias("n_lines"))


def path_status(wanted: DataFrame, files: DataFrame, scope: list[str]) -> DataFrame:
    """path, status of each wanted path: text, not readable, directory, not included, or restricted."""
    known = files.select(F.col("path").alias("f_path"), "entry_state")
    folders = files.select(F.explode(ancestors(F.regexp_replace("path", "/[^/]*$", ""))).alias("d_path")).distinct()
    rows = wanted.join(known, F.col("path") == F.col("f_path"), "left").join(folders, F.col("path") == F.col("d_path"), "left")
    status = (
        F.when(~allowed(F.col("path"), scope), "RESTRICTED").when(F.col("entry_state") == "TEXT", "TEXT_READABLE").when(F.col("f_path").isNotNull(), "KNOWN_NOT_READABLE")
        .when(F.col("d_path").isNotNull(), "DIRECTORY").otherwise("NOT_INCLUDED")
    )
    return rows.select("path", status.alias("status"))


def listing(files: DataFrame, depth: int) -> DataFrame:
    """path, kind of directories and files down to a depth; a directory wins over a file of its name."""
    parts = F.size(F.split("path", "/"))
    steps = files.select("path", F.explode(ancestors(F.col("path"), depth)).alias("entry"), parts.alias("n"))
    kind = F.when(F.col("entry") == F.col("path"), "FILE").otherwise("DIRECTORY")
    return steps.groupBy(F.col("entry").alias("path")).agg(F.min(kind).alias("kind"))


def entry_state(text, most: int | None = None):
    """State of a file's content: NOT_READABLE where null, TOO_LARGE beyond `most` bytes (where given), NON_TEXT where it holds NUL, else TEXT."""
    state = F.when(text.isNull(), "NOT_READABLE")
    if most is not None:
        state = state.when(F.octet_length(text) > most, "TOO_LARGE")
    return state.when(F.instr(text, "\u0000") > 0, "NON_TEXT").otherwise("TEXT")
