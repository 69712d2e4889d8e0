"""Ranked search over names, paths and documentation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, Window

from factweave.functions.paths import is_generated, is_test, stem
from factweave.operators.graph import lookup

# Weights of ranking.
KIND = {"CLASS": 600, "FUNCTION": 550, "METHOD": 550, "INTERFACE": 500, "TYPE": 500, "ENUM": 450, "FILE": 350, "PROPERTY": 250, "VARIABLE": 250, "PACKAGE": 100, "CONFIG": 100}
EXACT, PREFIX, CONTAINS, STEM, WHOLE_PATH, ANY_DOC = 12000, 9000, 7000, 11000, 2500, 1500
COVERAGE, IN_NAME, IN_PATH, IN_DOC = 4000, 2000, 300, 200
DEGREE_STEP, DEGREE_MOST = 20, 1200
TEST_WANTED, TEST_UNWANTED, NOT_TEST = 1000, -5000, 300
GENERATED, NOT_GENERATED = -3000, 300
SAME_PATH_FREE, SAME_PATH_COST = 3, 400
TEST_WORDS = {"e2e", "fixture", "spec", "test", "tests"}


def terms(query: str) -> list[str]:
    """Lower-cased runs of letters and digits; camelCase and acronyms are split; each once."""
    query = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query[:256]))
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def ranked(rows: DataFrame, query: str, mode: str = "ANY") -> DataFrame:
    """rows (entity_ref, kind, name, path, doc, degree, focus) that match, with matched and score.

    mode: ANY of the terms, ALL of them, or the LITERAL query.
    """
    words = terms(query)
    literal = query.lower()
    name, path, doc = (F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "path", "doc"))
    hit = lambda w: name.contains(w) | path.contains(w) | doc.contains(w)
    matched = sum((F.when(hit(w), 1).otherwise(0) for w in words), F.lit(0))
    keep = {"ANY": matched > 0, "ALL": matched == len(words), "LITERAL": hit(literal)}[mode]
    base = F.when(name == literal, EXACT).when(name.startswith(literal), PREFIX).when(name.contains(literal), CONTAINS).otherwise(0)
    base = F.greatest(base, F.when((F.col("kind") == "FILE") & (F.lower(stem(F.col("path"))) == literal), STEM).otherwise(0))
    per_term = sum((F.when(name.contains(w), IN_NAME).when(path.contains(w), IN_PATH).when(doc.contains(w), IN_DOC).otherwise(0) for w in words), F.lit(0))
    any_doc = F.when(sum((F.when(doc.contains(w), 1).otherwise(0) for w in words), F.lit(0)) > 0, ANY_DOC).otherwise(0)
    test = is_test(F.col("path"))
    wanted = TEST_WANTED if TEST_WORDS & set(words) else TEST_UNWANTED
    score = (
        base + F.when(path.contains(literal), WHOLE_PATH).otherwise(0) + any_doc + F.floor(F.lit(COVERAGE) * matched / max(1, len(words))) + per_term
        + F.coalesce(lookup(F.col("kind"), KIND), F.lit(0)) + F.least(F.lit(DEGREE_MOST), F.col("degree") * DEGREE_STEP) + F.coalesce(F.col("focus"), F.lit(0))
        + F.when(test, wanted).otherwise(NOT_TEST) + F.when(is_generated(F.col("path")), GENERATED).otherwise(NOT_GENERATED)
    )
    return rows.filter(keep).withColumn("matched", matched.cast("int")).withColumn("score", score.cast("long"))


def diversified(found: DataFrame) -> DataFrame:
    """Results of one path beyond the third lose score."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "entity_ref"))
    return found.withColumn("rank_in_path", rank).withColumn("final_score", F.col("score") - F.greatest(F.lit(0), F.col("rank_in_path") - SAME_PATH_FREE) * SAME_PATH_COST)


def top(found: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """A page of results: score first, then path and id."""
    return found.orderBy(F.desc("final_score"), "path", "entity_ref").offset(offset).limit(n)


def trigrams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.length(low) < 3, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - 2)), lambda i: F.substr(low, i, F.lit(3))))
    )


def trigram_candidates(rows: DataFrame, id_col: str, text_col: str, term: str) -> DataFrame:
    """Ids whose texts have all trigrams of a term; only the term's own trigrams are looked for."""
    wanted = sorted({term.lower()[i : i + 3] for i in range(len(term) - 2)})
    grams = F.filter(F.array(*map(F.lit, wanted)), lambda g: F.lower(F.col(text_col)).contains(g))
    return rows.select(F.col(id_col), F.size(grams).cast("long").alias("grams")).filter(F.col("grams") == len(wanted))
