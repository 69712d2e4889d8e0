"""Changes: unified diffs, edits that keep a sequence, replay closure, removed declarations and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.functions.lineage import settled

# Line forms of a unified diff.
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
OLD, NEW = r"^--- (?:a/)?(.*)$", r"^\+\+\+ (?:b/)?(.*)$"


def diff_hunks(diffs: DataFrame, key: str) -> DataFrame:
    """key, path, status, base_start, base_count, now_start, now_count, removed of each hunk of a diff without context.

    diffs: key, diff. A hunk says how many lines it has, so what follows its header is not read as
    another header until those are over: a removed line that begins with dashes stays a line. Null
    and empty diffs have no hunks; /dev/null on one side makes a file ADDED or DELETED.
    """
    part = lambda line, n: F.regexp_extract(line, HUNK, n)
    count = lambda line, n: F.when(part(line, n) == "", F.lit(1)).otherwise(part(line, n).cast("int"))
    kind = "struct<old:string,new:string,left_old:int,left_new:int,hunks:array<struct<old:string,new:string,head:string,removed:array<string>>>>"
    begin = F.expr(f"cast(named_struct('old', null, 'new', null, 'left_old', 0, 'left_new', 0, 'hunks', array()) as {kind})")

    def state(s, old=None, new=None, left_old=None, left_new=None, hunks=None):
        fields = {"old": old, "new": new, "left_old": left_old, "left_new": left_new, "hunks": hunks}
        return F.struct(*[(s[k] if v is None else v).alias(k) for k, v in fields.items()])

    def step(s, line):
        inside = (s["left_old"] > 0) | (s["left_new"] > 0)
        last = F.element_at(s["hunks"], -1)
        grown = F.struct(last["old"].alias("old"), last["new"].alias("new"), last["head"].alias("head"), F.array_append(last["removed"], F.substring(line, 2, 1 << 30)).alias("removed"))
        before = F.slice(s["hunks"], 1, F.size(s["hunks"]) - 1)
        fresh = F.struct(s["old"].alias("old"), s["new"].alias("new"), line.alias("head"), F.expr("cast(array() as array<string>)").alias("removed"))
        return (
            F.when(inside & line.startswith("-"), state(s, left_old=s["left_old"] - 1, hunks=F.array_append(before, grown)))
            .when(inside & line.startswith("+"), state(s, left_new=s["left_new"] - 1))
            .when(inside, s)
            .when(line.rlike(HUNK), state(s, left_old=count(line, 2), left_new=count(line, 4), hunks=F.array_append(s["hunks"], fresh)))
            .when(line.rlike(OLD), state(s, old=F.regexp_extract(line, OLD, 1)))
            .when(line.rlike(NEW), state(s, new=F.regexp_extract(line, NEW, 1)))
            .otherwise(s)
        )

    found = diffs.filter("diff is not null").select(key, F.explode(F.aggregate(F.split("diff", "\n"), begin, step, lambda s: s["hunks"])).alias("h"))
    head = F.col("h.head")
    return found.select(
        key,
        F.when(F.col("h.new") == "/dev/null", F.col("h.old")).otherwise(F.col("h.new")).alias("path"),
        F.when(F.col("h.old") == "/dev/null", F.lit("ADDED")).when(F.col("h.new") == "/dev/null", F.lit("DELETED")).otherwise(F.lit("CHANGED")).alias("status"),
        part(head, 1).cast("int").alias("base_start"), count(head, 2).alias("base_count"),
        part(head, 3).cast("int").alias("now_start"), count(head, 4).alias("now_count"),
        F.col("h.removed").alias("removed"),
    )


def keeps_sequence(old: Column, new: Column) -> Column:
    """Whether all of old's items are in new in their order, so that an edit only added some."""
    found = F.aggregate(new, F.lit(0), lambda at, item: at + F.coalesce((F.get(old, at) == item).cast("int"), F.lit(0)))
    return found == F.size(old)


def replay_closure(reads: DataFrame, changed: DataFrame, most_rounds: int = 60) -> DataFrame:
    """context, round of all that must be analysed again: a context that shares a file with a changed one, and so on.

    reads: context, file; changed: context. Each round joins only the contexts and files that the last one found.
    """
    reads = settled(reads.select("context", "file").distinct())
    found = settled(changed.select("context").distinct().withColumn("round", F.lit(0)))
    files, fresh = None, found
    for n in range(1, most_rounds + 1):
        reached = reads.join(fresh.select("context"), "context", "left_semi").select("file").distinct()
        new_files = settled(reached if files is None else reached.join(files, "file", "left_anti"))
        files = new_files if files is None else settled(files.unionByName(new_files))
        touched = reads.join(new_files, "file", "left_semi").select("context").distinct()
        fresh = settled(touched.join(found, "context", "left_anti").withColumn("round", F.lit(n)))
        if fresh.isEmpty():
            return found
        found = settled(found.unionByName(fresh))
    raise RuntimeError("replay closure did not settle")


def outermost(removed: DataFrame, contains: DataFrame) -> DataFrame:
    """ref of the removed whose container is not removed too. removed: ref; contains: from_ref, to_ref."""
    inside = contains.join(removed.withColumnRenamed("ref", "from_ref"), "from_ref", "left_semi").select(F.col("to_ref").alias("ref"))
    return removed.join(inside, "ref", "left_anti")


def users_before_after(uses: DataFrame, target: str, user: str, is_now: Column) -> DataFrame:
    """target, before, now, gained, lost: how many users each version has, and how many only one of them has."""
    per = uses.groupBy(target, user).agg(F.bool_or(is_now).alias("now"), F.bool_or(~is_now).alias("before"))
    count = lambda c: F.count_if(c)
    now, before = F.col("now"), F.col("before")
    return per.groupBy(target).agg(count(before).alias("before"), count(now).alias("now"), count(now & ~before).alias("gained"), count(before & ~now).alias("lost"))


def top_notes(notes: DataFrame, key: str, order: list[Column], text: str, most: int = 5, budget: int = 8192) -> DataFrame:
    """The first notes of each key: `most` of them at most, and no more bytes than budget in all."""
    w = Window.partitionBy(key).orderBy(*order)
    sized = notes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    upto = F.sum(F.octet_length(F.coalesce(text, F.lit("")))).over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("bytes", upto).filter(F.col("bytes") <= budget)


def upsert(rows: DataFrame, key: str, rank: Column, order: list[Column]) -> DataFrame:
    """Of each key the row with the least rank, then the first in order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(rank, *order))).filter("place = 1").drop("place")
