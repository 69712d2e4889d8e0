"""N-gram Jaccard join by MinHash banding.

Texts with the same words form a class; one text stands for it. Each class gets a MinHash
signature of its set of word 5-grams in BANDS bands of ROWS values. At a similarity of 0.8 a pair
shares a band with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS, over 0.99997 here; the numbers
were chosen for that recall. Classes are shuffled by band hash, and those that share one are
linked to the least class of the bucket, not to each other: this makes candidate clusters, which
hold every pair that shares a band, with as many rows as there are classes.

Pairs are verified on full 5-gram sets. A cluster of up to BLOCK classes is one task. In a larger
one, which chains of buckets may have brought together, only pairs that share a band are verified:
its buckets (of those with the same members one) are dealt into blocks, each pair of blocks is a
task, and a pair counts in the first bucket that holds both. So no cluster or bucket is gathered in
one place. Tasks return, for each class, its number of links and one edge to its part of the task's
own components, never the pairs.

Words are runs of letters, digits and underscores, lower-cased; a text with fewer than five is one
n-gram. Defined results: null texts and texts without words link with nothing, not even each other;
repeated rows are copies of each other; rows that repeat an id with other texts are compared each by
its own text; a null id is never a class's id, and a text that only rows with null ids have links
with its copies only, and its class id is null; an empty table gives no rows; no cap holds anywhere.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import docs_of, keep, runs, scratch, write_table

NGRAM = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction, compared in integers
ROWS, BANDS = 7, 45
#: Classes of a block; a task compares two blocks at most.
BLOCK = 768
_words = re.compile(r"\w+").findall


def normalised(text: str | None) -> list[str]:
    """Lower-cased words of a text: what hashed_words() hashes."""
    return _words(text.lower()) if text else []


@functools.cache
def word_characters() -> np.ndarray:
    """Whether a code point is a letter, digit or underscore."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)])


_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers = np.cumprod(np.full(64, 0x5851F42D4C957F2D, np.uint64))


def hashed_words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of a text's lower-cased words, the same in every process, and where each starts and ends."""
    global _powers
    none = np.zeros(0, np.int64)
    if not text:
        return none.astype(np.uint64), none, none
    lower = text.lower()
    if len(lower) != len(text):  # a few characters have lower cases of two
        lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    code = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = word_characters()[code]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return none.astype(np.uint64), none, none
    size = end - start
    if size.max() > len(_powers):
        _powers = np.cumprod(np.full(2 * int(size.max()), _powers[0], np.uint64))
    code = code[inside].astype(np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(len(code)) - np.repeat(first, size)
    code = (code + np.uint64(1)) * _GOLD
    code = (code ^ (code >> np.uint64(29))) * _MIX
    mixed = np.add.reduceat((code ^ (code >> np.uint64(32))) * _powers[place], first) + size.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _GOLD
    return mixed ^ (mixed >> np.uint64(29)), start, end


def class_key(hashes: np.ndarray) -> bytes | None:
    """The digest of a sequence of words; None where there are none."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def ngram_set(hashes: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a sequence of word hashes."""
    if not len(hashes):
        return hashes
    size = max(1, len(hashes) - n + 1)
    mixed = np.zeros(size, np.uint64)
    for k in range(min(n, len(hashes))):
        mixed = (mixed ^ hashes[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


class MinHash:
    """Band hashes of sets: `bands` bands of `rows` minima each."""

    def __init__(self, rows: int, bands: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rows, self.bands = rows, bands
        self.factor = rng.integers(0, 1 << 32, rows * bands, np.uint64).astype(np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, rows * bands, np.uint64).astype(np.uint32)

    def bands_of(self, sets: list[np.ndarray]) -> np.ndarray:
        """int64 array (sets, bands); sets must not be empty. The band's number is part of its hash."""
        values = np.concatenate(sets)
        low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        out = np.empty((len(sets), self.bands), np.uint64)
        for band in range(self.bands):
            mixed = np.full(len(sets), (band + 1) * 0xD6E8FEB86659FD93 % (1 << 64), np.uint64)
            for row in range(self.rows):
                k = band * self.rows + row
                h = low * self.factor[k] + self.add[k]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x2C1B3C6D)
                least = np.minimum.reduceat(h, starts).astype(np.uint64)
                mixed = (mixed ^ least) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(31)
            out[:, band] = mixed
        return out.view(np.int64)


def sketched(df: DataFrame, id_col: str, text_col: str, rows: int, bands: int) -> DataFrame:
    """id, key (of the sequence of words) and band hashes of each text; key and hashes are null where it has no words."""

    def apply(batches):
        hasher = MinHash(rows, bands)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                ids, keys, sets, total = [], [], [], 0
                while at < batch.num_rows and total < 200_000:
                    words = hashed_words(batch.column(1)[at].as_py())[0]
                    ids.append(batch.column(0)[at].as_py())
                    keys.append(class_key(words))
                    if len(words):
                        sets.append(ngram_set(words))
                    total += len(words)
                    at += 1
                found = iter(hasher.bands_of(sets).tolist() if sets else [])
                of = [next(found) if key else None for key in keys]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.binary()), pa.array(of, pa.list_(pa.int64()))], ["id", "key", "bands"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(apply, f"id {kind}, key binary, bands array<bigint>")


def candidate_units(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """cls, unit, codes of classes (cls, bands) that share a band with another: the units to be compared in.

    A unit is a cluster, or in clusters of more than a block a bucket; codes are all units of the class.
    """
    rows = write_table(classes.select("cls", F.explode("bands").alias("bucket")), "bands")
    shared = rows.groupBy("bucket").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).filter("least != most")
    shared = write_table(shared.select(F.col("bucket").alias("s_bucket"), "least"), "buckets")
    linked = rows.join(shared, F.col("bucket") == F.col("s_bucket"))
    clusters = write_table(components(linked.select(F.col("cls").alias("u"), F.col("least").alias("v"))), "clusters")
    sizes = clusters.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("n")).filter(F.col("n") > block)
    large = write_table(sizes.select("c"), "large-clusters")
    on = F.col("component") == F.col("c")
    none = F.array().cast("array<bigint>")
    units = clusters.join(large, on, "left_anti").select(F.col("node").alias("cls"), F.struct(F.lit(0).alias("kind"), F.col("component").alias("code")).alias("unit"), none.alias("codes"))
    if large.isEmpty():
        return units
    inside = clusters.join(large, on, "left_semi").select(F.col("node").alias("i_cls"))
    dealt = write_table(linked.join(inside, F.col("cls") == F.col("i_cls")).select("cls", "bucket"), "large-buckets")
    # buckets with the same members have the same pairs: one of them will do
    members = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"), F.min("cls").alias("least"))
    chosen = members.groupBy("n", "x", "y", "least").agg(F.min("bucket").alias("c_bucket")).select("c_bucket")
    dealt = write_table(dealt.join(chosen, F.col("bucket") == F.col("c_bucket")).select("cls", "bucket"), "chosen-buckets")
    codes = dealt.groupBy(F.col("cls").alias("l_cls")).agg(F.sort_array(F.collect_set("bucket")).alias("codes"))  # as many as bands at most
    in_buckets = dealt.join(codes, F.col("cls") == F.col("l_cls"))
    return units.unionByName(in_buckets.select("cls", F.struct(F.lit(1).alias("kind"), F.col("bucket").alias("code")).alias("unit"), "codes"))


def _sets(batches):
    """cls, grams of texts (cls, key, text); a row that repeats the id with another text has another key and goes."""
    for batch in batches:
        words = [hashed_words(t)[0] for t in batch.column(2).to_pylist()]
        right = [class_key(w) == k for w, k in zip(words, batch.column(1).to_pylist())]
        sets = [ngram_set(w).tobytes() for w, r in zip(words, right) if r]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(right, pa.bool_())), pa.array(sets, pa.binary())], ["cls", "grams"])


def drop_earlier(found: np.ndarray, left: list[set[int]], right: list[set[int]]) -> None:
    """Clear the pairs of rows and columns that have an earlier unit in common."""
    rows, columns = {}, {}
    for places, sets in ((rows, left), (columns, right)):
        for k, codes in enumerate(sets):
            for code in codes:
                places.setdefault(code, []).append(k)
    for code in rows.keys() & columns.keys():
        found[np.ix_(rows[code], columns[code])] = False


def similar(a: list[np.ndarray], b: list[np.ndarray] | None, threshold=THRESHOLD) -> np.ndarray:
    """Which sets of a are similar to which of b (to which other of a where b is None): a boolean matrix."""
    sets = a + (b or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    sorted_values = values[order]
    new = np.r_[True, sorted_values[1:] != sorted_values[:-1]]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # a gram of one set is in no intersection
    member = np.repeat(np.arange(len(sets)), sizes)[order][often]
    column = column[often]
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1 if len(column) else column
    n = len(a)
    shared = np.zeros((n, len(b) if b is not None else n), np.float32)
    width = 4096
    bounds = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + width + 1, width))
    for lo, hi in zip(bounds, bounds[1:]):
        if lo == hi:
            continue
        block = np.zeros((len(sets), width), np.float32)
        block[member[lo:hi], column[lo:hi] % width] = 1
        shared += block[:n] @ (block[n:] if b is not None else block).T
    shared = np.rint(shared).astype(np.int64)
    union = sizes[:n, None] + (sizes[n:] if b is not None else sizes)[None, :] - shared
    found = shared * threshold[1] >= union * threshold[0]
    if b is None:
        np.fill_diagonal(found, False)
    return found


def roots(found: np.ndarray, square: bool) -> np.ndarray:
    """For each row (and, where not square, each column after them) the least number it is linked with, by others too."""
    n, m = found.shape
    label = np.arange(n if square else n + m)
    while True:
        old = label.copy()
        right = label if square else label[n:]
        low = np.where(found, right[None, :], len(label)).min(1, initial=len(label))
        label[:n] = np.minimum(label[:n], low)
        if not square:
            low = np.where(found, label[:n, None], len(label)).min(0, initial=len(label))
            label[n:] = np.minimum(label[n:], low)
        label = label[label]
        if (label == old).all():
            return label


def verify(members: DataFrame, block: int = BLOCK, threshold=THRESHOLD) -> DataFrame:
    """cls, links, root for rows (cls, unit, codes, copies, grams): its links with other classes' texts in a pair of blocks.

    Links count copies. A class has one row for each task that it has links in; rows that repeat a class count once.
    """
    sizes = members.groupBy("unit").agg(F.count("*").alias("size"))
    sizes = write_table(sizes.select(F.col("unit").alias("u"), F.ceil(F.col("size") / block).cast("int").alias("blocks")), "unit-sizes")
    dealt = members.join(sizes, F.col("unit") == F.col("u")).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    own = ["cls", "copies", "mine", "grams", "codes"]
    dealt = dealt.select("unit.kind", "unit.code", *own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("kind", "code", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), *own)
    task = ["kind", "code", "lo", "hi"]
    sorted_ = dealt.repartition(*task).sortWithinPartitions(*task, "cls")

    def apply(batches):
        for (_, code, lo, hi), slices in runs(batches, task):
            columns = {k: [x for s in slices for x in s.column(s.schema.get_field_index(k)).to_pylist()] for k in own}
            cls = np.array(columns["cls"], np.int64)
            mine = np.where(np.r_[True, cls[1:] != cls[:-1]], columns["mine"], -1)
            left = np.flatnonzero(mine == lo)
            right = left if lo == hi else np.flatnonzero(mine == hi)
            if not len(left) or not len(right) or (lo == hi and len(left) < 2):
                continue
            todo = np.ones((len(left), len(right)), bool)
            earlier = [set(c[: c.index(code)]) if c else set() for c in columns["codes"]]
            if any(earlier):
                drop_earlier(todo, [earlier[k] for k in left], [earlier[k] for k in right])
            if lo == hi:
                np.fill_diagonal(todo, False)
            rows, others = todo.any(1), todo.any(0)
            if not rows.any():
                continue
            # only those go on that have a pair left
            todo, left, right = todo[np.ix_(rows, others)], left[rows], right[others]
            sets = {k: np.frombuffer(columns["grams"][k], np.uint64) for k in {*left.tolist(), *right.tolist()}}
            found = similar([sets[k] for k in left], None if lo == hi else [sets[k] for k in right], threshold) & todo
            copies = np.array(columns["copies"], np.int64)
            if lo == hi:
                order, links = left, found @ copies[left]
            else:
                order, links = np.r_[left, right], np.r_[found @ copies[right], copies[left] @ found]
            label = roots(found, lo == hi)
            hit = np.flatnonzero(links)
            if len(hit):
                of = cls[order]
                yield pa.RecordBatch.from_arrays([pa.array(of[hit]), pa.array(links[hit], pa.int64()), pa.array(of[label[hit]])], ["cls", "links", "root"])

    return sorted_.mapInArrow(apply, "cls long, links long, root long")


def join_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """One row for each row of df: doc_id, class_id (least doc_id that links lead to), n_links, n_copies, kept."""
    with scratch():
        sketches = keep(write_table(sketched(df, id_col, text_col, rows, bands), "sketches"))
        # copies are summed before they are shuffled
        classes = sketches.filter("key is not null").groupBy("key").agg(F.min("id").alias("first"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
        classes = write_table(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
        units = write_table(candidate_units(classes.filter("first is not null").select("cls", "bands"), block), "units")
        wanted = classes.select("cls", "key", "first").join(units.select(F.col("cls").alias("w")).distinct(), F.col("cls") == F.col("w"))
        texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, F.col("id") == F.col("first"))
        grams = texts.select("cls", "key", "text").mapInArrow(_sets, "cls long, grams binary").withColumnRenamed("cls", "g_cls")
        members = units.join(classes.select(F.col("cls").alias("m_cls"), "copies"), F.col("cls") == F.col("m_cls"))
        members = grams.join(members, F.col("g_cls") == F.col("cls")).select("cls", "unit", "codes", "copies", "grams")
        found = write_table(verify(members, block), "links")
        of_class = keep(write_table(class_results(classes, found), "class-results"))
    with_words = sketches.select("id", "key").join(of_class, F.col("key") == F.col("c_key")).select(
        F.col("id").alias("doc_id"), "class_id", "n_links", F.col("copies").alias("n_copies"), F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )
    without = sketches.filter("key is null").withColumnRenamed("id", "doc_id")
    without = without.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("kept"))
    return with_words.unionByName(without)


def class_results(classes: DataFrame, found: DataFrame) -> DataFrame:
    """c_key, class_id, n_links, copies of classes (cls, key, first, copies) with the links found by verify()."""
    linked = found.groupBy(F.col("cls").alias("l_cls")).agg(F.sum("links").alias("links"))
    joined = write_table(components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))), "joined")
    of_class = classes.join(linked, F.col("cls") == F.col("l_cls"), "left").join(joined, F.col("cls") == F.col("node"), "left")
    of_class = of_class.select("key", "first", "copies", F.coalesce("component", "cls").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = of_class.groupBy(F.col("component").alias("m_component")).agg(F.min("first").alias("class_id"))
    return of_class.join(least, F.col("component") == F.col("m_component")).select(F.col("key").alias("c_key"), "class_id", "n_links", "copies")


def query(spark, sf_dir: str) -> DataFrame:
    return join_texts(docs_of(spark, sf_dir))
