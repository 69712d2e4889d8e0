"""Embedding near-dedup by a forest of random-projection trees.

Each of TREES trees splits vectors recursively at the median of a random projection until a leaf
has about LEAF vectors at most. Vectors near a split go to both sides (spill), so that neighbours
seldom part. The band of these is the middle 2 * SPILL of the node, and at least as wide as the
spread of the projected distance of a pair at the threshold, however tight the node is. A node of
which the band would hold more than MOST_SPILL is split no further.

The nodes of one level of a tree share their direction, so a vector is projected once, by one
product, and only its projections travel down the trees. Splits are fitted for each node on about
SAMPLE projections drawn by hash, LEVELS at a time, in as many rounds as the table needs; all
vectors are routed, batch by batch in whole arrays. A leaf that is not split further is compared
in pairs of blocks, so nothing is capped.

Within leaves all pairs are compared by cosine in double precision. A pair that shares several
leaves counts in the first of them only, which each task sees from the vectors' own lists of
leaves; so no pair is ever written. Tasks return each vector's number of links and one edge to its
component within the leaf; the edges' components are the result.

Equal vectors are one class before the forest: copies only add to the counts. Vectors of each
length have trees of their own. Defined results: vectors that are null, zero, or that hold null or
non-finite components link with nothing, and each is its own component; ties and repeated rows are
copies, with one id or many; a row with a null id links like any other, but only ids that are not
null become a component's id (null where there is none, and its rows are kept); an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .ngram_join import drop_earlier, roots
from .shared import delete_table, keep, runs, scratch, write_table

THRESHOLD = 0.95
TREES = 8
LEAF = 256
SPILL = 0.06
MOST_SPILL = 0.3
#: So many found pairs in a task are looked up one by one at most.
FEW_PAIRS = 20_000
SAMPLE = 4096
#: Levels of a tree that one round fits at most.
LEVELS = 6
BLOCK = 1024
#: So many nodes, of 0.5 KB each, are broadcast at most; more are shuffled.
FEW_NODES = 50_000


def _able(kind: str):
    def apply(batches):
        """vec_id, key, size, vector (as it is, in bytes) of all rows; key, size and vector are null where a vector links with nothing."""
        for batch in batches:
            column = batch.column(1)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become nan
            starts = np.cumsum(sizes) - sizes
            keys, vectors = [None] * len(sizes), [None] * len(sizes)
            for size in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == size)
                x = values[starts[at][:, None] + np.arange(size)]
                able = np.isfinite(x).all(1) & (x != 0).any(1)
                for k, row in zip(at[able].tolist(), x[able]):
                    keys[k] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
                    vectors[k] = row.astype(kind).tobytes()
            size = pa.array(np.where([k is None for k in keys], 0, sizes).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), size, pa.array(vectors, pa.binary())], ["vec_id", "key", "size", "vector"])

    return apply


def units(vectors: list[bytes], kind: str) -> np.ndarray:
    """Rows of length 1 in double precision of vectors that can link."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@functools.lru_cache(8)
def directions(size: int, trees: int, depth: int) -> np.ndarray:
    """(size, trees * depth): a random direction for each level of each tree, the same in every task."""
    return np.random.default_rng([17, size]).standard_normal((trees * depth, size)).T


def projected(classes: DataFrame, kind: str, trees: int, depth: int) -> DataFrame:
    """cls, size, tree, path (the root), p: a class's projections in each tree, a float32 for each level."""

    def apply(batches):
        for batch in batches:
            cls, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = units(batch.column(2).take(pa.array(at)).to_pylist(), kind)
                p = (x @ directions(int(size), trees, depth)).astype("<f4").reshape(-1, depth)
                n = len(p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(cls[at], trees)), pa.array(np.full(n, size, np.int32)), pa.array(np.tile(np.arange(trees, dtype=np.int32), len(at))), pa.array(np.ones(n, np.int64)), packed(p)],
                    ["cls", "size", "tree", "path", "p"],
                )

    return classes.select("cls", "size", "vector").mapInArrow(apply, "cls long, size int, tree int, path long, p binary")


def packed(p: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as binary values."""
    width = p.shape[1] * 4
    ends = np.arange(len(p) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(p, "<f4").tobytes())])


def matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f4").reshape(len(values), -1)


SMALL, TIGHT = 0.0, 1.0


def fit_node(p: np.ndarray, n: int, level: int, leaf: int, levels: int = LEVELS, spill: float = SPILL, threshold: float = THRESHOLD) -> np.ndarray:
    """Spill bounds of a node and those below it, in the order of a heap, from projections of some of its n vectors.

    Where a node ends the lower bound is nan, and the upper one SMALL or TIGHT.
    """
    bounds = np.full(((1 << levels) - 1, 2), [np.nan, SMALL], "<f4")
    half = np.sqrt(max(0.0, 2 - 2 * threshold)) / 2  # of the distance of a pair at the threshold
    todo = [(1, np.arange(len(p)))]
    while todo:
        node, rows = todo.pop()
        at = level + node.bit_length() - 1
        if at >= p.shape[1]:
            bounds[node - 1, 1] = TIGHT
            continue
        if len(rows) < 16 or len(rows) / len(p) * n <= leaf:
            continue
        x = p[rows, at]
        low, middle, high = np.quantile(x, [0.5 - spill, 0.5, 0.5 + spill])
        low, high = np.float32(min(low, middle - half)), np.float32(max(high, middle + half))
        if x.min() == x.max() or ((x >= low) & (x < high)).mean() > MOST_SPILL:
            bounds[node - 1, 1] = TIGHT
            continue
        bounds[node - 1] = low, high
        if 2 * node < 1 << levels:
            todo += [(2 * node, rows[x < high]), (2 * node + 1, rows[x >= low])]
    return bounds


def route(p: np.ndarray, path: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where rows go: the rows' numbers, the nodes' paths, and whether a node is tight.

    p: projections; path: the node that each row is in; bounds[of[k]] are those of the node of row k.
    """
    level = np.frexp(path.astype(np.float64))[1] - 1
    rows, node = np.arange(len(p)), np.ones(len(p), np.int64)
    out = []
    for down in range((bounds.shape[1] + 1).bit_length() - 1):
        low, high = bounds[of[rows], node - 1].T
        ends = np.isnan(low)
        at = rows[ends]
        out.append((at, (path[at] << down) + node[ends] - (1 << down), high[ends] == TIGHT))
        rows, node, low, high = rows[~ends], node[~ends], low[~ends], high[~ends]
        x = p[rows, level[rows] + down]
        left, right = x < high, x >= low
        rows, node = np.r_[rows[left], rows[right]], np.r_[2 * node[left], 2 * node[right] + 1]
    down = (bounds.shape[1] + 1).bit_length() - 1
    out.append((rows, (path[rows] << down) + node - (1 << down), np.zeros(len(rows), bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _send(batches):
    """cls, size, tree, path, p, splits: each row goes down its node's splits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        splits = batch.column(5).dictionary_encode()
        bounds = np.stack([matrix([x]).reshape(-1, 2) for x in splits.dictionary.to_pylist()])
        p = matrix(batch.column(4).to_pylist())
        cls, size, tree, path = (batch.column(k).to_numpy() for k in range(4))
        rows, to, tight = route(p, path, bounds, splits.indices.to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(cls[rows]), pa.array(size[rows]), pa.array(tree[rows]), pa.array(to), packed(p[rows]), pa.array(tight)], ["cls", "size", "tree", "path", "p", "tight"]
        )


NODE = ["size", "tree", "path"]


def _of_node(rows: DataFrame, nodes: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with the columns of their node; nodes are broadcast if there are few."""
    nodes = nodes.withColumnsRenamed({k: "n_" + k for k in NODE})
    on = (F.col("size") == F.col("n_size")) & (F.col("tree") == F.col("n_tree")) & (F.col("path") == F.col("n_path"))
    return rows.join(F.broadcast(nodes) if few else nodes, on, how).drop("n_size", "n_tree", "n_path")


def grow(classes: DataFrame, kind: str = "<f8", trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, levels: int = LEVELS, threshold: float = THRESHOLD) -> DataFrame:
    """cls, size, tree, path: the leaves of each class in each tree."""
    spark = classes.sparkSession
    by_size = classes.groupBy("size").agg(F.count("*").alias("n"))
    most = by_size.agg(F.max("n")).first()[0] or 1
    # as many levels as the largest table of one length needs, and some for uneven splits
    depth = max(1, min(40, int(np.ceil(np.log(max(1.0, most / leaf)) / -np.log(0.5 + SPILL)) + 4)))
    root = by_size.crossJoin(spark.range(trees).select(F.col("id").cast("int").alias("tree"))).select("size", "tree", F.lit(1).cast("long").alias("path"), "n")
    places, nodes = projected(classes, kind, trees, depth).withColumn("tight", F.lit(False)), write_table(root, "nodes")
    done, past = [], None
    while True:
        # a little over is no reason for another round; leaves are compared in blocks anyway
        big = write_table(nodes.filter(F.col("n") > (leaf if past is None else 2 * leaf)), "big-nodes")
        few = big.count() <= FEW_NODES
        placed = _of_node(places, big, few, "left")
        done.append(write_table(placed.filter("n is null").select("cls", *NODE), "leaves"))
        if big.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        going = placed.filter("n is not null").drop("tight")
        chance = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
        drawn = going.filter(F.pmod(F.xxhash64("cls", "path", "tree"), F.lit(1 << 30)) < chance * (1 << 30)).select(*NODE, "n", "p")

        def fit(table: pa.Table) -> pa.Table:  # about `sample` rows of one node
            size, tree, path, n = (table.column(k)[0].as_py() for k in range(4))
            bounds = fit_node(matrix(table.column(4).to_pylist()), n, path.bit_length() - 1, leaf, levels, threshold=threshold)
            return pa.table({"size": pa.array([size], pa.int32()), "tree": pa.array([tree], pa.int32()), "path": pa.array([path], pa.int64()), "splits": pa.array([bounds.tobytes()], pa.binary())})

        splits = write_table(drawn.groupBy(*NODE).applyInArrow(fit, "size int, tree int, path long, splits binary"), "splits")
        # splits last: they would be shuffled with each row
        routed = _of_node(going.drop("n"), splits, few).select("cls", *NODE, "p", "splits")
        new = write_table(routed.mapInArrow(_send, "cls long, size int, tree int, path long, p binary, tight boolean"), "places")
        if past is not None:
            delete_table(past)
        done.append(write_table(new.filter("tight").select("cls", *NODE), "leaves"))
        places = past = new
        places = places.filter("not tight")
        nodes = places.groupBy(*NODE).agg(F.count("*").alias("n"))


def compare(classes: DataFrame, leaves: DataFrame, kind: str = "<f8", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """cls, links, root: links of each class found first in a leaf, counting copies, and its component there."""
    leaves = leaves.select("cls", "size", F.shiftleft("path", 8).bitwiseOR(F.col("tree").cast("long")).alias("leaf"))
    listed = leaves.groupBy(F.col("cls").alias("l_cls")).agg(F.sort_array(F.collect_list("leaf")).alias("codes"))  # a few for each tree
    full = classes.join(listed, F.col("cls") == F.col("l_cls")).select("cls", "copies", "size", "vector", "codes")
    rows = full.withColumn("leaf", F.explode("codes"))
    sizes = leaves.groupBy(F.col("size").alias("s_size"), F.col("leaf").alias("s_leaf")).agg(F.count("*").alias("n")).filter("n > 1")
    sizes = write_table(sizes.select("s_size", "s_leaf", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "leaf-sizes")
    dealt = rows.join(sizes, (F.col("size") == F.col("s_size")) & (F.col("leaf") == F.col("s_leaf"))).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    task = ["size", "leaf", "lo", "hi"]
    dealt = dealt.select(*task, "cls", "copies", "mine", "vector", "codes").repartition(*task).sortWithinPartitions(*task, "cls")

    def apply(batches):
        for (_, leaf, lo, hi), slices in runs(batches, task):
            names = slices[0].schema.names
            column = {k: [x for s in slices for x in s.column(names.index(k)).to_pylist()] for k in names[4:]}
            mine = np.array(column["mine"])
            left = np.flatnonzero(mine == lo)
            right = left if lo == hi else np.flatnonzero(mine == hi)
            if not len(left) or not len(right) or (lo == hi and len(left) < 2):
                continue
            sets = [column["codes"][k] for k in range(len(mine))]
            earlier = [set(s[: s.index(leaf)]) for s in sets]
            if set.intersection(*earlier):
                continue  # another leaf has all of these pairs
            x = units(column["vector"], kind)
            found = x[left] @ x[right].T >= threshold
            if lo == hi:
                np.fill_diagonal(found, False)
            # a pair counts in the first leaf that both lists hold
            if np.count_nonzero(found) <= FEW_PAIRS:
                a, b = np.nonzero(found)
                keep = np.array([earlier[left[i]].isdisjoint(earlier[right[j]]) for i, j in zip(a.tolist(), b.tolist())], bool)
                found[a[~keep], b[~keep]] = False
            else:
                drop_earlier(found, [earlier[k] for k in left], [earlier[k] for k in right])
            copies = np.array(column["copies"], np.int64)
            if lo == hi:
                order, links = left, found @ copies[left]
            else:
                order, links = np.r_[left, right], np.r_[found @ copies[right], copies[left] @ found]
            label = roots(found, lo == hi)
            hit = np.flatnonzero(links)
            cls = np.array(column["cls"], np.int64)[order]
            yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(links[hit], pa.int64()), pa.array(cls[label[hit]])], ["cls", "links", "root"])

    return dealt.mapInArrow(apply, "cls long, links long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id, kept."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    element = df.schema[vector_col].dataType.elementType
    kind = "<f4" if element.typeName() == "float" else "<f8"
    with scratch():
        able = write_table(rows.mapInArrow(_able(kind), "vec_id long, key binary, size int, vector binary"), "able")
        classes = able.filter("key is not null").groupBy("key").agg(F.first("size").alias("size"), F.min("vec_id").alias("first"), F.min("vector").alias("vector"), F.count("*").alias("copies"))
        classes = write_table(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
        members = keep(write_table(able.select("vec_id", "key"), "vector-members"))
        delete_table(able)
        found = write_table(compare(classes, grow(classes, kind, trees, leaf, threshold=threshold), kind, threshold), "vector-links")
        linked = found.groupBy(F.col("cls").alias("l_cls")).agg(F.sum("links").alias("links"))
        joined = write_table(components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))), "vector-joined")
        of_class = classes.join(linked, F.col("cls") == F.col("l_cls"), "left").join(joined, F.col("cls") == F.col("node"), "left")
        of_class = of_class.select("key", "first", F.coalesce("component", "cls").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        least = of_class.groupBy(F.col("component").alias("m_component")).agg(F.min("first").alias("component_id"))
        of_class = of_class.join(least, F.col("component") == F.col("m_component")).select(F.col("key").alias("c_key"), "component_id", "n_links")
        of_class = keep(write_table(of_class, "vector-results"))
    linking = members.join(of_class, F.col("key") == F.col("c_key")).select("vec_id", "n_links", "component_id")
    alone = members.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linking.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
