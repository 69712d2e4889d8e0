"""Weighted word similarity by an inverted index.

Rows are dealt into blocks; a block holds its rows' postings word by word. A task takes two blocks and
adds up the products of each word that both have, for all their pairs of rows at once. So only
postings are shuffled, each as often as there are blocks, and never a pair below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Postings of a block; at least so many blocks, so that tasks share the work.
BLOCK_POSTINGS = 3_000_000
LEAST_BLOCKS = 6
#: Postings in a row of a block's table.
PART_POSTINGS = 250_000
#: Sums that a task holds at once, and products that it makes at once for words that few rows have.
CELLS = 2_000_000
PRODUCTS = 1_000_000
#: A word goes into a matrix of its own column if a row of it costs at most so many cells a product.
CELLS_A_PRODUCT = 40


def weights(words: DataFrame, id_col: str = "id") -> DataFrame:
    """id, word, w: tf-idf of rows (id, word), one for each occurrence; similar_pairs() scales it to length 1.

    tf is 1 + ln(count) and idf ln((N + 1) / (df + 1)), so a word of all documents weighs 0 and is left out.
    """
    counted = words.groupBy(id_col, "word").agg(F.count("*").alias("c"))
    df = counted.groupBy("word").agg(F.count("*").alias("df"))
    n = words.agg(F.countDistinct(id_col).alias("n"))
    raw = counted.join(df, "word").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("c")) * F.log((F.col("n") + 1) / (F.col("df") + 1)))
    return raw.filter("w > 0").select(id_col, "word", "w")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, postings: int | None = None) -> DataFrame:
    """left_id, right_id, cosine of pairs that share a word and reach the threshold, which is above 0.

    left and right: id, word, w above 0, a word once for an id; rows with a null id or word make no pair.
    postings: about how many rows the larger one has (None: they are counted); it sets the number of blocks.
    """
    n = _number(max(left.count(), right.count()) if postings is None else postings)
    others = F.sequence(F.lit(0), F.lit(n - 1))
    a = _blocks(left, n).withColumn("other", F.explode(others)).withColumn("pair", F.col("block") * n + F.col("other")).withColumn("side", F.lit(0))
    b = _blocks(right, n).withColumn("other", F.explode(others)).withColumn("pair", F.col("other") * n + F.col("block")).withColumn("side", F.lit(1))
    return _compared(a.unionByName(b), n * n, threshold, False, left, right)


def similar_within(rows: DataFrame, threshold: float, postings: int | None = None) -> DataFrame:
    """similar_pairs() of rows with themselves, those with left_id < right_id."""
    n = _number(rows.count() if postings is None else postings)
    dealt = _blocks(rows, n).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = dealt.withColumn("pair", F.expr("greatest(block, other) * (greatest(block, other) + 1) div 2 + least(block, other)").cast("int"))
    dealt = dealt.withColumn("side", F.when(F.col("block") > F.col("other"), 1).otherwise(0))
    return _compared(dealt, n * (n + 1) // 2, threshold, True, rows, rows)


def _number(postings: int) -> int:
    return max(LEAST_BLOCKS, -(-postings // BLOCK_POSTINGS))


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """block, part, ids, words, counts, docs, w: a block's postings by word, in parts; part 0 has its ids."""
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.filter("id is not null and word is not null and w > 0").select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"), "id", "word", F.col("w").cast("double").alias("w"))

    def pack(batches):
        for block, table in _groups(batches):
            coded = table["id"].combine_chunks().dictionary_encode()
            docs, w, words = coded.indices.to_numpy().astype("<i4"), table["w"].to_numpy(), table["word"].combine_chunks()
            first = np.flatnonzero(np.concatenate([[True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)]))
            ends = np.append(first[1:], len(words))
            # words go to parts by where they start
            cuts = np.flatnonzero(np.diff(first // PART_POSTINGS)) + 1
            for part, ks in enumerate(np.split(np.arange(len(first)), cuts)):
                a, b = first[ks[0]], ends[ks[-1]]
                ids = coded.dictionary if part == 0 else coded.dictionary[:0]
                counts = (ends - first)[ks].astype("<i4")
                row = [[block], [part], [ids.to_pylist()], [words.take(pa.array(first[ks])).to_pylist()], [counts.tobytes()], [docs[a:b].tobytes()], [w[a:b].astype("<f8").tobytes()]]
                types = [pa.int32(), pa.int32(), pa.list_(ids.type), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["block", "part", "ids", "words", "counts", "docs", "w"])

    held = dealt.repartitionById(n, F.col("block")).sortWithinPartitions("block", "word")
    return held.mapInArrow(pack, f"block int, part int, ids array<{kind}>, words array<string>, counts binary, docs binary, w binary")


def _groups(batches) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each run of equal numbers in the first column."""
    current, held = None, []
    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        for at in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
            if not len(at):
                continue
            if held and numbers[at[0]] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = int(numbers[at[0]])
            held.append(batch.slice(at[0], len(at)))
    if held:
        yield current, pa.Table.from_batches(held)


class _Block:
    """Postings by word, with weights scaled to length 1 for each row."""

    def __init__(self, parts: pa.Table):
        joined = lambda name, code: np.concatenate([np.frombuffer(x.as_buffer(), code) for x in parts[name]])
        self.ids = parts["ids"].combine_chunks().flatten()
        self.words = parts["words"].combine_chunks().flatten()
        self.counts = joined("counts", "<i4").astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.docs, w = joined("docs", "<i4"), joined("w", "<f8")
        self.w = w / np.sqrt(np.bincount(self.docs, w * w, len(self.ids)))[self.docs]

    def postings(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words' postings, and for each the place of its word in words."""
        counts = self.counts[words]
        of = np.repeat(np.arange(len(words)), counts)
        return np.arange(len(of)) + (self.starts[words] - (np.cumsum(counts) - counts))[of], of

    def matrix(self, words: np.ndarray) -> np.ndarray:
        at, of = self.postings(words)
        out = np.zeros((len(self.ids), len(words)))
        out[self.docs[at], of] = self.w[at]
        return out


def _hits(a: _Block, b: _Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of a, row of b and cosine of pairs that reach the threshold."""
    found = pc.index_in(b.words, value_set=a.words)
    of_b = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    of_a = found.drop_null().to_numpy().astype(np.int64)
    products = a.counts[of_a] * b.counts[of_b]
    rows, columns = len(a.ids), len(b.ids)
    order = np.argsort(-products, kind="stable")[: 2 * CELLS // max(rows, columns)]
    dense = order[products[order] * CELLS_A_PRODUCT > rows * columns]
    sparse = np.setdiff1d(np.arange(len(of_a)), dense)
    left, right = a.matrix(of_a[dense]), b.matrix(of_b[dense]).T

    at, of = a.postings(of_a[sparse])
    by_row = np.argsort(a.docs[at], kind="stable")
    at, of = at[by_row], of[by_row]
    docs, w, counts, starts = a.docs[at].astype(np.int64), a.w[at], b.counts[of_b[sparse]][of], b.starts[of_b[sparse]][of]
    made = np.concatenate([[0], np.cumsum(counts)])
    step = max(1, CELLS // columns)
    for first in range(0, rows, step):
        height = min(step, rows - first)
        sums = (left[first : first + height] @ right).ravel()
        lo, end = np.searchsorted(docs, [first, first + height])
        while lo < end:
            hi = min(end, max(lo + 1, int(np.searchsorted(made, made[lo] + PRODUCTS, "right")) - 1))
            posting = np.repeat(np.arange(lo, hi), counts[lo:hi])
            other = np.arange(len(posting)) + np.repeat(starts[lo:hi] - made[lo:hi] + made[lo], counts[lo:hi])
            sums += np.bincount((docs[posting] - first) * columns + b.docs[other], w[posting] * b.w[other], len(sums))
            lo = hi
        hit = np.flatnonzero(sums >= threshold)
        if len(hit):
            yield hit // columns + first, hit % columns, sums[hit]


def _compared(dealt: DataFrame, pairs: int, threshold: float, within: bool, left: DataFrame, right: DataFrame) -> DataFrame:
    """The results of each pair of blocks; within: of unordered pairs of rows, a pair of one block having side 0 only."""
    names = ["left_id", "right_id", "cosine"]

    def compare(batches):
        for _, table in _groups(batches):
            a, b = (_Block(part) if part.num_rows else None for part in (table.filter(pc.equal(table["side"], k)) for k in (0, 1)))
            same = within and table["block"][0] == table["other"][0]
            b = a if same else b
            if a is None or b is None:
                continue
            del table
            for x, y, cosine in _hits(a, b, threshold):
                if same:
                    x, y, cosine = x[x < y], y[x < y], cosine[x < y]
                ids = a.ids.take(pa.array(x)), b.ids.take(pa.array(y))
                if within:
                    ordered = pc.less(*ids)
                    ids = pc.if_else(ordered, *ids), pc.if_else(ordered, *ids[::-1])
                yield pa.RecordBatch.from_arrays([*ids, pa.array(cosine)], names)

    kinds = [x.schema["id"].dataType.simpleString() for x in (left, right)]
    held = dealt.select("pair", "side", "part", "block", "other", "ids", "words", "counts", "docs", "w").repartitionById(pairs, F.col("pair")).sortWithinPartitions("pair", "side", "part")
    return held.mapInArrow(compare, f"left_id {kinds[0]}, right_id {kinds[1]}, cosine double")
