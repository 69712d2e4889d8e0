"""Packing with a controlled mixture, by deficit round-robin over source queues.

Each source's documents form a queue. A window gives every queue a quantum of tokens in the target
proportions; a queue sends documents as long as its deficit covers them and carries the rest of it
into the next window. A document is thus sent in the first window in which its queue's quanta so
far reach its end in the queue: window = (end - 1) // quantum. So deficits need no loop: prefix
sums over queues give the windows, and prefix sums over windows give each document's first token
in the stream of all documents, across partitions. The stream is cut at every 2048 tokens; only
its last sequence is padded.

Prefix sums run on two levels, over cells of a queue and over blocks of windows, so that no task
sorts a whole source or the whole stream.

Defined results: a null text packs as its end token only; a null source is a queue of its own;
repeated rows and repeated or null ids are packed each row by itself; a very long text
goes on through as many sequences as it fills; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from .shared import docs_of, write_table

MODEL = "byte_bpe_50k.json"
END = 1
LENGTH = 2048
#: Tokens of a window.
WINDOW = 64 * LENGTH
#: Rows of a cell, in which a task sorts a part of a queue.
CELL_ROWS = 50_000
LEAST_CELLS = 512
#: Windows of a block.
BLOCK = 1024
MEMO = 600_000


class Tokens:
    """Ids of whole texts by a tokenizers file, through memoised chunks.

    A byte-level split never joins a word to a space that follows it, so a text is cut before runs
    of spaces and line ends that follow another character. Nor does it join letters or digits to a
    punctuation mark that follows them: a run of them is cut off there. Texts with other white space, or with a
    special token's string, are encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([r"[^\S \n]", *map(re.escape, special)])).search
        letters = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
        self.chunks = re.compile(rf"[ \n]*[{letters}]++(?=[!-/:-@\[-`{{-~])|[ \n]*[^ \n]+|[ \n]+").findall
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint16 or uint32 ids of each text, with END."""
        known, code = self.memo, self.dtype
        if len(known) > MEMO:
            known.clear()
        split = [self.chunks(t) if t and not self.whole(t) else None for t in texts]
        missing = list(set().union(*(s for s in split if s)).difference(known))
        for at in range(0, len(missing), 20_000):
            part = missing[at : at + 20_000]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[chunk] = np.array(found.ids, code).tobytes()
        end = np.array([END], code).tobytes()
        out = []
        for text, chunks in zip(texts, split):
            if chunks is not None:
                out.append(b"".join(map(known.__getitem__, chunks)) + end)
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids if text else []
                out.append(np.array(ids, code).tobytes() + end)
        for chunk in missing:
            if len(chunk) > 64:
                del known[chunk]
        return out

    @functools.cached_property
    def dtype(self) -> str:
        return "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


@functools.lru_cache(1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def tokenised(df: DataFrame, id_col: str, text_col: str, source_col: str, model: str) -> DataFrame:
    """row, doc_id, source, n, ids of each row, written in the shared folder: texts are encoded once."""

    def apply(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = tokens(public_tokenizers.path(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = encoder.encode(part.column(2).to_pylist())
                width = np.dtype(encoder.dtype).itemsize
                n = pa.array([len(x) // width for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, pa.array(ids, pa.binary())], ["doc_id", "source", "n", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(apply, "doc_id long, source string, n long, ids binary")
    return write_table(rows.withColumn("row", F.monotonically_increasing_id()), "tokens")


def positions(rows: DataFrame, mixture: dict[str, float] | None = None, window: int = WINDOW, cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """row, first: each row's first token in the stream of all rows.

    mixture: target share of each source; by default a source's share of all tokens, with which all
    queues end together. Sources that it leaves out share evenly what it leaves.
    """
    if cells is None:
        cells = max(LEAST_CELLS, rows.count() // CELL_ROWS)
    keyed = rows.select("row", "source", "n", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int").alias("cell"))
    by_cell = keyed.groupBy("source", "cell").agg(F.sum("n").alias("tokens"))
    totals = by_cell.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    all_tokens = totals.agg(F.sum("source_tokens").alias("all_tokens"), F.count("*").alias("n_sources"))
    share = F.col("source_tokens") / F.col("all_tokens")
    if mixture:
        named = F.create_map(*[x for k, v in mixture.items() for x in (F.lit(k), F.lit(float(v)))])
        left = F.lit(max(0.0, 1.0 - sum(mixture.values()))) / F.greatest(F.lit(1), F.col("n_sources") - len(mixture))
        share = F.coalesce(named[F.col("source")], left)
    quanta = totals.crossJoin(F.broadcast(all_tokens)).select(F.col("source").alias("q_source"), F.greatest(F.lit(1), F.round(share * window)).cast("long").alias("quantum"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_first = by_cell.select("source", "cell", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("cell_first"))
    cell_first = cell_first.join(quanta, F.col("source").eqNullSafe(F.col("q_source"))).select(F.col("source").alias("c_source"), F.col("cell").alias("c_cell"), "cell_first", "quantum")

    upto = Window.partitionBy("source", "cell").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    queued = keyed.withColumn("upto", F.sum("n").over(upto)).join(cell_first, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("c_cell")))
    queued = queued.select(
        "row", "source", "n", (F.col("cell_first") + F.col("upto") - F.col("n")).alias("queue_first"),
        F.expr("(cell_first + upto - 1) div quantum").alias("win"),
    )
    queued = write_table(queued, "queued")

    sent = queued.groupBy("win", "source").agg(F.sum("n").alias("sent"), F.min("queue_first").alias("base"))
    sent = sent.withColumn("blk", F.expr(f"win div {block}"))
    by_block = sent.groupBy("blk").agg(F.sum("sent").alias("block_sent"))
    # one row for each `block` windows, that is `block * window` tokens
    block_first = by_block.select("blk", F.coalesce(F.sum("block_sent").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("block_first"))
    in_block = Window.partitionBy("blk").orderBy("win", "source").rowsBetween(Window.unboundedPreceding, -1)
    sent = sent.withColumn("in_block", F.coalesce(F.sum("sent").over(in_block), F.lit(0))).join(block_first, "blk")
    sent = sent.select(F.col("win").alias("s_win"), F.col("source").alias("s_source"), (F.col("block_first") + F.col("in_block") - F.col("base")).alias("shift"))
    placed = queued.join(sent, (F.col("win") == F.col("s_win")) & F.col("source").eqNullSafe(F.col("s_source")))
    return placed.select("row", (F.col("queue_first") + F.col("shift")).alias("first"))


def pieces(rows: DataFrame, first: DataFrame, length: int = LENGTH, wide: bool = False) -> DataFrame:
    """One row for each part of a document in a sequence, with its ids."""

    def apply(batches):
        for batch in batches:
            names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
            out: dict[str, list] = {k: [] for k in names}
            for doc, at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids = np.frombuffer(data, "<u4" if wide else "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, len(ids) - start)
                    for k, v in zip(names, (doc, start, size, len(ids), sequence, offset, ids[start : start + size].tobytes())):
                        out[k].append(v)
                    start += size
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, types)], list(names))

    joined = rows.select("row", "doc_id", "ids").join(first, "row").select("doc_id", "first", "ids")
    return joined.mapInArrow(apply, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", model: str = MODEL, mixture: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32) of all pieces."""
    rows = tokenised(df, id_col, text_col, source_col, model)
    wide = tokens(public_tokenizers.path(model)).dtype == "<u4"
    return pieces(rows, positions(rows, mixture, window), length, wide)


def digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(pack(docs_of(spark, sf_dir)))
