"""Substring dedup by paragraph MinHash banding.

Paragraphs are lines of at least LEAST_WORDS words. Equal ones form a class; classes get MinHash
bands tuned for recall (a pair at similarity 0.8 shares a band with a probability of 0.998),
colliding ones are verified by exact Jaccard similarity of their word 5-grams, and linked ones are
clustered by components. Of each cluster that goes through two or more documents the first
paragraph (least document, then line) stays; the others are removed.

Passages that lie inside longer paragraphs are found beside this: each PASSAGE consecutive words
that an earlier document has too, whichever document that is, are removed, and nothing else. Of every
ANCHOR_GAP consecutive windows of ANCHOR words the one with the least hash is an anchor, so that equal
passages have equal anchors inside. Only passages whose anchors another document has too are candidates;
in every document that has them, their PASSAGE words are compared by 64-bit hashes.

A text of PASSAGE words or more whose words are those of an earlier document's is removed whole, before
its paragraphs and passages are looked at.

Only repeats across documents count. Lines of under LEAST_WORDS words are no paragraphs: short lines
recur by chance or convention, and a passage of over 50 words that spans them is found word by word.

Defined results: null texts stay null, texts without repeats stay as they are; a text that is all
repeats becomes empty; rows with one id count as one document, each cut at its own places; rows with
a null id count as one document that comes after all others; rows that repeat wholly get the same
result each; a column `spans` of the input is replaced; an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .components import components
from .ngram_join import NGRAM, MinHash, candidate_units, class_key, hashed_words, ngram_set, verify
from .shared import docs_of, fresh, keep, scratch, write_table

LEAST_WORDS = 40
ROWS, BANDS = 3, 9
ANCHOR, ANCHOR_GAP = 16, 15
#: A shared run of more than 50 words is a passage.
PASSAGE = 51

def _joint(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ right
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def window_hashes(hashes: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """Hashes of all windows of `size` words, put together from windows of powers of two."""
    count = max(0, len(hashes) - size + 1)
    out, at, width, powers = None, 0, 1, hashes
    while count:
        if size & width:
            part = powers[at : at + count]
            out, at = part if out is None else _joint(out, part), at + width
        if at == size:
            return out
        powers, width = _joint(powers[:-width], powers[width:]), 2 * width
    return np.zeros(0, np.uint64)


def anchors(mixed: np.ndarray, gap: int = ANCHOR_GAP) -> np.ndarray:
    """Numbers of the first words of the anchors; mixed: the hashes of all windows."""
    if len(mixed) <= gap:
        return np.array([int(mixed.argmin())]) if len(mixed) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(mixed, gap)
    at = np.unique(view.argmin(1) + np.arange(len(view)))
    return at


def candidates(count: int, shared: np.ndarray, gap: int = ANCHOR_GAP) -> np.ndarray:
    """First words of the passages of which each `gap` windows hold a shared anchor; count: of all windows."""
    inner = PASSAGE - ANCHOR + 1  # windows of a passage
    if count < inner:
        return np.zeros(0, np.int64)
    marked = np.zeros(count + 1, np.int64)
    marked[shared + 1] = 1
    upto = np.cumsum(marked)
    empty = np.cumsum(np.r_[0, upto[gap:] == upto[:-gap]])
    groups = inner - gap + 1
    return np.flatnonzero(empty[groups:] == empty[:-groups])


PARAGRAPH = "array<struct<line:int,start:int,end:int,key:binary,bands:array<bigint>>>"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ANCHORS = "array<bigint>"


def _described(least_words: int, rows: int, bands: int):
    def apply(batches):
        hasher = MinHash(rows, bands)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                paragraphs, marks, sets, where, whole = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    text = text or ""
                    hashes, start, _ = hashed_words(text)
                    grams = window_hashes(hashes, NGRAM)
                    own = []
                    first = 0
                    for number, line in enumerate(text.split("\n")):
                        last = first + len(line)
                        if len(line) >= 2 * least_words - 1:
                            lo, hi = np.searchsorted(start, [first, last])
                            if hi - lo >= least_words:
                                own.append({"line": number, "start": first, "end": last, "key": class_key(hashes[lo:hi])})
                                sets.append(grams[lo : hi - NGRAM + 1])  # minima don't mind repeats
                                where.append(own[-1])
                        first = last + 1
                    paragraphs.append(own)
                    whole.append({"key": class_key(hashes), "end": len(text)} if len(hashes) >= PASSAGE else None)
                    mixed = window_hashes(hashes)
                    marks.append(np.unique(mixed[anchors(mixed)]).view(np.int64))
                if sets:
                    for entry, found in zip(where, hasher.bands_of(sets)):
                        entry["bands"] = found
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(whole, pa.struct([("key", pa.binary()), ("end", pa.int32())])),
                        pa.array(paragraphs, pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))]))),
                        pa.array(marks, pa.list_(pa.int64())),
                    ],
                    ["doc", "text_key", "whole", "paragraphs", "anchors"],
                )

    return apply


def _grams(batches):
    """cls, grams of paragraphs."""
    for batch in batches:
        sets = [ngram_set(hashed_words(t)[0]).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["cls", "grams"])


ROW = ["doc", "text_key"]


def paragraph_spans(docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc, text_key, start, end of paragraphs to remove; paragraphs: doc, text_key, line, start, end, key, bands."""
    place = F.struct("doc", "line", "text_key", "start", "end")
    classes = paragraphs.groupBy("key").agg(F.min(place).alias("first"), F.max("doc").alias("most"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = write_table(classes.withColumn("cls", F.monotonically_increasing_id()), "paragraph-classes")
    units = write_table(candidate_units(classes.select("cls", "bands")), "paragraph-units")
    wanted = classes.join(units.select(F.col("cls").alias("w")).distinct(), F.col("cls") == F.col("w"))
    wanted = wanted.select("cls", F.col("first.doc").alias("w_doc"), F.col("first.text_key").alias("w_key"), F.col("first.start").alias("start"), F.col("first.end").alias("end"))
    # only the paragraph goes to Python: a document with many would go there whole for each
    paragraph = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("paragraph")
    texts = docs.filter("text is not null").join(wanted, (F.col("doc") == F.col("w_doc")) & (F.col("text_key") == F.col("w_key"))).select("cls", paragraph)
    grams = texts.mapInArrow(_grams, "cls long, grams binary").withColumnRenamed("cls", "g_cls")
    members = units.join(classes.select(F.col("cls").alias("m_cls"), "copies"), F.col("cls") == F.col("m_cls"))
    members = grams.join(members, F.col("g_cls") == F.col("cls")).select("cls", "unit", "codes", "copies", "grams")
    found = write_table(verify(members), "paragraph-links")
    joined = write_table(components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))), "paragraph-joined")
    grouped = classes.select("cls", "key", "first", "most").join(joined, F.col("cls") == F.col("node"), "left").withColumn("grp", F.coalesce("component", "cls"))
    groups = grouped.groupBy(F.col("grp").alias("g")).agg(F.min("first").alias("stays"), F.max("most").alias("most")).filter("stays.doc != most")
    groups = write_table(groups, "paragraph-groups")
    removable = grouped.join(groups, F.col("grp") == F.col("g")).select(F.col("key").alias("r_key"), F.col("stays.doc").alias("s_doc"), F.col("stays.line").alias("s_line"))
    hit = paragraphs.join(write_table(removable, "removable"), F.col("key") == F.col("r_key"))
    return hit.filter("doc != s_doc or line != s_line").select(*ROW, "start", "end")


PASSAGES = "doc long, text_key long, hashes array<bigint>, starts array<int>, ends array<int>"


def _passages(batches):
    """doc, text_key, hashes, starts, ends of the candidates of texts (doc, text_key, text, shared anchors)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            out = ([], [], [], [], [])
            for doc, key, text, known in zip(*(c.to_pylist() for c in part.columns)):
                hashes, start, end = hashed_words(text)
                mixed = window_hashes(hashes)
                pos = anchors(mixed)
                pos = pos[np.isin(mixed[pos], np.array(known, np.int64).view(np.uint64))]
                first = candidates(len(mixed), pos)
                if not len(first):
                    continue
                # windows that cover the passage together
                cover = [mixed[first + k] for k in (*range(0, PASSAGE - ANCHOR, ANCHOR), PASSAGE - ANCHOR)]
                hashes = window_hashes(np.stack(cover, 1).ravel(), len(cover))[:: len(cover)].view(np.int64)
                for column, value in zip(out, (doc, key, hashes, start[first], end[first + PASSAGE - 1])):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [*ROW, "hashes", "starts", "ends"])


def _joined(batches):
    """doc, text_key, start, end of spans (doc, text_key, spans), those that overlap as one."""
    for batch in batches:
        rows = [(doc, key, a, b) for doc, key, spans in zip(*(c.to_pylist() for c in batch.columns)) for a, b in merged([(s["start"], s["end"]) for s in spans])]
        columns = zip(*rows) if rows else ((), (), (), ())
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*ROW, "start", "end"])


def passage_spans(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc, text_key, start, end of passages that an earlier document has too; marks: doc, text_key, hash of anchors."""
    ends = (F.min("doc").alias("first"), F.max("doc").alias("most"))
    common = write_table(marks.groupBy("hash").agg(*ends).filter("first != most").select(F.col("hash").alias("s_hash")), "shared-anchors")
    known = marks.join(common, F.col("hash") == F.col("s_hash")).groupBy(F.col("doc").alias("k_doc"), F.col("text_key").alias("k_key")).agg(F.collect_set("hash").alias("known"))  # at most a document's own
    texts = docs.filter("text is not null").join(known, (F.col("doc") == F.col("k_doc")) & (F.col("text_key") == F.col("k_key"))).select(*ROW, "text", "known")
    found = write_table(texts.mapInArrow(_passages, PASSAGES), "passages")
    hashes = found.select("doc", F.explode("hashes").alias("hash"))
    earlier = hashes.groupBy("hash").agg(*ends).filter("first != most").select(F.col("hash").alias("e_hash"), "first")
    earlier = write_table(earlier, "shared-passages")
    rows = found.select(*ROW, F.explode(F.arrays_zip("hashes", "starts", "ends")).alias("p")).select(*ROW, F.col("p.hashes").alias("hash"), F.col("p.starts").alias("start"), F.col("p.ends").alias("end"))
    hit = rows.join(earlier, F.col("hash") == F.col("e_hash")).filter("doc > first")
    spans = hit.groupBy(*ROW).agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # at most a document's own words
    return spans.mapInArrow(_joined, "doc long, text_key long, start int, end int")


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the spans; of a wholly removed line the line end goes too."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end in merged(spans):
        if (start == 0 or text[start - 1] == "\n") and text[end : end + 1] == "\n":
            end += 1
        out.append(text[at:start])
        at = max(at, end)
    return "".join(out) + text[at:]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


LAST = (1 << 63) - 1


def doc_key(id_col: str = "doc_id"):
    """What stands for a row's document; null ids come last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))


def spans_of(docs: DataFrame, least_words: int = LEAST_WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc, text_key, spans (an array of start and end) of the texts that have something to remove."""
    docs = docs.select(doc_key().alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    schema = f"doc long, text_key long, whole struct<key:binary,end:int>, paragraphs {PARAGRAPH}, anchors {ANCHORS}"
    with scratch():
        described = write_table(docs.mapInArrow(_described(least_words, rows, bands), schema), "described")
        # whole copies go first: the document that they repeat has all of their paragraphs and passages
        texts = described.filter("whole is not null").select(*ROW, "whole.key", "whole.end")
        earlier = texts.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("most")).filter("first != most")
        copies = texts.join(earlier.select(F.col("key").alias("e_key"), "first"), F.col("key") == F.col("e_key")).filter("doc != first")
        copies = write_table(copies.select(*ROW, F.lit(0).alias("start"), "end"), "copies")
        others = described.join(copies.select(*(F.col(k).alias("c_" + k) for k in ROW)), (F.col("doc") == F.col("c_doc")) & (F.col("text_key") == F.col("c_text_key")), "left_anti")
        paragraphs = others.select(*ROW, F.explode("paragraphs").alias("p")).select(*ROW, "p.*")
        marks = others.select(*ROW, F.explode("anchors").alias("hash"))
        spans = copies.unionByName(paragraph_spans(docs, paragraphs)).unionByName(passage_spans(docs, marks))
        spans = spans.groupBy(*ROW).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        return keep(write_table(spans, "spans"))


def dedup(docs: DataFrame, spans_col: str = "spans") -> DataFrame:
    """docs with repeats cut out of the column text, and the column `spans_col` (null where there are none)."""
    found = spans_of(docs)
    names = [c for c in docs.columns if c.lower() != spans_col.lower()]
    doc, key, spans = (fresh(docs, k) for k in ("span_doc", "span_key", "found_spans"))
    found = found.select(F.col("doc").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(spans))
    joined = docs.join(found, (doc_key() == F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left")
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField(spans_col, SPANS)])
    at = names.index("text")

    def apply(batches):
        for batch in batches:
            columns = batch.columns
            pairs = [merged([(s["start"], s["end"]) for s in x or []]) for x in columns[-1].to_pylist()]
            columns[at] = pa.array([cut(t, p) for t, p in zip(columns[at].to_pylist(), pairs)], pa.string())
            columns[-1] = pa.array([[{"start": a, "end": b} for a, b in p] or None for p in pairs], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays(columns, [*names, spans_col])

    return joined.select(*names, spans).mapInArrow(apply, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(docs_of(spark, sf_dir).select("doc_id", "text"))
    removed = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).cast("long")
    return out.select("doc_id", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), removed.alias("removed_chars"), (removed > 0).alias("changed"), F.to_json("spans").alias("spans"), "text")
