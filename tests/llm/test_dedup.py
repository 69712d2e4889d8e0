"""Dedup operators against brute force on small tables, with nulls, ties, copies and empty tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import components, exact_dedup, ngram_join, projection_forest, substring_dedup

rng = random.Random(11)
VOCABULARY = ["w%d" % k for k in range(4000)]


def words(n):
    return rng.choices(VOCABULARY, k=n)


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, bands string, cls int")


def closure(ids, pairs):
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(spark, digest_bytes):
    texts = ["Same", "same", "SAME", None, "", "É", "é", "long " * 5000, "LONG " * 5000] + [f"t{k % 150}" for k in range(400)]
    got = {r.doc_id: r for r in exact_dedup.dedup(frame(spark, texts), digest_bytes=digest_bytes).collect()}
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault((t or "").encode().lower(), []).append(k)
    for norm, ids in groups.items():
        for k in ids:
            assert (got[k].keep_id, got[k].group_size, got[k].kept, got[k].text_sha256) == (max(ids), len(ids), k == max(ids), hashlib.sha256(norm).hexdigest())
    assert exact_dedup.dedup(frame(spark, ["x"]).limit(0)).count() == 0


def test_exact_state_carries_on(spark, tmp_path):
    rows = exact_dedup.digest_rows(frame(spark, ["a", "b", "a"]))
    for part, ids in (("one", "doc_id < 2"), ("two", "doc_id >= 2")):
        rows.filter(ids).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in").select("digest", "doc_id", "locator", "n_bytes")
        exact_dedup.run_state(spark, stream, f"file://{tmp_path}/registry", f"file://{tmp_path}/checkpoint")
    assert sorted((r.stays_id, r.n) for r in exact_dedup.current(spark, f"file://{tmp_path}/registry").collect()) == [(1, 1), (2, 2)]


def test_components(spark):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    pairs = [(a, b) for a, b in edges if a is not None and a != b]
    wanted = closure({x for p in pairs for x in p}, pairs)
    assert got == wanted
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [768, 3])
def test_ngram_join(spark, block):
    texts = []
    for _ in range(25):
        base = words(rng.randrange(3, 260))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(12)):
            near = list(base)
            for _ in range(rng.randrange(1, 6)):
                near[rng.randrange(len(near))] = rng.choice(VOCABULARY)
            texts.append(rng.choice([" ", ", ", " \n"]).join(near).upper())
    texts += [texts[0], texts[0] + ".", None, "", "...", None, "one", "ONE"]
    got = {r.doc_id: r for r in ngram_join.join_texts(frame(spark, texts), block=block).collect()}
    assert len(got) == len(texts)
    sets = {}
    for k, t in enumerate(texts):
        w = ngram_join.normalised(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    wanted = closure(sets, pairs)
    for k in sets:
        assert (got[k].class_id, got[k].n_links) == (wanted[k], sum(k in p for p in pairs))
    assert ngram_join.join_texts(frame(spark, ["x"]).limit(0)).count() == 0


def test_ngram_join_null_and_repeated_ids(spark):
    base = words(100)
    near = base[:50] + ["new"] + base[51:]
    a, b, c = " ".join(base), " ".join(near), " ".join(words(50))
    rows = [(None, a), (1, a), (2, a), (3, b), (3, c), (3, b), (None, c + " more"), (None, None), (None, c + " MORE")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, cls int, key string")
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in ngram_join.join_texts(df).collect()), key=str)
    wanted = [(None, 1, 4, False), (1, 1, 4, True), (2, 1, 4, False), (3, 1, 4, False), (3, 3, 0, True), (3, 1, 4, False), (None, None, 1, True), (None, None, 0, True), (None, None, 1, True)]
    assert got == sorted(wanted, key=str)


def test_hot_group_by_buckets(spark):
    """One large group of near copies, far over a block: the same links as brute force."""
    base = words(120)
    texts = []
    for k in range(150):
        near = list(base)
        for _ in range(rng.randrange(1, 5)):
            near[rng.randrange(len(near))] = rng.choice(VOCABULARY)
        texts.append(" ".join(near))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    links = [sum(5 * len(x & y) >= 4 * len(x | y) for j, y in enumerate(sets) if i != j) for i, x in enumerate(sets)]
    got = {r.doc_id: r.n_links for r in ngram_join.join_texts(frame(spark, texts), block=16).collect()}
    assert [got[k] for k in range(150)] == links


def test_ngram_join_has_a_row_for_each_document(spark):
    texts = ["\u2764\ufe0f", "\U0001f468\u200d\U0001f469", "\u0301", "\u00bd", "\u00b2", "\u2461", "\u00bd", "plain", None, "", "..."]
    got = [(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join.join_texts(frame(spark, texts)).collect()]
    copies = {3: (3, 1, 2), 6: (3, 1, 2)}
    assert sorted(got) == [(k, *copies.get(k, (k, 0, 1))) for k in range(len(texts))]


def test_blocks_of_a_large_unit(spark):
    sets = [np.arange(100 + k % 3, dtype=np.uint64) for k in range(50)] + [np.arange(900, 1000, dtype=np.uint64)]
    rows = spark.createDataFrame([(k, (1, 5), [4, 5] if k < 10 else [5], 1, bytearray(s.tobytes())) for k, s in enumerate(sets)], "cls long, unit struct<kind:int,code:long>, codes array<bigint>, copies long, grams binary")
    links = {r.cls: r.links for r in ngram_join.verify(rows, block=8).groupBy("cls").agg(F.sum("links").alias("links")).collect()}
    assert links == {k: 40 if k < 10 else 49 for k in range(50)}  # the first ten have met in unit 4


def test_substring_dedup(spark):
    passage, other = words(70), words(60)
    near = list(other)
    near[30] = "changed"
    texts = [
        " ".join(words(80)) + "\n" + " ".join(passage) + "\n" + " ".join(words(30)),
        " ".join(words(50) + passage + words(50)),  # inside a paragraph
        " ".join(words(90)) + "\n" + " ".join(other),
        " ".join(near) + "\n" + " ".join(words(45)),
        " ".join(words(200)), None, "", "short line\nshort line", "short line", " ".join(["again"] * 300), " ".join(["again"] * 300),
    ]
    got = {r.doc_id: r for r in substring_dedup.dedup(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert got[0].text == texts[0] and got[2].text == texts[2] and got[4].text == texts[4] and got[5].text is None and got[6].text == ""
    assert " ".join(passage[15:-15]) not in got[1].text and texts[1][:200] == got[1].text[:200]
    assert got[3].text == texts[3].split("\n")[1]
    assert got[7].text == texts[7] and got[8].text == texts[8]
    assert substring_dedup.dedup(frame(spark, ["x"]).limit(0)).count() == 0


def removed(spark, texts):
    """Words that each text loses."""
    out = {}
    for row in substring_dedup.dedup(frame(spark, texts)).collect():
        out[row.doc_id] = [texts[row.doc_id][s.start : s.end] for s in row.spans or []]
    return out


def test_passage_of_scattered_holders(spark):
    texts, wanted = [], {}
    for size in (51, 55, 60):
        for _ in range(8):
            passage = words(size)
            middle = size // 2
            texts.append(" ".join(words(30) + passage[:middle] + ["inserted"] + passage[middle:] + words(30)))
            texts.append(" ".join(words(30) + passage[:middle] + words(30)))
            texts.append(" ".join(words(30) + passage[middle:] + words(30)))
            texts += [" ".join(words(30) + passage + words(30)) for _ in range(2)]
            wanted[len(texts) - 1] = [" ".join(passage)]
    got = removed(spark, texts)
    assert got == {k: wanted.get(k, []) for k in range(len(texts))}


def test_passage_of_few_distinct_words(spark):
    texts, wanted = [], {}
    for k in range(10):
        few = ["few%d" % n for n in rng.sample(range(1000 * k, 1000 * k + 900), 7)]
        passage = rng.choices(few, k=60)
        texts += [" ".join(words(30) + passage + words(30)) for _ in range(2)]
        wanted[len(texts) - 1] = [" ".join(passage)]
    assert removed(spark, texts) == {k: wanted.get(k, []) for k in range(len(texts))}


def test_passage_is_cut_at_its_own_ends(spark):
    texts, wanted = [], {}
    for size in (50, 51, 52, 66, 90):
        for _ in range(5):
            passage = words(size)
            texts += [" ".join(words(40) + passage + words(40)) for _ in range(2)]
            wanted[len(texts) - 1] = [" ".join(passage)] if size > 50 else []
    for _ in range(10):  # words of one's own between two short shared runs
        one, two = words(22), words(22)
        texts += [" ".join(words(20) + one + words(10) + two + words(20)) for _ in range(2)]
    assert removed(spark, texts) == {k: wanted.get(k, []) for k in range(len(texts))}


def links_of(x, threshold=0.95):
    """Pairs of rows of one length at the threshold or more."""
    unit = [np.array(v) / np.linalg.norm(v) for v in x]
    return [(a, b) for a, b in itertools.combinations(range(len(x)), 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]


def test_forest_equals_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((900, 16))
    x = [*x, *(x[:80] + 0.05 * r.standard_normal((80, 16))), *x[:5], *(x[:5] * 3)]
    y = r.standard_normal((60, 3))  # another length
    x += [*y, *y[:4], *(y[4:8] * 2)]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [], [0.0], [float("inf")] * 16]
    rows += [(10_000 + k, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("size", F.lit("x")).withColumn("key", F.lit(2))
    got = {row.vec_id: row for row in projection_forest.near_duplicates(df, leaf=32).collect()}
    assert len(got) == len(rows)
    pairs = links_of(x)
    links = np.bincount(np.array(pairs).ravel(), minlength=len(x))
    mine = np.array([got[k].n_links for k in range(len(x))])
    assert (mine <= links).all() and mine.sum() >= 0.99 * links.sum()
    wanted = closure(range(len(x)), pairs)
    assert np.mean([got[k].component_id == wanted[k] for k in range(len(x))]) >= 0.99
    if (mine == links).all():
        assert all(got[k].component_id == wanted[k] for k in range(len(x)))
    assert all(got[k].kept == (got[k].component_id == k) for k in range(len(x)))
    assert all((got[10_000 + k].n_links, got[10_000 + k].component_id) == (0, 10_000 + k) for k in range(len(odd)))
    assert projection_forest.near_duplicates(df.limit(0)).count() == 0


def test_forest_null_and_repeated_ids(spark):
    one, two, far = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, one), (2, one), (None, one), (3, two), (None, far), (None, far), (4, [1.0, 1.0]), (5, [1.0, 1.0]), (6, far[:2]), (7, one), (7, [0.0, 0.0, 5.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in projection_forest.near_duplicates(df).collect()), key=str)
    wanted = [(1, 4, 1, True), (2, 4, 1, False), (None, 4, 1, False), (3, 4, 1, False), (None, 1, None, True), (None, 1, None, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 4, 1, False), (7, 0, 7, True), (None, 0, None, True)]
    assert got == sorted(wanted, key=str)


def leaves_of(x, trees=projection_forest.TREES, leaf=projection_forest.LEAF, levels=projection_forest.LEVELS, seed=1):
    """The forest's own rounds in one process: for each tree a list of leaves."""
    r = np.random.default_rng(seed)
    depth = 40
    p = (x @ projection_forest.directions(x.shape[1], trees, depth)).astype("<f4").reshape(len(x), trees, depth)
    for tree in range(trees):
        todo, out = [(1, np.arange(len(x)), False)], []
        while todo:
            path, at, tight = todo.pop()
            if tight or len(at) <= (leaf if path == 1 else 2 * leaf):
                out.append(at)
                continue
            some = p[r.permutation(at)[: projection_forest.SAMPLE], tree]
            bounds = projection_forest.fit_node(some, len(at), path.bit_length() - 1, leaf, levels)
            rows, to, tight = projection_forest.route(p[at, tree], np.full(len(at), path), bounds[None], np.zeros(len(at), int))
            for node in np.unique(to):
                todo.append((int(node), at[rows[to == node]], bool(tight[to == node][0])))
        yield out


@pytest.mark.parametrize("size, beside, dim", [(2000, 0, 32), (2000, 4000, 32), (20000, 0, 32), (4000, 100_000, 64)])
def test_forest_parts_no_tight_group(size, beside, dim):
    """True links of a group of distinct near vectors that share a leaf; the last case takes three rounds."""
    r = np.random.default_rng(5)
    centre = r.standard_normal(dim)
    centre /= np.linalg.norm(centre)
    x = np.vstack([centre + 0.2 / np.sqrt(dim) * r.standard_normal((size, dim)), r.standard_normal((beside, dim))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    if beside > 50_000:  # pairs beside the group
        x[-size:] = x[size : 2 * size] + 0.29 / np.sqrt(dim) * r.standard_normal((size, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = r.integers(0, size, (2, 4000))
    if beside > 50_000:
        a, b = np.r_[a, np.arange(size, 2 * size)], np.r_[b, np.arange(len(x) - size, len(x))]
    near = (a != b) & ((x[a] * x[b]).sum(1) >= 0.95)
    a, b = a[near], b[near]
    met = np.zeros(len(a), bool)
    for leaves in leaves_of(x):
        for at in leaves:
            inside = np.zeros(len(x), bool)
            inside[at] = True
            met |= inside[a] & inside[b]
    assert len(a) > 1000 and met.mean() >= 0.99


def test_forest_links_a_tight_group(spark):
    r = np.random.default_rng(6)
    x = np.r_[np.ones(16), np.zeros(16)] / 4 + 0.2 / np.sqrt(32) * r.standard_normal((1500, 32))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {row.vec_id: row.n_links for row in projection_forest.near_duplicates(df, leaf=64).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    mine = np.array([got[k] for k in range(len(x))])
    assert (mine <= links).all() and mine.sum() >= 0.98 * links.sum() > 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = words(120)
    texts = [" ".join(base), " ".join(base), " ".join(base[:60] + ["new"] + base[61:]), None, "123", " ".join(words(100)), " ".join(words(30)) + "\n" + " ".join(words(80))]
    clashing = ["spans", "kept_doc_id", "span_doc", "found_spans", "cut_spans", "cls", "key", "id", "unit", "digest", "t_id", "bands"]
    rows = [(k, t, "en" if k != 5 else None, "s", len(t or ""), *range(len(clashing))) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} long" for c in clashing))
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert kept == [[0, 1, 2, 5, 6], [1, 2, 5, 6], [1, 5, 6], [1, 5, 6]]
    assert {(r.spans, r.bands, r.lang) for r in docs.collect()} == {(0, 11, "en")}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {1, 5, 6}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_language_stage_removes_by_language(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    german, english = ["der", "die", "und", "nicht", "zwischen", "schon", "über"], ["the", "and", "which", "through", "would", "there", "thing"]
    rows = [(k, " ".join(rng.choices(german if k % 2 else english, k=40)), None if k % 10 > 7 else "de" if k % 2 else "en", "s", 0) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ["en"])
    got = corpus_pipeline.language(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 200, 2)) and {r.lang for r in got} == {"en"}
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", None)
    assert corpus_pipeline.language(spark, docs, str(tmp_path)).count() == 200


def test_language_stage_decides_what_packing_mixes(spark, tmp_path):
    import corpus_pipeline

    german, english = ["der", "die", "und", "nicht", "zwischen", "schon", "über"], ["the", "and", "which", "through", "would", "there", "thing"]
    right = {k: "de" if k % 4 == 0 else "en" for k in range(160)}
    labels = {k: ("en" if v == "de" else "de") if k % 32 == 0 or k % 41 == 1 else None if k % 32 == 3 else v for k, v in right.items()}
    rows = [(k, " ".join(rng.choices(german if v == "de" else english, k=2000)), labels[k], None if k % 5 else "s", 0) for k, v in right.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()} == right
    pieces = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    queues, most = {}, max(r.doc_tokens for r in pieces)
    for r in pieces:
        per = queues.setdefault((right[r.doc_id], r.doc_id % 5 == 0), {})
        window = r.sequence_id // 64
        per[window] = per.get(window, 0) + r.length
    total = sum(sum(q.values()) for q in queues.values())
    assert len(queues) == 4 and total > 2 * 64 * 2048
    for per in queues.values():
        share = sum(per.values()) / total * 64 * 2048
        # a window sends whole documents, and the windows before and after it shift by the same
        assert all(abs(per.get(k, 0) - share) <= 5 * most // 2 for k in range(total // (64 * 2048)))


def test_repeated_and_null_ids(spark):
    passage, one, two = words(60), words(70), words(80)
    texts = [(1, " ".join(one) + "\n" + " ".join(passage)), (2, " ".join(words(20) + passage + words(10))), (2, " ".join(two)), (None, " ".join(two)), (None, None), (None, " ".join(two))]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in texts], "doc_id long, text string, text_key string, doc long")
    got = {(r.doc_id, i) for i, r in enumerate(sorted(substring_dedup.dedup(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")))}
    assert len(got) == 6
    rows = substring_dedup.dedup(df).collect()
    left = {(r.doc_id, r.text) for r in rows}
    assert (1, texts[0][1]) in left and (2, texts[2][1]) in left and (None, "") in left and (None, None) in left
    assert any(r.doc_id == 2 and r.text == texts[1][1].replace(" ".join(passage), "") for r in rows)
    exact = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup(df).collect()}
    assert exact == {(1, 1, 1), (2, 2, 1), (2, 2, 3), (None, 2, 3), (None, None, 1)}


def all_repeats(texts):
    """Brute force: spans of lines that are near copies of an earlier document's, and of 51 words that an earlier document has."""
    lines, grams = [], {}
    for doc, text in enumerate(texts):
        at = 0
        for number, line in enumerate((text or "").split("\n")):
            w = ngram_join.normalised(line)
            if len(w) >= substring_dedup.LEAST_WORDS:
                lines.append((doc, number, at, at + len(line), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}))
            at += len(line) + 1
    pairs = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 5 * len(lines[a][4] & lines[b][4]) >= 4 * len(lines[a][4] | lines[b][4])]
    group = closure(range(len(lines)), pairs)
    members = {}
    for k, root in group.items():
        members.setdefault(root, []).append(k)
    out = {doc: [] for doc in range(len(texts))}
    for ks in members.values():
        if len({lines[k][0] for k in ks}) > 1:
            for k in sorted(ks)[1:]:
                out[lines[k][0]].append(lines[k][2:4])
    for doc, text in enumerate(texts):
        found = list(re.finditer(r"\w+", text or ""))
        w, start, end = [m.group().lower() for m in found], [m.start() for m in found], [m.end() for m in found]
        for i in range(len(w) - 50):
            if grams.setdefault(tuple(w[i : i + 51]), doc) < doc:
                out[doc].append((int(start[i]), int(end[i + 50])))
    return {doc: substring_dedup.merged(spans) for doc, spans in out.items()}


def test_hashed_words_are_the_words():
    texts = ["The the THE", "a_b-c\u00e9 \u00c9", "\u0130stanbul x", "\u65e5\u672c \u00bd\u00b2 \U0001f600", " ", "", None, "x" * 5000 + " y", "\u03a3\u03a3 \u03c3\u03c2", " ".join(words(500))]
    seen = {}
    for text in texts:
        hashes, start, end = ngram_join.hashed_words(text)
        found = list(re.finditer(r"\w+", text or ""))
        assert [(m.start(), m.end()) for m in found] == list(zip(start.tolist(), end.tolist()))
        if text is None or len(text.lower()) == len(text):
            for word, h in zip(ngram_join.normalised(text), hashes.tolist()):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_substring_dedup_equals_brute_force(spark):
    pool = [words(n) for n in (60, 52, 75, 120, 45, 45, 90)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            kind, base = rng.random(), list(rng.choice(pool))
            if kind < 0.3:
                base = words(rng.randrange(5, 90))
            elif kind < 0.5:
                base = words(rng.randrange(5, 40)) + base + words(rng.randrange(5, 40))
            elif kind < 0.7:
                base[rng.randrange(len(base))] = rng.choice(VOCABULARY)
            lines.append(" ".join(base))
        texts.append("\n".join(lines))
    texts += [None, ""]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans or []] for r in substring_dedup.dedup(frame(spark, texts)).collect()}
    assert got == all_repeats(texts)
