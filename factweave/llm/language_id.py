"""Language identification by hierarchical discrimination.

One-versus-one linear support vector machines tell language families apart; within the predicted
family, others tell its languages apart. Texts are hashed counts of byte 2- and 3-grams, square
rooted and scaled to length 1, of the whole lower-cased text.

The machines are fitted on a bounded sample: about `per_language` labelled documents of each
language, drawn by a hash of the id, for the `most_languages` commonest labels; rarer labels, as dirty
tables have them, are not learned. Everything else reads all rows. The fitted weights are 16 KB for
each pair of families, or of languages in one family, and travel with the tasks.

Defined results: a null text, or one without a letter, gets `und` and score 0; rows without a label
are not learned from; without any label every text gets `und`; a single language needs no machine
and gets score 1; equal texts and repeated ids get equal results, as the text alone decides; a null id
is not held out; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .shared import docs_of

DIMENSIONS = 4096
PER_LANGUAGE = 600
MOST_LANGUAGES = 100
UNKNOWN = "und"
#: Language codes of each family. A code that is not listed is a family by itself.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "sinitic": ["zh"], "japonic": ["ja"], "koreanic": ["ko"], "turkic": ["tr", "az", "kk"],
    "semitic": ["ar", "he"], "indic": ["hi", "bn", "ur", "mr"], "uralic": ["fi", "hu", "et"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_letter = regex.compile(r"\p{L}").search


def has_letter(text: str | None) -> bool:
    return bool(text) and _letter(text) is not None


def features(text: str) -> np.ndarray:
    """Hashed byte n-gram counts of a whole text, square rooted, of length 1."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    two = data[:-1] * np.uint32(257) + data[1:]
    three = two[:-1] * np.uint32(263) + data[2:] + np.uint32(1 << 24)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    hashed = (np.concatenate([two, three]) * np.uint32(2654435761)) >> shift
    counts = np.sqrt(np.bincount(hashed, minlength=DIMENSIONS).astype(np.float32))
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def fit_svm(x: np.ndarray, positive: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights and bias of a linear machine: squared hinge loss by accelerated gradient steps; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = 1 / (2 * 2 + penalty)  # rows have length 2 at most with the bias
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = penalty * ahead - 2 * (x.T @ (share * y * slack))
        new = ahead - rate * gradient
        ahead, w = new + (step / (step + 3)) * (new - w), new
    return w


class Machines:
    """One-versus-one machines among classes."""

    def __init__(self, classes: list[str], x: np.ndarray, y: list[str]):
        self.classes, y = classes, np.array(y)
        self.pairs = list(itertools.combinations(range(len(classes)), 2))
        rows = [np.isin(y, [classes[a], classes[b]]) for a, b in self.pairs]
        fitted = [fit_svm(x[r], y[r] == classes[a]) for r, (a, _) in zip(rows, self.pairs)]
        self.weights = np.array(fitted, np.float32).reshape(len(self.pairs), x.shape[1] + 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the class with the most wins (then the largest margins), and a score from 0 to 1, for each row."""
        if len(self.classes) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        wins = np.zeros((len(x), len(self.classes)))
        least = np.full((len(x), len(self.classes)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k].astype(float)
            for c, v in ((a, m), (b, -m)):
                wins[:, c] += (v > 0) + np.tanh(v) * 1e-3
                least[:, c] = np.minimum(least[:, c], v)
        best = wins.argmax(1)
        return best, 1 / (1 + np.exp(-4 * least[np.arange(len(x)), best]))


class Model:
    """Machines among families, and within each family."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        family = [FAMILY_OF.get(v, "only:" + v) for v in languages]
        self.families = sorted(set(family))
        self.top = Machines(self.families, x, family)
        self.within = {}
        for name in self.families:
            own = np.array([f == name for f in family])
            mine = [v for v, o in zip(languages, own) if o]
            self.within[name] = Machines(sorted(set(mine)), x[own], mine)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.top.predict(x)
        out = [""] * len(x)
        for k in np.unique(family):
            rows = np.flatnonzero(family == k)
            machines = self.within[self.families[k]]
            best, own = machines.predict(x[rows])
            score[rows] *= own
            for row, b in zip(rows, best):
                out[row] = machines.classes[b]
        return out, score


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featurise(batches):
    for batch in batches:
        x = [features(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["lang", "x"])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """A model of the labelled rows that are not held out, from about per_language rows of each of the commonest languages."""
    labelled = df.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    counts = {r["lang"]: r["n"] for r in counts.collect()}  # a row a language
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    drawn = labelled.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    rows = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.mapInArrow(_featurise, "lang string, x binary").collect()  # about per_language rows of 8 KB a language
    if not rows:
        return None
    # the order of collected rows may differ between runs; that of the fit does not
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    return Model(x, [r["lang"] for r in rows])


def classify(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, by one product for all that have a letter."""
    known = [k for k, t in enumerate(texts) if model is not None and has_letter(t)]
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if known:
        names, score[known] = model.predict(np.stack([features(texts[k]) for k in known]))
        for k, name in zip(known, names):
            lang[k] = name
    return lang, score


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lang, score = classify(model, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    return predict(docs, fit(docs))


def accepted(docs: DataFrame, model: Model | None, wanted: list[str] | None = None, least_score: float = 0.0) -> DataFrame:
    """docs whose predicted language is among those wanted (None: any but und), with at least that score; lang becomes the prediction."""
    schema = docs.schema
    at, label = schema.names.index("text"), schema.names.index("lang") if "lang" in schema.names else None

    def apply(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lang, score = classify(model, part.column(at).to_pylist())
                right = [k != UNKNOWN and (wanted is None or k in wanted) and s >= least_score for k, s in zip(lang, score)]
                columns = part.columns
                if label is not None:
                    columns[label] = pa.array(lang, pa.string())
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(right, pa.bool_()))

    return docs.mapInArrow(apply, schema)
