"""A toxicity classifier with a counterfactual penalty on identity terms."""

from __future__ import annotations

import itertools
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, pieces, table

#: Terms that name a group of people; a term may stand in for any other of its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
#: Rows of each label that fit() takes at most, and the most features it keeps.
MAX_ROWS_OF_A_LABEL, MAX_FEATURES, LEAST_CHI2, PREFIXES = 2000, 8192, 12.0, (4, 5)
THRESHOLD = 0.7

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(_LETTERS).split())


def features_of(words: set[bytes]) -> set[bytes]:
    """The words, and for longer ones their first letters after a mark that no word holds."""
    return words.union(*({b" " + w[:n] for w in words if len(w) >= n} for n in PREFIXES))


@dataclass
class Model:
    """weights by feature; a text's score is the logistic of their sum over the features it has, and the bias."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -4.0

    def __post_init__(self) -> None:
        self.known = set(self.weights)

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(sorted(map(self.weights.__getitem__, self.known & features_of(words_of(text)))))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def counterfactuals(words: set[bytes]) -> list[set[bytes]]:
    """The words with each identity term they hold swapped for each other term of its line."""
    out = []
    for line in IDENTITY_TERMS:
        terms = [t.encode() for t in line]
        for t in terms:
            if t in words:
                out += [(words - {t}) | {other} for other in terms if other != t]
    return out


def fit_sets(texts: list[set[bytes]], labels: list[int], penalty: float = 5.0, ridge: float = 1e-4, steps: int = 300) -> Model:
    """Logistic regression on present features, both labels of equal weight, plus penalty times the mean squared change
    of the logit between a text and its counterfactuals. Without rows of both labels: a model that scores all alike, low."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model()
    rows = [features_of(w) for w in texts]
    of = [Counter(itertools.chain.from_iterable(r for r, l in zip(rows, labels) if l == k)) for k in (0, 1)]
    n = [float((y == k).sum()) for k in (0, 1)]
    names, chi2 = list(of[0] | of[1]), []
    a, b = (np.array([of[k][f] for f in names], float) for k in (1, 0))
    c, d = n[1] - a, n[0] - b
    chi2 = (a * d - b * c) ** 2 * sum(n) / np.maximum((a + b) * (c + d) * n[0] * n[1], 1)
    picked = [i for i in np.lexsort((names, -chi2)) if chi2[i] >= min(LEAST_CHI2, sum(n) / 4)][:MAX_FEATURES]
    at = {names[i]: k for k, i in enumerate(picked)}
    if not at:
        return Model()
    pairs = [(i, at[f]) for i, r in enumerate(rows) for f in sorted(r & at.keys())]
    swaps = []  # (counterfactual, feature, +1 gained or -1 lost)
    m = 0
    for w, r in zip(texts, rows):
        for other in counterfactuals(w):
            new = features_of(other)
            swaps += [(m, at[f], s) for gone, s in ((new - r, 1.0), (r - new, -1.0)) for f in sorted(gone) if f in at]
            m += 1
    ri, ci = np.array(pairs or [(0, 0)]).T
    si, sj, sv = (np.array(x) for x in zip(*swaps)) if swaps else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    w, bias, mean, square = np.zeros(len(at)), 0.0, np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    for step in range(1, steps + 1):
        z = bias + (np.bincount(ri, w[ci], len(y)) if pairs else 0)
        off = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.append((np.bincount(ci, off[ri], len(w)) if pairs else 0) + ridge * w, off.sum())
        if m:
            change = np.bincount(si, sv * w[sj], m)
            grad[:-1] += 2 * penalty / m * np.bincount(sj, sv * change[si], len(w))
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({f: float(w[k]) for f, k in at.items()}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS_OF_A_LABEL, penalty: float = 5.0) -> Model:
    """The model of a bounded sample: of each label, the max_rows labelled ids that come first by hash, none of which
    has crc32(id as text) mod 3 = 1. Only those ids are joined with the texts, and only texts' words reach the driver."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("label_toxic"))
    known = known.where(crc_mod("label_id", 3) != 1).groupBy("label_id").agg(F.max("label_toxic").alias("label_toxic"))
    ids = [known.where(F.col("label_toxic") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows) for k in (0, 1)]
    ids = docs.sparkSession.createDataFrame([tuple(r) for x in ids for r in x.collect()], "label_id long, label_toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.col("text").cast("string").alias("label_text"))
    small = F.translate(F.coalesce("label_text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)  # as words_of has it
    words = F.array_distinct(F.split(small, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"))
    found = texts.join(F.broadcast(ids), "label_id").select("label_id", "label_toxic", F.xxhash64("label_text").alias("h"), words.alias("words"))
    one: dict[bytes, bytes] = {}  # each word's bytes once, however many rows hold it
    rows = [(r.label_id, r.h, r.label_toxic, {one.setdefault(w, w) for w in words_of(" ".join(r.words))}) for r in found.toLocalIterator()]
    rows.sort(key=lambda r: r[:3])
    return fit_sets([r[3] for r in rows], [r[2] for r in rows], penalty)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text alone; null and empty texts get the
    score of no words. Rows that repeat are scored alike. One pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch)):
            scores = [shared.value.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_civil(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, unchanged and with all their columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in (x for batch in batches for x in pieces(batch)):
            yield b.filter(pa.array([shared.value.score(t) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
