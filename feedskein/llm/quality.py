"""Quality of documents: ordinal regression on graded ratings.

A cumulative-link model: grade y exceeds k with probability sigmoid(score - threshold k). All
grades share one score, a sum of weights of hashed text features, and differ in their ordered
thresholds alone. The expected grade and the probability of reaching a grade select documents.

Features are the distinct words of the whole text and, by bands, the shares of capitals,
digits, signs and repeated words. The model is fitted by proximal gradient on a bounded sample:
SAMPLE rated documents chosen by a hash of the id. Weights of features that tell nothing are
exactly zero (L1 by how often a feature occurs), so long texts do not add up noise.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.llm.arrays import U64, slices, text_bytes, word_names

BUCKETS = 1 << 18
SAMPLE = 10_000
LEAST_SEEN = 8  # documents of the sample that a feature must be in
BANDS = 8

_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _sums(mask, offsets):
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(texts):
    """The distinct feature numbers of each text of an Arrow column, ascending. A null or
    empty text has those of its bands alone."""
    data, offsets = text_bytes(texts)
    names, bounds = word_names(data, offsets, _SEPARATES)
    buckets = (names >> U64(40)).astype(np.int64) % (BUCKETS - 1024) + 1024
    size = np.maximum(1, np.diff(offsets))
    letters = np.maximum(1, _sums(~_SEPARATES[data] & ~_DIGIT[data], offsets))
    signs = _sums(_SEPARATES[data] & ~_SPACE[data], offsets) / size
    shares = [_sums(_UPPER[data], offsets) / letters, _sums(_DIGIT[data], offsets) / size, signs]
    words = np.diff(bounds)
    found = []
    distinct = [np.unique(buckets[b:e]) for b, e in zip(bounds[:-1], bounds[1:])]
    shares.append(1 - np.array([len(d) for d in distinct]) / np.maximum(1, words))
    bands = [np.minimum(BANDS - 1, (BANDS * np.sqrt(np.clip(s, 0, 1))).astype(int)) + i * BANDS for i, s in enumerate(shares)]
    bands.append(np.minimum(BANDS - 1, np.log2(words + 1).astype(int) // 2) + len(shares) * BANDS)
    for i, own in enumerate(distinct):
        found.append(np.concatenate([[b[i] for b in bands], own]).astype(np.int64))
    return found


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """weights by feature number; thresholds[k - 1] is what a score must exceed for grade k."""

    def __init__(self, weights, thresholds):
        self.weights, self.thresholds = weights, thresholds

    def above(self, found):
        """P(grade >= k) for k = 1, 2, ... per text."""
        score = np.array([self.weights[f].sum() for f in found])
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def train(found, grades, rounds=300, certainty=1.5, rate=0.5):
    """A model from the features and grades (0, 1, ...) of texts; None without any. A feature
    gets a weight only if the errors of its texts add up to more than chance would, by
    `certainty` standard deviations."""
    if not len(found):
        return None
    grades = np.asarray(grades, np.int64)
    top = max(1, int(grades.max()))
    flat = np.concatenate(found)
    often = np.bincount(flat, minlength=BUCKETS) >= min(LEAST_SEEN, len(found))
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    rows, flat = rows[often[flat]], flat[often[flat]]
    used, column = np.unique(flat, return_inverse=True)
    weights, squares = np.zeros(len(used)), np.full(len(used), 1e-8)
    chance = certainty * np.sqrt(np.bincount(column, minlength=len(used))) / len(found)
    reached = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(0.01, 0.99)
    thresholds = -np.log(reached / (1 - reached))
    for step in range(rounds):
        score = np.bincount(rows, weights[column], len(found))
        above = np.concatenate([np.ones((len(found), 1)), _sigmoid(score[:, None] - thresholds), np.zeros((len(found), 1))], axis=1)
        slope = above * (1 - above)
        here = np.arange(len(found))
        likely = np.maximum(above[here, grades] - above[here, grades + 1], 1e-9)
        error = (slope[here, grades + 1] - slope[here, grades]) / likely  # of -log likelihood, by score
        if not step:
            chance *= error.std()
        gradient = np.bincount(column, error[rows], len(used)) / len(found)
        squares = 0.9 * squares + 0.1 * gradient**2
        pace = rate * 0.1 / (np.sqrt(squares) + 1e-3) / (1 + step / 100)
        weights -= pace * gradient
        weights = np.sign(weights) * np.maximum(0, np.abs(weights) - pace * chance)
        for k in range(1, top + 1):
            change = np.where(grades == k, 1, 0) * slope[:, k] / likely - np.where(grades == k - 1, 1, 0) * slope[:, k] / likely
            thresholds[k - 1] -= rate * change.mean()
        thresholds = np.maximum.accumulate(thresholds + np.arange(top) * 1e-6)
    full = np.zeros(BUCKETS)
    full[used] = weights
    return Model(full, thresholds)


def fit(docs: DataFrame, ratings: DataFrame, sample=SAMPLE, id_column="doc_id", text_column="text") -> Model | None:
    """A model from ratings (doc_id, grade): about `sample` rated documents, all if there are
    fewer. A document rated more than once counts once, with its lowest grade; of several rows
    with its id the one with the smallest hash of its text; null ids, grades and texts are left
    out."""
    rated = ratings.select(F.col(id_column).alias("_id"), F.col("grade").cast("int").alias("_grade")).dropna()
    rated = rated.groupBy("_id").agg(F.min("_grade").alias("_grade"))
    space = 1 << 40
    bound = min(space, space * sample // max(1, rated.count()))
    chosen = rated.filter(F.pmod(F.xxhash64("_id"), F.lit(space)) < bound)
    given = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).filter(F.col("_text").isNotNull())

    def run(batches):
        for whole in batches:
            for begin, count in slices(whole.column("_text")):
                batch = whole.slice(begin, count)
                yield pa.RecordBatch.from_arrays(
                    [batch["_id"], batch["_grade"], pa.array(features(batch["_text"]), pa.list_(pa.int64()))], ["_id", "_grade", "found"])

    # the sample is bounded by its parameter, so it may be broadcast
    picked = given.join(F.broadcast(chosen), "_id").groupBy("_id", "_grade").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = picked.mapInArrow(run, "_id long, _grade int, found array<long>").toArrow().sort_by("_id")
    found = [np.array(f, np.int64) for f in rows["found"].to_pylist()]
    return train(found, rows["_grade"].to_numpy())


def rate(docs: DataFrame, model, good=2, text_column="text", keep=("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with expected_grade and p_good, the probability of grade
    `good` or more. Null and empty texts are rated by their bands. Without a model both are
    null."""
    given = docs.select(*keep, F.col(text_column).alias("_text"))
    schema = given.drop("_text").schema.add("expected_grade", "double").add("p_good", "double")

    def run(batches):
        for whole in batches:
            for begin, count in slices(whole.column("_text")):
                batch = whole.slice(begin, count)
                expected = good_enough = [None] * batch.num_rows
                if model:
                    above = model.above(features(batch["_text"]))
                    expected = above.sum(axis=1)
                    good_enough = above[:, min(good, above.shape[1]) - 1]
                yield pa.RecordBatch.from_arrays(
                    [*[batch[c] for c in keep], pa.array(expected, pa.float64()), pa.array(good_enough, pa.float64())],
                    [*keep, "expected_grade", "p_good"])

    return given.mapInArrow(run, schema)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels: 0 toxic, 1 of low quality, 2 good; null if the labels are."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def selected(p_good, least=0.5):
    """Whether a document is kept: good with a probability of at least `least`, or not rated."""
    return F.coalesce(p_good >= least, F.lit(True))


def keep_good(docs: DataFrame, model, good=2, text_column="text", least=0.5) -> DataFrame:
    """docs without the rows that are not selected. All columns stay."""
    if not model:
        return docs

    def run(batches):
        for whole in batches:
            for begin, count in slices(whole.column(text_column)):
                batch = whole.slice(begin, count)
                above = model.above(features(batch.column(text_column)))
                yield batch.filter(pa.array(above[:, min(good, above.shape[1]) - 1] >= least))

    return docs.mapInArrow(run, docs.schema)
