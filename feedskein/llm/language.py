"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of a window; each filter's largest response in
the window (max pooling) feeds a softmax over the languages. The network is trained with numpy
on all windows of a bounded sample of labelled texts: at most PER_LANGUAGE whole texts of each
language, chosen by a hash of id and text. The windows of a text weigh together as LOUDEST at most,
so that a few very long texts don't drown the others. It is applied to every window of a whole text; a
text's probabilities are the mean over its windows, by their bytes.

A filter's response is a sum of weights by byte and place. Applied, the weights of two
neighbouring places are looked up at once, by pairs of bytes. Training and application see no
other column than the text.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedskein.llm.arrays import slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12  # per width
PER_LANGUAGE = 500
LOUDEST = 32
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(texts):
    """(bytes [n, WINDOW] padded with 0, bytes used by window, index of the first window of
    each text and the end) of an Arrow column, in lower case. An empty text has one window."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    encoded = [t.as_buffer().to_pybytes() if t.as_buffer() is not None else b"" for t in texts]
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in encoded], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(int(first[-1]) * WINDOW, np.uint8)
    used = np.full(int(first[-1]), WINDOW, np.int64)
    for t, begin, end in zip(encoded, first[:-1], first[1:]):
        flat[begin * WINDOW:begin * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
        used[end - 1] = len(t) - (end - begin - 1) * WINDOW
    return flat.reshape(-1, WINDOW), used, first


class Network:
    """tables[width][place, byte, filter], bias [widths * FILTERS], out [features, languages]."""

    def __init__(self, languages, tables, bias, out, shift):
        self.languages, self.tables, self.bias, self.out, self.shift = languages, tables, bias, out, shift
        self.pairs = None

    def __getstate__(self):
        return {**self.__dict__, "pairs": None}

    def _by_pairs(self):
        if self.pairs is None:
            pair = {w: (t[0][:, None, :] + t[1][None, :, :]).reshape(65536, -1) for w, t in self.tables.items()}
            self.pairs = pair, {4: (self.tables[4][2][:, None, :] + self.tables[4][3][None, :, :]).reshape(65536, -1)}
        return self.pairs

    def pooled(self, data):
        heads, tails = self._by_pairs()
        pair = data[:, :-1].astype(np.int32) * 256 + data[:, 1:]
        found = [heads[2][pair].max(axis=1)]
        found.append((heads[3][pair[:, :-1]] + self.tables[3][2][data[:, 2:]]).max(axis=1))
        found.append((heads[4][pair[:, :-2]] + tails[4][pair[:, 2:]]).max(axis=1))
        return np.maximum(np.concatenate(found, axis=1) + self.bias, 0)

    def probabilities(self, data, step=512):
        parts = [softmax(self.pooled(data[i:i + step]) @ self.out + self.shift) for i in range(0, len(data), step)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def softmax(x):
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts, labels, epochs=6, batch=64, rate=0.004, seed=5):
    """A network from labelled texts; None without any. Some windows are cut short, so that
    short texts are known too."""
    languages = sorted(set(labels))
    if not languages:
        return None
    random = np.random.default_rng(seed)
    data, _, first = windows(pa.array(texts, pa.large_string()))
    counts = np.diff(first)
    wanted = np.repeat([languages.index(x) for x in labels], counts)
    weight = np.repeat(np.minimum(1, LOUDEST / counts), counts).astype(np.float32)
    short = random.random(len(data)) < 0.3
    keep = np.where(short, random.integers(12, WINDOW, len(data)), WINDOW)
    data = np.where(np.arange(WINDOW) < keep[:, None], data, 0).astype(np.uint8)
    n = FILTERS * len(WIDTHS)
    values = {w: random.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    values |= {"bias": np.zeros(n, np.float32), "shift": np.zeros(len(languages), np.float32)}
    values["out"] = random.normal(0, 0.2, (n, len(languages))).astype(np.float32)
    squares = {k: np.full_like(v, 1e-3) for k, v in values.items()}
    for _ in range(epochs):
        order = random.permutation(len(data))
        for begin in range(0, len(order), batch):
            rows = order[begin:begin + batch]
            x, pooled, places = data[rows], [], []
            for w in WIDTHS:
                response = sum(values[w][j][x[:, j:WINDOW - w + 1 + j]] for j in range(w))
                places.append(response.argmax(axis=1))
                pooled.append(np.take_along_axis(response, places[-1][:, None, :], 1)[:, 0])
            before = np.concatenate(pooled, axis=1) + values["bias"]
            active = np.maximum(before, 0)
            error = softmax(active @ values["out"] + values["shift"])
            error[np.arange(len(rows)), wanted[rows]] -= 1
            error *= weight[rows][:, None] / len(rows)
            back = (error @ values["out"].T) * (before > 0)
            steps = {"out": active.T @ error, "shift": error.sum(0), "bias": back.sum(0)}
            for i, w in enumerate(WIDTHS):
                step = np.zeros_like(values[w])
                part = back[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(w):
                    seen = np.take_along_axis(x, places[i] + j, 1)
                    np.add.at(step[j], (seen, np.arange(FILTERS)[None, :]), part)
                steps[w] = step
            for k, step in steps.items():
                squares[k] = 0.98 * squares[k] + 0.02 * step * step
                values[k] -= rate * step / np.sqrt(squares[k] + 1e-7)
    return Network(languages, {w: values[w] for w in WIDTHS}, values["bias"], values["out"], values["shift"])


def sample(docs: DataFrame, label_column="lang", id_column="doc_id", text_column="text", per_language=PER_LANGUAGE):
    """[(text, label)]: whole texts of at most per_language rows of each label, of which those with
    letters stay; null labels and texts are left out, and equal rows count once. Which rows follows
    from a hash of id and text. About twice as many rows are marked by hash, and of them the
    first taken."""
    spark = docs.sparkSession
    labelled = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), F.col(label_column).alias("_label"))
    labelled = labelled.filter(F.col("_label").isNotNull() & F.col("_text").isNotNull()).withColumn("_hash", F.xxhash64("_id", "_text"))
    counts = {r["_label"]: r["n"] for r in labelled.groupBy("_label").agg(F.approx_count_distinct("_hash").alias("n")).collect()}  # a row per language
    if not counts:
        return []
    space = 1 << 40
    bounds = [(label, min(space, space * 2 * per_language // n)) for label, n in sorted(counts.items())]
    bounds = F.broadcast(spark.createDataFrame(bounds, "_label string, _bound long"))
    marked = labelled.join(bounds, "_label").filter(F.pmod("_hash", F.lit(space)) < F.col("_bound"))
    marked = marked.groupBy("_label", "_hash").agg(F.any_value("_id").alias("_id"), F.any_value("_text").alias("_text"))
    first = Window.partitionBy("_label").orderBy(F.pmod("_hash", F.lit(space)), "_hash")
    chosen = marked.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= per_language)
    rows = chosen.select("_id", "_label", "_text").collect()
    rows = sorted((r["_id"] is None, r["_id"] or 0, r["_text"], r["_label"]) for r in rows)
    return [(text, label) for _, _, text, label in rows if _LETTER.search(text)]


def fit(docs: DataFrame, **columns):
    """The network for the labelled rows of docs; see sample."""
    rows = sample(docs, **columns)
    return train([t for t, _ in rows], [label for _, label in rows])


def identify(docs: DataFrame, network, text_column="text", keep=("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score, the mean probability of that
    language over all windows. A text that is null or has no letter, and every text if the
    network is None, is `und` with score 0. Ties go to the first language by name."""
    given = docs.select(*keep, F.col(text_column).alias("_text"))
    schema = given.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for whole in batches:
            for begin, count in slices(whole.column("_text")):
                batch = whole.slice(begin, count)
                texts = batch["_text"]
                lettered = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
                found, scores = [UNKNOWN] * len(lettered), [0.0] * len(lettered)
                if network and any(lettered):
                    data, used, first = windows(texts)
                    sums = np.add.reduceat(network.probabilities(data) * used[:, None], first[:-1], axis=0)
                    sums /= np.maximum(1, np.add.reduceat(used, first[:-1]))[:, None]
                    for i in np.flatnonzero(lettered):
                        best = int(sums[i].argmax())
                        found[i], scores[i] = network.languages[best], min(1.0, float(sums[i, best]))
                kept = [batch[c] for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return given.mapInArrow(run, schema)
