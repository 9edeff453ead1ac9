"""Hard negatives by angular triangle filtering.

Every row keeps its integer components, its norm and its angles to a few reference directions,
which stand at right angles to each other. For an anchor and a row the spherical law of cosines,
taken reference after reference, leaves only the angle between what the references don't see
of the two: their cosine lies within the product of those rests around the sum of the products
of the cosines. Times both norms, and rounded outwards, that bounds their integer score.
Integer scoring is for rows whose interval reaches into a wanted window: above the k-th best
score so far for positives, and for negatives between the least and the highest share of a
positive's score, the least rising to the score of the last negative that would be returned.

The references are the leading directions of a bounded sample, as many as leave the share
UNSEEN of its energy; they decide how much is scored, never what is found. Rows and anchors are
dealt into blocks, whatever their labels, and every block of anchors meets every block of rows
in a task of its own, so a frequent label is as spread as all others and no task holds more
than one block of each. What leaves a task is a few rows per anchor.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedskein.session import written

SCALE = 256
SAMPLE_BYTES, SAMPLE_ROWS = 1 << 24, 4096
UNSEEN = 0.1
MOST_REFERENCES = 256
ROWS_PER_BLOCK, ANCHORS_PER_BLOCK = 16384, 4096
LEAST_BLOCKS = 16
LONGEST = 2.0**30  # norms from here on could make scores that no long holds
NO_ID = 2**63 - 1
SLACK = 2e-5  # above what rounding can do to a cosine that is made of 32-bit numbers
FIRST = 48  # rows scored to learn how good the best are

INDEX = "_id long, label long, anchor boolean, dim int, parts binary, norm double, angles binary"
POSITIVES = "_anchor long, _id long, _row long, score long"
NEGATIVES = "_anchor long, anchor_id long, place int, positive_id long, positive_score long, _id long, _row long, score long"


def reference_directions(sample, unseen=UNSEEN, most=MOST_REFERENCES):
    """{dimension: matrix}: orthonormal rows, the leading directions of vectors of a sample."""
    found = {}
    for dim in {len(v) for v in sample}:
        vectors = np.array([v for v in sample if len(v) == dim], float)
        largest = np.abs(vectors).max(axis=1, keepdims=True)
        scaled = vectors[largest[:, 0] > 0] / largest[largest[:, 0] > 0]
        if len(scaled):
            unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            energy, directions = np.linalg.eigh(unit.T @ unit / len(unit))
            seen = np.cumsum(energy[::-1])
            found[dim] = directions[:, ::-1].T[:min(most, int(np.searchsorted(seen, 1 - unseen)) + 1)].copy()
    return found


def build_index(vectors: DataFrame, anchors, id_column="vec_id", vector_column="embedding", label_column="label",
                scale=SCALE, unseen=UNSEEN) -> DataFrame:
    """One written row for each vector that takes part, numbered by `_row`. `anchors` is the
    condition that makes a row an anchor. Rows with a null label or vector, or a null or
    non-finite component, are left out; so are empty vectors and those whose scaled norm
    reaches 2**30, whose scores may not fit a long. A row without id takes part, the last of
    a tie, but for being an anchor."""
    vector = F.col(vector_column).cast("array<double>")
    given = vectors.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(label_column).cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), vector.alias("_vector"),
    ).filter(
        F.col("label").isNotNull() & (F.size("_vector") > 0)
        & ~F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    widest = given.agg(F.max(F.size("_vector"))).first()[0] or 1
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * widest)))
    sample = given.orderBy(F.xxhash64("_vector"), "_vector").limit(rows).select("_vector").toArrow()["_vector"].to_pylist()
    references = reference_directions(sample, unseen)

    def run(batches):
        for batch in batches:
            sizes = batch["_vector"].value_lengths().to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                with np.errstate(over="ignore"):
                    whole = np.floor(scale * part["_vector"].flatten().to_numpy().reshape(-1, dim))
                    norms = np.sqrt((whole * whole).sum(axis=1))
                fit = norms < LONGEST
                part, whole, norms = part.filter(pa.array(fit)), whole[fit], norms[fit]
                unit = whole / np.maximum(norms, 1)[:, None]
                angles = np.arccos(np.clip(unit @ references.get(int(dim), np.zeros((0, dim))).T, -1, 1)).astype("<f4")
                yield pa.RecordBatch.from_arrays([
                    part["_id"], part["label"], part["anchor"], pa.array(np.full(len(whole), dim, np.int32)),
                    pa.array([w.tobytes() for w in whole.astype("<i4")], pa.binary()), pa.array(norms),
                    pa.array([a.tobytes() for a in angles], pa.binary()),
                ], ["_id", "label", "anchor", "dim", "parts", "norm", "angles"])

    return written(given.mapInArrow(run, INDEX).withColumn("_row", F.monotonically_increasing_id()), "negatives")


class _Side:
    """One block as matrices: integer components, norms, cosines to the references, and rests."""

    def __init__(self, table):
        n = table.num_rows
        self.ids, self.rows = table["_id"].to_numpy(), table["_row"].to_numpy()
        self.labels, self.norms = table["label"].to_numpy(), table["norm"].to_numpy()
        self.parts = np.frombuffer(b"".join(table["parts"].to_pylist()), "<i4").reshape(n, -1)
        angles = np.frombuffer(b"".join(table["angles"].to_pylist()), "<f4").reshape(n, -1)
        self.cosines = np.cos(angles)
        seen = (self.cosines.astype(float) ** 2).sum(axis=1)
        self.rest = np.where(self.norms > 0, np.sqrt(np.maximum(0, 1 - seen)), 0).astype(np.float32)

    def exact_in(self, other):
        """The components in the type in which BLAS adds up products with the other's exactly."""
        most = self.norms.max() * other.norms.max()
        return self.parts.astype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64)


def bounds(anchors, one, rows, chosen):
    """(lowest, highest) score of an anchor with each of the chosen rows, rounded outwards."""
    middle = rows.cosines[chosen] @ anchors.cosines[one]
    off = rows.rest[chosen] * anchors.rest[one] + np.float32(SLACK)
    length = rows.norms[chosen] * anchors.norms[one]
    return np.floor(np.maximum(middle - off, -1 - SLACK) * length) - 1, np.ceil(np.minimum(middle + off, 1 + SLACK) * length) + 1


def best_positives(anchors, rows, k, scored=None):
    """For each anchor: (its place, [(score, id, row)]) the k best other rows of its label in the block."""
    a, r = anchors.exact_in(rows), rows.exact_in(anchors)
    by_label = np.argsort(rows.labels, kind="stable")
    sorted_labels = rows.labels[by_label]
    for one in range(len(anchors.ids)):
        low, high = np.searchsorted(sorted_labels, anchors.labels[one], side="left"), np.searchsorted(sorted_labels, anchors.labels[one], side="right")
        same = by_label[low:high]
        same = same[rows.rows[same] != anchors.rows[one]]
        if not len(same):
            continue
        _, upper = bounds(anchors, one, rows, same)
        order = np.argsort(-upper, kind="stable")
        first = same[order[:k + FIRST]]
        scores = (r[first] @ a[one]).astype(np.int64)
        if len(same) > len(first):
            least = np.partition(scores, -k)[-k]
            more = order[k + FIRST:]
            more = same[more[upper[more] >= least]]
            first = np.concatenate([first, more])
            scores = np.concatenate([scores, (r[more] @ a[one]).astype(np.int64)])
        if scored is not None:
            scored.append((len(first), len(same)))
        best = np.lexsort((rows.rows[first], rows.ids[first], -scores))[:k]
        yield one, scores[best], first[best]


def best_negatives(anchors, windows, rows, k, scored=None):
    """For each anchor and each of its windows (least, highest): (anchor, window, scores, rows)
    of the k best rows of other labels in the block whose scores lie in it."""
    a, r = anchors.exact_in(rows), rows.exact_in(anchors)
    for one, wanted in enumerate(windows):
        other = np.flatnonzero(rows.labels != anchors.labels[one])
        if not len(wanted) or not len(other):
            continue
        lower, upper = bounds(anchors, one, rows, other)
        bottom, top = min(w[0] for w in wanted), max(w[1] for w in wanted)
        open_ = np.flatnonzero((upper >= bottom) & (lower <= top))
        # those that should come just below the top tell from where on others can matter
        nearness = np.abs((lower[open_] + upper[open_]) / 2 - top)
        begin = open_[np.argpartition(nearness, FIRST)[:FIRST]] if len(open_) > FIRST else open_
        scores = (r[other[begin]] @ a[one]).astype(np.int64)
        least = []
        for low, high in wanted:
            inside = scores[(scores >= low) & (scores <= high)]
            least.append(max(low, np.partition(inside, -k)[-k]) if len(inside) >= k else low)
        matter = np.zeros(len(other), bool)
        for (_, high), low in zip(wanted, least):
            matter |= (upper >= low) & (lower <= high)
        matter[begin] = False
        more = np.flatnonzero(matter)
        chosen = other[np.concatenate([begin, more])]
        scores = np.concatenate([scores, (r[other[more]] @ a[one]).astype(np.int64)])
        if scored is not None:
            scored.append((len(chosen), len(other)))
        order = np.lexsort((rows.rows[chosen], rows.ids[chosen], -scores))
        for place, (low, high) in enumerate(wanted):
            inside = order[(scores[order] >= low) & (scores[order] <= high)][:k]
            yield one, place, scores[inside], chosen[inside]


def _columns(schema, columns):
    names = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.table({name: pa.array(np.concatenate(column) if column else [], kinds[kind]) for (name, kind), column in zip(names, columns)})


def _positives_in(k):
    def search(asked, given):
        columns = [[] for _ in range(4)]
        if asked.num_rows and given.num_rows:
            anchors, rows = _Side(asked), _Side(given)
            for one, scores, found in best_positives(anchors, rows, k):
                for column, values in zip(columns, (np.full(len(found), anchors.rows[one]), rows.ids[found], rows.rows[found], scores)):
                    column.append(values)
        return _columns(POSITIVES, columns)
    return search


def _negatives_in(k, low, high):
    def search(asked, given):
        columns = [[] for _ in range(8)]
        if asked.num_rows and given.num_rows:
            anchors, rows = _Side(asked), _Side(given)
            positives = asked["positives"].to_pylist()
            # low * positive <= 100 * score <= high * positive, in whole numbers
            windows = [[(-(-low * p["score"] // 100), high * p["score"] // 100) for p in ps] for ps in positives]
            for one, place, scores, found in best_negatives(anchors, windows, rows, k):
                n, positive = len(found), positives[one][place]
                for column, values in zip(columns, (
                    np.full(n, anchors.rows[one]), np.full(n, anchors.ids[one]), np.full(n, positive["place"]), np.full(n, positive["_id"]),
                    np.full(n, positive["score"]), rows.ids[found], rows.rows[found], scores,
                )):
                    column.append(values)
        return _columns(NEGATIVES, columns)
    return search


def _meet(asked, given, search, schema, anchor_blocks, row_blocks):
    """Every block of anchors with every block of rows of their dimension."""
    def dealt(frame, own, blocks, other, others):
        block = F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")
        return frame.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    pair = ["dim", "_anchors", "_rows"]
    left = dealt(asked, "_anchors", anchor_blocks, "_rows", row_blocks).groupBy(*pair)
    right = dealt(given, "_rows", row_blocks, "_anchors", anchor_blocks).groupBy(*pair)
    return left.cogroup(right).applyInArrow(search, schema)


def mine(index: DataFrame, positives=5, negatives=3, low=50, high=95, rows_per_block=ROWS_PER_BLOCK, anchors_per_block=ANCHORS_PER_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from a built
    index: for each anchor and each of its first `positives` other rows of the same label, the
    first `negatives` rows of other labels with low * positive_score <= 100 * negative_score
    <= high * positive_score. Scores are integer inner products; higher ones come first, ties by
    the smaller id. Rows of other dimensions are not compared. Rows of one id are rows of their
    own, also as anchors. With fewer rows, all there are; no rows give none.
    """
    row_blocks = max(LEAST_BLOCKS, -(-index.count() // rows_per_block))
    asked = index.filter("anchor")
    anchor_blocks = max(1, -(-asked.count() // anchors_per_block))
    given = index.select("_row", "_id", "label", "dim", "parts", "norm", "angles")
    asked = asked.select(*given.columns)
    found = _meet(asked, given, _positives_in(positives), POSITIVES, anchor_blocks, row_blocks)
    order = Window.partitionBy("_anchor").orderBy(F.col("score").desc(), "_id", "_row")
    firsts = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    listed = firsts.groupBy("_anchor").agg(F.sort_array(F.collect_list(F.struct("place", "_id", "score"))).alias("positives"))
    # a negative positive score has an empty window
    listed = listed.withColumn("positives", F.filter("positives", lambda p: p["score"] >= 0)).filter(F.size("positives") > 0)
    with_windows = written(asked.join(listed.withColumnRenamed("_anchor", "_row"), "_row"), "windows")
    found = _meet(with_windows, given, _negatives_in(negatives, low, high), NEGATIVES, anchor_blocks, row_blocks)
    order = Window.partitionBy("_anchor", "place").orderBy(F.col("score").desc(), "_id", "_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)

    def id_of(column):
        return F.nullif(F.col(column), F.lit(NO_ID))

    return ranked.select(
        "anchor_id", id_of("positive_id").alias("positive_id"), "rank", id_of("_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
