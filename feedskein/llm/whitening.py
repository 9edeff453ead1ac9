"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found without forming it. A block of orthonormal
columns Q is multiplied by it in passes over the rows, each adding up Xᵀ(XQ) of centred rows by
partition. A Chebyshev polynomial, built by its three-term recurrence with one pass per degree,
stays small on the interval that holds the unwanted eigenvalues and grows fast above it, so
what is left in the columns after a few degrees are the wanted directions. QR makes them
orthonormal again, and Rayleigh-Ritz, the small eigenproblem of QᵀVQ, sorts them. The interval
goes up to the least Ritz value; its lower end is 0 until a Lanczos run, whose vector rides
along in the same passes, bounds the least eigenvalue. Pairs whose residual is small enough
are locked and projected out of every pass. The run ends when the residuals of all wanted pairs
certify them.

What the driver holds are sums of one row per dimension and column. Components are whole
numbers; they are centred exactly by their whole mean and then by the fraction that remains.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedskein.session import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LARGEST = 2.0**40  # scaled entries from here on are not kept as whole numbers
BINS = 16  # partial sums of partitions are added up in so many groups before the driver adds those
CERTIFIED = 1e-13  # residual of a pair, as a share of the first eigenvalue
ACCEPTED = 1e-11  # where rounding lets residuals fall no further
DEGREE, MOST_CYCLES = 10, 60
MOST_GROWTH = 1e8  # of the first active column over the last wanted one in one filter
FLAT = 1e-12  # eigenvalues below this share of the first cannot be scaled to 1
SEED = 5


def whole_vectors(vectors: DataFrame, id_column="vec_id", vector_column="embedding", scale=SCALE) -> DataFrame:
    """(vec_id, parts): the vectors that take part, as whole numbers floor(scale * c), written.
    Null and empty vectors and those with null or non-finite entries are left out, and those
    with an entry of 2**40 or more. Only vectors of the most frequent dimension, of several the
    largest, can be compared; others are left out."""
    vector = F.col(vector_column).cast("array<double>")
    given = vectors.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("_vector")).filter(
        (F.size("_vector") > 0) & ~F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST / scale)))
    sizes = given.groupBy(F.size("_vector").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    dim = sizes["dim"] if sizes else 0

    def run(batches):
        for batch in batches:
            matrix = np.floor(scale * batch["_vector"].flatten().to_numpy().reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([row.tobytes() for row in matrix], pa.binary())], ["vec_id", "parts"])

    return written(given.filter(F.size("_vector") == dim).mapInArrow(run, "vec_id long, parts binary"), "whole")


def _matrix(batch):
    return np.frombuffer(b"".join(batch["parts"].to_pylist()), float).reshape(batch.num_rows, -1)


class Centre:
    """n vectors with exact sums of their components; `whole` and `part` are their mean."""

    def __init__(self, n, sums):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], float)
        self.left = [s % n for s in sums]
        self.part = np.array([r / n for r in self.left])

    def off(self, matrix):
        return (matrix - self.whole) - self.part

    def deviations(self, matrix):
        """Σ (n·x − S)² of each row, as Python's whole numbers."""
        near = (matrix - self.whole).astype(np.int64)
        small = np.abs(near).max(initial=0) < 2**20 and self.n < 2**30
        near = near if small else near.astype(object)
        left = np.array(self.left, np.int64 if small else object)
        squares, products = (near * near).sum(axis=1), (near * left).sum(axis=1)
        constant = sum(r * r for r in self.left)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + constant for a, b in zip(squares, products)]


def centre(rows: DataFrame):
    """The Centre of all rows; None if there are none."""
    def run(batches):
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                part = [int(s) for s in _matrix(batch).astype(np.int64).sum(axis=0)]
                sums, n = part if sums is None else [a + b for a, b in zip(sums, part)], n + batch.num_rows
        if n:
            decimals = pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums)), decimals], ["place", "n", "s"])

    sums = rows.mapInArrow(run, "place int, n long, s decimal(38,0)").groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = sums.orderBy("place").collect()  # one row per dimension
    return Centre(int(found[0]["n"]), [int(r["s"]) for r in found]) if found else None


def summed(rows: DataFrame, make):
    """make(matrix) added up over all rows: an array of doubles. Every partition adds up its own."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % BINS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["bin", "total"])

    def add(table):
        total = sum(np.frombuffer(t, float).astype(np.longdouble) for t in table["total"].to_pylist())
        return pa.table({"total": pa.array([total.astype(float).tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "bin int, total binary").groupBy("bin").applyInArrow(add, "total binary").collect()
    return sum(np.frombuffer(p["total"], float).astype(np.longdouble) for p in parts).astype(float)


def covariance_times(rows: DataFrame, middle: Centre):
    """(multiply, trace): multiply(Q) is the covariance times Q, by one pass over all rows."""
    def multiply(q):
        def make(matrix):
            x = middle.off(matrix)
            return (x.T @ (x @ q)).ravel()

        return summed(rows, make).reshape(q.shape) / middle.n

    return multiply, float(summed(rows, lambda m: np.array([(middle.off(m) ** 2).sum()]))[0] / middle.n)


class _Lowest:
    """A Lanczos run, one step at a time, that bounds the least eigenvalue from below."""

    def __init__(self, dim, random, most=12):
        first = random.standard_normal(dim)
        self.vectors, self.alphas, self.betas, self.most = [first / np.linalg.norm(first)], [], [], min(most, dim)

    @property
    def vector(self):
        return self.vectors[-1] if len(self.alphas) < self.most else None

    def step(self, image):
        v = self.vectors[-1]
        self.alphas.append(float(v @ image))
        basis = np.array(self.vectors)
        left = image - basis.T @ (basis @ image)
        left -= basis.T @ (basis @ left)
        beta = float(np.linalg.norm(left))
        self.betas.append(beta)
        if beta > 1e-12 * max(1e-300, abs(self.alphas[0])):
            self.vectors.append(left / beta)
        else:
            self.most = len(self.alphas)

    def bound(self):
        if len(self.alphas) < self.most:
            return 0.0
        tri = np.diag(self.alphas) + np.diag(self.betas[:-1], 1) + np.diag(self.betas[:-1], -1)
        values, vectors = np.linalg.eigh(tri)
        return max(0.0, float(values[0] - abs(self.betas[-1] * vectors[-1, 0])))


def leading_eigenpairs(multiply, dim, wanted, seed=SEED):
    """(values, vectors, residuals) of the `wanted` largest eigenvalues, falling, each residual
    certified against the first eigenvalue. multiply(Q) gives the matrix times Q. Raises
    RuntimeError where MOST_CYCLES filters don't get there."""
    wanted = min(wanted, dim)
    size = min(dim, wanted + max(8, wanted // 2))
    random = np.random.default_rng(seed)
    lowest = _Lowest(dim, random)

    def passed(block):
        """The product, with one step of the Lanczos run in the same pass."""
        vector = lowest.vector
        if vector is None:
            return multiply(block)
        image = multiply(np.column_stack([block, vector]))
        lowest.step(image[:, -1])
        return image[:, :-1]

    q = np.linalg.qr(random.standard_normal((dim, size)))[0]
    least = np.inf
    for _ in range(MOST_CYCLES):
        image = passed(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residuals = np.linalg.norm(image - q * values, axis=0)
        first = max(values[0], 0)
        worst = residuals[:wanted].max(initial=0)
        if worst <= CERTIFIED * first or (worst <= ACCEPTED * first and worst > least / 2):
            return values[:wanted], q[:, :wanted], residuals[:wanted]
        least = min(least, worst)
        locked = 0
        while locked < wanted - 1 and residuals[locked] <= CERTIFIED * first:
            locked += 1
        q = np.column_stack([q[:, :locked], _filtered(passed, q[:, :locked], q[:, locked:], values[locked:], wanted - locked, lowest.bound())])
        q = np.linalg.qr(q)[0]
    raise RuntimeError(f"eigenpairs not certified: residual {worst:.3g} of {first:.3g}")


def _filtered(passed, locked, block, values, wanted, low):
    """A Chebyshev polynomial of the matrix times the block: at most 1 on the unwanted interval
    from `low` to the least Ritz value, scaled to 1 at the highest active Ritz value."""
    high = max(values[-1], low)
    centre_, half = (high + low) / 2, max((high - low) / 2, 1e-3 * max(high, 1e-300))
    top = (values[0] - centre_) / half
    last = max(1.0, (values[wanted - 1] - centre_) / half)
    growth = np.arccosh(max(1.0, top)) - np.arccosh(last)
    degree = int(np.clip(np.log(MOST_GROWTH) / max(growth, 1e-9), 2, DEGREE))

    def image(x):
        y = passed(x)
        y -= locked @ (locked.T @ y)
        return (y - centre_ * x) / half

    # scaled at the top, so that no degree overflows
    before, scale = block, 1 / max(top, 1.0)
    now = image(block) * scale
    for _ in range(degree - 1):
        following = 1 / (2 * max(top, 1.0) - scale)
        before, now = now, 2 * following * image(now) - scale * following * before
        scale = following
    return now / np.linalg.norm(now, axis=0)


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components=COMPONENTS, id_column="vec_id", vector_column="embedding", scale=SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): for each row that
    whole_vectors() keeps, its coordinates along the first `components` eigenvectors of the
    covariance, scaled to variance 1. `deviation` is null where it needs more than a long.
    Directions without variance, as with fewer rows than components or equal rows, have no
    component. Repeated and null ids are rows of their own; no rows give none; other columns
    are ignored."""
    rows = whole_vectors(vectors, id_column, vector_column, scale)
    middle = centre(rows)
    if not middle:
        return vectors.sparkSession.createDataFrame([], OUT)
    multiply, trace = covariance_times(rows, middle)
    if trace <= 0:
        return vectors.sparkSession.createDataFrame([], OUT)
    values, directions, _ = leading_eigenpairs(multiply, len(middle.sums), components)
    steep = values > FLAT * values[0]
    values, onto = values[steep], directions[:, steep] / np.sqrt(values[steep])
    count = len(values)

    def products(matrix):
        w = middle.off(matrix) @ onto
        return (w.T @ w).ravel()

    error = float(np.abs(summed(rows, products).reshape(count, count) / middle.n - np.eye(count)).max())
    explained = values / trace

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                matrix = _matrix(batch)
                size = len(matrix)
                deviations = [d if d < 2**63 else None for d in middle.deviations(matrix)]
                yield pa.RecordBatch.from_arrays([
                    batch["vec_id"].take(pa.array(np.repeat(np.arange(size), count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * count, middle.n)), pa.array(deviations, pa.int64()).take(pa.array(np.repeat(np.arange(size), count))),
                    pa.array((middle.off(matrix) @ onto).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * count, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)
