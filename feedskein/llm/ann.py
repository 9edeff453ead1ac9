"""Nearest neighbours by randomly rotated one-bit codes.

A vector is scaled to length 1, rotated at random and kept as the signs of its coordinates,
packed, with one correction scalar: the inner product of the rotated vector with its code. Of
a query's inner product with the code, that scalar makes an unbiased estimate of the inner
product with the vector, with a deviation of sqrt((1 - c²) / c²) / sqrt(d - 1), and the bound
is ERROR deviations.

The search takes two passes over the codes. The first looks at codes alone and keeps for each
query the FIRST highest estimates of the whole table. These few are compared by the original
vectors, so the k-th best of them is a score that the k nearest must reach. The second pass
compares by the original vectors the rows whose upper bound reaches it: of vectors of 64 dimensions without any
structure a third of 2,000 and a sixth of 50,000, of others less.

Codes and queries are dealt into blocks, row by row, and each block of queries meets each block
of codes in a task of its own, so no task holds more than one of each. What leaves a task is a
few rows per query. All rows are indexed; the rotation follows from the seed and the dimension,
so nothing has to be fitted or shared.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedskein.session import written

ERROR = 2.5
FIRST = 16
CODES_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 4096
LEAST_BLOCKS = 16
SEED = 11
INDEX = "vec_id long, dim int, code binary, scalar double, vector binary"
ESTIMATED = "query long, row long, estimate double"
FOUND = "query long, query_id long, vec_id long, score double"


@functools.lru_cache(maxsize=8)
def rotation(dim, seed=SEED):
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors, seed=SEED):
    """(packed codes, scalars) of the rows of a matrix without zero rows."""
    dim = vectors.shape[1]
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    rotated = unit @ rotation(dim, seed)
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(axis=1) / np.sqrt(dim)


def build_index(vectors: DataFrame, id_column="vec_id", vector_column="embedding") -> DataFrame:
    """(vec_id, dim, code, scalar, vector, row) for each row, written; the vector is packed, as
    32-bit numbers where those hold it exactly. Rows without id and vectors that are
    null, empty, zero or hold null or non-finite components are left out. Repeated ids stay
    rows of their own."""
    vector = F.col(vector_column).cast("array<double>")
    given = vectors.select(F.col(id_column).cast("long").alias("_id"), vector.alias("_vector")).filter(
        F.col("_id").isNotNull() & F.col("_vector").isNotNull()
        & ~F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("_vector", lambda x: x != 0)
    )

    def run(batches):
        for batch in batches:
            sizes = batch["_vector"].value_lengths().to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                matrix = part["_vector"].flatten().to_numpy().reshape(-1, dim)
                codes, scalars = encode(matrix)
                yield pa.RecordBatch.from_arrays([
                    part["_id"], pa.array(np.full(len(matrix), dim, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(scalars), pa.array([_packed(row) for row in matrix], pa.binary()),
                ], ["vec_id", "dim", "code", "scalar", "vector"])

    return written(given.mapInArrow(run, INDEX).withColumn("row", F.monotonically_increasing_id()), "codes")


def _packed(vector):
    with np.errstate(over="ignore"):
        short = vector.astype("<f4")
    return short.tobytes() if (short == vector).all() else vector.tobytes()


def _matrix(table, dim, column="vector"):
    """The vectors, each scaled by a power of two so that its largest component is near 1: no
    product can overflow or vanish, and cosines stay the same to the last digit."""
    packed = table[column].to_pylist()
    matrix = np.empty((len(packed), dim))
    for i, p in enumerate(packed):
        matrix[i] = np.frombuffer(p, "<f4" if len(p) == 4 * dim else "<f8")
    _, exponents = np.frexp(np.abs(matrix).max(axis=1, initial=0))
    return np.ldexp(matrix, -exponents[:, None])


def _dot(a, b):
    """Inner products of rows, added up place by place: the same whichever rows stand beside."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _cosines(a, b):
    return _dot(a, b) / (np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b)))


def estimates(codes, queries, dim):
    """(begin, matrix) for some queries at a time: estimated cosines of all codes with each."""
    scalars = codes["scalar"].to_numpy()
    packed = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(scalars), -1)
    signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
    wanted = _matrix(queries, dim)
    rotated = (wanted / np.sqrt((wanted * wanted).sum(axis=1, keepdims=True)) @ rotation(dim) / np.sqrt(dim)).astype(np.float32)
    for begin in range(0, len(wanted), 64):
        yield begin, rotated[begin:begin + 64] @ signs.T / scalars


def slack(scalars, dim, error):
    """How far an estimate may be off."""
    return error * np.sqrt(np.maximum(0, 1 - scalars**2)) / scalars / np.sqrt(max(1, dim - 1)) + 1e-5


def _table(schema, columns):
    kinds = {"long": pa.int64(), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array(np.concatenate(c) if c else [], kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _estimate(first):
    def search(codes, queries):
        columns = [[] for _ in range(3)]
        if codes.num_rows and queries.num_rows:
            ids, rows = codes["vec_id"].to_numpy(), codes["row"].to_numpy()
            query_ids, numbers = queries["vec_id"].to_numpy(), queries["query"].to_numpy()
            for begin, some in estimates(codes, queries, codes["dim"][0].as_py()):
                for i, estimate in enumerate(some, begin):
                    estimate = np.where(ids == query_ids[i], -np.inf, estimate)
                    best = np.argpartition(estimate, -first)[-first:] if len(estimate) > first else np.arange(len(estimate))
                    best = best[estimate[best] > -np.inf]
                    for column, values in zip(columns, (np.full(len(best), numbers[i]), rows[best], estimate[best])):
                        column.append(values)
        return _table(ESTIMATED, columns)
    return search


def _compare(batches):
    """The scores of pairs (query, wanted, vector)."""
    for batch in batches:
        dims = batch["dim"].to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            scores = _cosines(_matrix(part, dim), _matrix(part, dim, "wanted"))
            yield pa.RecordBatch.from_arrays([part["query"], pa.array(scores)], ["query", "score"])


def chosen_codes(codes, queries, dim, error):
    """For each query the places of the codes whose upper bound reaches its least score."""
    ids, query_ids, least = codes["vec_id"].to_numpy(), queries["vec_id"].to_numpy(), queries["least"].to_numpy()
    off = slack(codes["scalar"].to_numpy(), dim, error)
    for begin, some in estimates(codes, queries, dim):
        for i, estimate in enumerate(some, begin):
            yield i, np.flatnonzero((estimate + off >= least[i]) & (ids != query_ids[i]))


def _search(k, error):
    def search(codes, queries):
        columns = [[] for _ in range(4)]
        if codes.num_rows and queries.num_rows:
            dim = codes["dim"][0].as_py()
            ids, query_ids, numbers = codes["vec_id"].to_numpy(), queries["vec_id"].to_numpy(), queries["query"].to_numpy()
            vectors, wanted = _matrix(codes, dim), _matrix(queries, dim)
            lengths, own = np.sqrt(_dot(vectors, vectors)), np.sqrt(_dot(wanted, wanted))
            for i, chosen in chosen_codes(codes, queries, dim, error):
                scores = _dot(vectors[chosen], np.broadcast_to(wanted[i], (len(chosen), dim))) / (lengths[chosen] * own[i])
                best = np.lexsort((ids[chosen], -scores))[:k]
                n = len(best)
                for column, values in zip(columns, (np.full(n, numbers[i]), np.full(n, query_ids[i]), ids[chosen[best]], scores[best])):
                    column.append(values)
        return _table(FOUND, columns)
    return search


def _dealt(frame, own, blocks, other, others, *salt):
    """Each row in one of its own blocks, and once for each of the others."""
    block = F.pmod(F.xxhash64("vec_id", F.lit(own), *salt), F.lit(blocks)).cast("int")
    return frame.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def nearest(index: DataFrame, queries: DataFrame, k=5, error=ERROR, codes_per_block=CODES_PER_BLOCK, queries_per_block=QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of index with the largest cosine for each
    row of queries, an index too, nearest first and ties to the smaller vec_id. Rows with the
    query's own id are no candidates, nor are vectors of another dimension. With fewer than k
    candidates, all are returned; an empty index finds nothing. A query id that is there
    several times is one query, if its rows are the same.
    """
    code_blocks = max(LEAST_BLOCKS, -(-index.count() // codes_per_block))
    # rows of the index may be equal, those of the queries are distinct
    asked = queries.select("vec_id", "dim", "vector").distinct().withColumn("query", F.monotonically_increasing_id())
    asked = written(asked, "queries")
    query_blocks = max(1, -(-asked.count() // queries_per_block))

    def meet(codes, asked, search, schema):
        pair = ["dim", "_codes", "_queries"]
        left = _dealt(codes, "_codes", code_blocks, "_queries", query_blocks, "row").groupBy(*pair)
        right = _dealt(asked, "_queries", query_blocks, "_codes", code_blocks).groupBy(*pair)
        return left.cogroup(right).applyInArrow(search, schema)

    first = max(FIRST, k)
    found = meet(index.select("row", "vec_id", "dim", "code", "scalar"), asked, _estimate(first), ESTIMATED)
    highest = Window.partitionBy("query").orderBy(F.col("estimate").desc(), "row")
    likely = found.withColumn("_n", F.row_number().over(highest)).filter(F.col("_n") <= first).select("query", "row")
    pairs = likely.join(index.select("row", "dim", "vector"), "row").join(asked.select("query", F.col("vector").alias("wanted")), "query")
    compared = pairs.select("query", "dim", "wanted", "vector").mapInArrow(_compare, "query long, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc())
    least = compared.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == k).select("query", F.col("score").alias("least"))
    bounded = asked.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = meet(index.select("row", "vec_id", "dim", "code", "scalar", "vector"), written(bounded, "bounded"), _search(k, error), FOUND)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
