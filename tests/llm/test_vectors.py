"""Hard negatives and whitening against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedskein.llm import negatives, whitening

ROWS = "vec_id long, embedding array<double>, label int, parts string, _row int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "p", 1, 2) for i, v, label in rows], ROWS)


def clustered(n, dim, seed, spread=0.4, clusters=12):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, dim))
    which = r.integers(0, clusters, n)
    v = centres[which] + spread * r.standard_normal((n, dim)) / np.sqrt(dim) * np.sqrt(dim)
    return [(i, row.tolist(), int(label)) for i, (row, label) in enumerate(zip(v, r.integers(0, 5, n)))]


def brute(rows, is_anchor, k=5, few=3):
    """Row by row, in Python's whole numbers."""
    kept = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows
            if v and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (anchor, vector, label) in enumerate(kept):
        if anchor is None or not is_anchor(anchor):
            continue
        scored = [(-sum(a * b for a, b in zip(vector, other)), i is None, i or 0, i, their == label)
                  for place, (i, other, their) in enumerate(kept) if place != at and len(other) == len(vector)]
        for positive in sorted(s for s in scored if s[4])[:k]:
            inside = sorted(s for s in scored if not s[4] and -50 * positive[0] <= -100 * s[0] <= -95 * positive[0])
            out += [(anchor, positive[3], rank, s[3], -positive[0], -s[0]) for rank, s in enumerate(inside[:few], 1)]
    return out


def mined(spark, rows, **options):
    index = negatives.build_index(frame(spark, rows), F.col("vec_id") % 10 == 0)
    return [tuple(r) for r in negatives.mine(index, **options).collect()]


def in_order(found):
    return sorted(found, key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"rows_per_block": 10, "anchors_per_block": 7}), (3, {"rows_per_block": 400})])
def test_negatives_are_those_of_brute_force(spark, seed, options):
    rows = clustered(300, 12, seed)
    found = mined(spark, rows, **options)
    assert in_order(found) == in_order(brute(rows, lambda i: i % 10 == 0)) and found


def test_negatives_with_ties_nulls_and_odd_rows(spark):
    near, far = [1.0, 0.5, 0.0], [0.7, 0.3, 0.1]
    rows = [(i, near, 1) for i in range(12)] + [(i, far, i % 3) for i in range(20, 60)]
    rows += [(70, None, 1), (71, [], 1), (72, near, None), (73, [1.0, None, 0.0], 1), (74, [float("nan"), 0.0, 1.0], 2), (75, [float("inf"), 0.0, 1.0], 2)]
    rows += [(None, near, 1), (None, far, 2), (20, far, 2), (20, far, 2), (80, [0.0, 0.0, 0.0], 1), (90, [0.3, 0.2], 1), (91, [0.3, 0.1], 1), (92, [0.2, 0.2], 2)]
    assert in_order(mined(spark, rows)) == in_order(brute(rows, lambda i: i % 10 == 0))
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(0, [1e300, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.6, 0.6], 2)]) == []


def test_components_beyond_what_floats_hold(spark):
    rows = [(i, [1e5 + i, 3e5 - 7 * i, 0.25 * i], i % 2) for i in range(40)]
    rows += [(40 + i, [6e4 + i, 2e5, 1.0], i % 2) for i in range(40)]
    assert in_order(mined(spark, rows)) == in_order(brute(rows, lambda i: i % 10 == 0))


def sides(rows, references):
    import pyarrow as pa

    whole = np.floor(256 * np.array([v for _, v, _ in rows]))
    norms = np.sqrt((whole * whole).sum(axis=1))
    angles = np.arccos(np.clip(whole / norms[:, None] @ references.T, -1, 1)).astype("<f4")
    return negatives._Side(pa.table({
        "_id": [i for i, _, _ in rows], "_row": [i for i, _, _ in rows], "label": [label for _, _, label in rows], "norm": norms,
        "parts": [w.tobytes() for w in whole.astype("<i4")], "angles": [a.tobytes() for a in angles],
    }))


def test_bounds_hold_every_score():
    rows = clustered(400, 24, 4)
    for unseen in (0.6, 0.1, 0.0):
        side = sides(rows, negatives.reference_directions([v for _, v, _ in rows], unseen)[24])
        for one in range(0, 400, 40):
            low, high = negatives.bounds(side, one, side, np.arange(400))
            scores = side.parts.astype(int) @ side.parts[one].astype(int)
            assert (low <= scores).all() and (scores <= high).all()


def test_angles_spare_most_scoring():
    """Of vectors in clusters, as embeddings are, few are scored."""
    rows = clustered(4000, 64, 5, spread=0.2, clusters=20)
    side = sides(rows, negatives.reference_directions([v for _, v, _ in rows])[64])
    asked = sides(rows[:100], negatives.reference_directions([v for _, v, _ in rows])[64])
    scored = []
    positives = {one: scores for one, scores, _ in negatives.best_positives(asked, side, 5, scored)}
    assert sum(n for n, _ in scored) < 0.35 * sum(m for _, m in scored)
    scored.clear()
    windows = [[(-(-50 * int(s) // 100), 95 * int(s) // 100) for s in positives[one]] for one in range(100)]
    list(negatives.best_negatives(asked, windows, side, 3, scored))
    assert sum(n for n, _ in scored) < 0.35 * sum(m for _, m in scored)


# whitening


def whitened(spark, rows, **options):
    found = whitening.whiten(frame(spark, rows).repartition(3), **options).collect()
    return {(r["vec_id"], r["component"]): r for r in found}


def expected(vectors, k):
    whole = np.floor(64 * np.array(vectors))
    off = whole - whole.mean(axis=0)
    values, directions = np.linalg.eigh(off.T @ off / len(off))
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    return off @ directions / np.sqrt(values), values / (off * off).sum() * len(off)


@pytest.mark.parametrize("dim,n,k", [(6, 40, 32), (60, 400, 20)])
def test_whitening_is_that_of_the_eigenvectors(spark, dim, n, k):
    r = np.random.default_rng(dim)
    vectors = (r.standard_normal((n, dim)) * np.linspace(5, 1, dim) + 100).tolist()
    found = whitened(spark, [(i, v, 0) for i, v in enumerate(vectors)], components=k)
    k = min(k, dim)
    wanted, explained = expected(vectors, k)
    got = np.array([[found[i, c + 1]["whitened"] for c in range(k)] for i in range(n)])
    assert np.abs(np.abs(got) - np.abs(wanted)).max() < 1e-7
    assert np.abs((got * wanted).sum(axis=0) / n).min() > 1 - 1e-9
    assert np.allclose([found[0, c + 1]["explained"] for c in range(k)], explained, rtol=1e-10)
    whole = np.floor(64 * np.array(vectors)).astype(int) + whitening.SHIFT
    deviations = [sum(int(x) ** 2 for x in n * row - whole.sum(axis=0)) for row in whole]
    assert [found[i, 1]["deviation"] for i in range(n)] == deviations
    assert {row["n"] for row in found.values()} == {n} and max(row["identity_error"] for row in found.values()) < 1e-10


def test_whitening_with_odd_rows(spark):
    good = [(i, [float(i), float(i * i % 7), 1.0], None) for i in range(9)]
    odd = [(None, [3.0, 2.0, 1.0], 1), (3, [3.0, 2.0, 1.0], 1), (20, None, 1), (21, [], 1), (22, [1.0], 1), (23, [1.0, None, 2.0], 1),
           (24, [float("nan"), 1.0, 1.0], 1), (25, [1e300, 1.0, 1.0], 1)]
    found = whitening.whiten(frame(spark, good + odd)).collect()
    assert {r["component"] for r in found} == {1, 2} and {r["n"] for r in found} == {11}
    assert sorted(str(r["vec_id"]) for r in found if r["component"] == 1) == sorted(["None", "3", *map(str, range(9))])
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1)] * 5)).collect() == []


def test_deviations_of_any_size():
    middle = whitening.Centre(10**12, [3 * 10**12 + 5, -7])
    matrix = np.array([[2.0**39, -(2.0**30)], [4.0, 0.0]])
    wanted = [sum((10**12 * int(x) - s) ** 2 for x, s in zip(row, middle.sums)) for row in matrix]
    assert middle.deviations(matrix) == wanted


def test_pairs_of_close_and_of_far_eigenvalues():
    r = np.random.default_rng(2)
    for values in (np.linspace(1, 1.5, 80), 10.0 ** -np.arange(80), np.r_[1e9, np.ones(79)], np.r_[np.full(30, 2.0), np.zeros(50)]):
        basis = np.linalg.qr(r.standard_normal((80, 80)))[0]
        matrix = basis * values @ basis.T
        found, vectors, residuals = whitening.leading_eigenpairs(lambda q: matrix @ q, 80, 20)
        assert np.allclose(found, np.sort(values)[::-1][:20], atol=1e-10 * values.max())
        assert residuals.max() <= whitening.ACCEPTED * values.max()
        assert np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-12
