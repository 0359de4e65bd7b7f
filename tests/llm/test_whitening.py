import math

import numpy as np
import pytest

from tsrisk.llm import whitening as wh
from tsrisk.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, n int, x int, component int, size int"


def vectors(spark, *rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA)


def check(found, rows, k=4):
    """Against numpy's own decomposition: exact numbers, components up to their sign."""
    found = [r.asDict() for r in found.collect()]
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in usable]
    expected = 0
    for size in {len(x) for _, x in whole}:
        fit = sorted({x for _, x in whole if len(x) == size})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        z = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit], float)
        cov = z.T @ z / n
        e, u = np.linalg.eigh(cov)
        e, u = e[::-1][:k], u[:, ::-1][:, :k]
        for i, x in [w for w in whole if len(w[1]) == size]:
            own = [r for r in found if r["vec_id"] == i and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums))]
            assert own and all(r["n"] == n for r in own)
        for c in range(len(e)):
            rows_c = [r for r in found if r["component"] == c + 1 and r["n"] == n]
            expected += len([w for w in whole if len(w[1]) == size])
            if e[c] > 1e-9 * max(e[0], 1e-300) and e[0] > 0:
                assert all(abs(r["explained"] - e[c] / np.trace(cov)) <= 1e-10 for r in rows_c)
                assert all(r["identity_error"] < 1e-9 for r in rows_c)
                gap = min([abs(e[c] - o) for j, o in enumerate(np.linalg.eigvalsh(cov)[::-1]) if j != c] or [e[c]])
                if gap > 1e-6 * e[0]:
                    mine, theirs = {}, {}
                    for r in rows_c:
                        mine[r["vec_id"]] = r["whitened"]
                    for i, x in [w for w in whole if len(w[1]) == size]:
                        theirs[i] = (np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ u[:, c]) / math.sqrt(e[c])
                    a, b = np.array([mine[i] for i in theirs]), np.array([theirs[i] for i in theirs])
                    assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
            else:
                assert all(r["whitened"] is None for r in rows_c)
    assert len(found) == expected
    return found


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_spectral_division(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((3 * d, d)) * np.logspace(0, -6, d)
    cov = a.T @ a
    values, vectors_ = wh.leading(cov, 4)
    assert np.allclose(values, np.linalg.eigvalsh(cov)[::-1][:4], rtol=1e-9, atol=1e-13 * np.trace(cov))
    assert np.abs(cov @ vectors_ - vectors_ * values).max() < 1e-13 * np.trace(cov) * d
    assert np.abs(vectors_.T @ vectors_ - np.eye(len(values))).max() < 1e-12


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 5], [5, 5, 1, 1, 0], [1, 0, 0, 0, 0], [0, 0, 0], [2, 2, 2, 1], [3, 3 - 1e-9, 1, 1], [4, 3, 2, 1, 2.5]])
def test_equal_and_missing_eigenvalues(values):
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((len(values),) * 2))[0]
    cov = q @ np.diag(np.array(values, float)) @ q.T
    got, u = wh.leading(cov, 4)
    assert np.allclose(got, sorted(values, reverse=True)[:4], atol=1e-12)
    assert np.abs(u.T @ u - np.eye(len(got))).max() < 1e-12
    assert np.abs(cov @ u - u * got).max() < 1e-12 * max(1, max(values))


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    e, u = np.linalg.eigh(a)
    assert np.abs(wh.polar(a) - u @ np.diag(np.sign(e)) @ u.T).max() < 1e-12


def test_repeats_odd_vectors_and_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(6) * [4, 3, 2, 1, 0.5, 0.2]).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(7, rows[7][1])]
    rows += [(200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [])]
    rows += [(300 + i, [float(i), float(i * i), 1.0]) for i in range(5)] + [(400, [-0.0, 1.0])]
    found = check(wh.whiten(vectors(spark, *rows).repartition(4)), rows)
    assert {r["component"] for r in found if r["vec_id"] == 400} == {1, 2}
    assert all(r["explained"] is None for r in found if r["vec_id"] == 400)


def test_null_ids_huge_numbers_and_empty(spark):
    df = vectors(spark, (None, [1e300, 1.0]), (None, [-1e300, 2.0]), (5, [0.5, 2.0]))
    found = wh.whiten(df).collect()
    assert len(found) == 6 and max(r.deviation for r in found) == 2**63 - 1
    assert wh.whiten(df.limit(0)).count() == 0
    assert wh.whiten(df).columns[:2] == ["vec_id", "component"]


def test_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op12_whitening"](spark, folder), rows)
