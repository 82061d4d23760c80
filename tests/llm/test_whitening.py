"""Whitening against numpy: rank-one updates, odd vectors, exact integers, more dimensions than directions kept."""

import math

import numpy as np
import pytest

from episodica.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, n long, component string"


def table(spark, vectors, parts=3, ids=None):
    rows = [(k if ids is None else ids[k], v, 0, 7, 7, "clash") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(vectors):
    x = np.floor(np.array(vectors, dtype=np.float32).astype(np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = (x - s / n).astype(np.float64)
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1], turn[:, ::-1]
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    return n, values, y @ turn[:, :8] / np.sqrt(np.maximum(values[:8], 1e-300)), deviation


def compare(found, vectors, tolerance=1e-8):
    n, values, white, deviation = brute(vectors)
    count = min(8, len(vectors[0]))
    got = np.full((len(vectors), count), np.nan)
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
        assert r.identity_error < 1e-9
    sign = np.sign((got * white[:, :count]).sum(axis=0))
    assert np.abs(got * sign - white[:, :count]).max() < tolerance


@pytest.mark.parametrize("length,rows,options", [
    (5, 60, {}), (5, 60, {"fold": False, "block": 7}), (20, 300, {"block": 64}), (3, 40, {}), (1, 9, {}),
    (80, 400, {"width": 16, "block": 100}), (64, 300, {}),
])
def test_equals_numpy(spark, length, rows, options):
    rng = np.random.default_rng(length + rows)
    vectors = (rng.normal(size=(rows, length)) * (1 + np.arange(length) % 11) @ rng.normal(size=(length, length))).tolist()
    model, usable = whitening.fit(table(spark, vectors), **options)
    compare(whitening.transform(usable, model).collect(), vectors)


def test_rank_one_updates_with_equal_and_missing_parts():
    rng = np.random.default_rng(1)
    for _ in range(400):
        k = int(rng.integers(1, 9))
        values = np.sort(rng.choice([0, 0, 1, 1, 1 + 1e-15, 1 + 1e-10, 5, 3 + 1e-13, 1e6], k))
        z = rng.normal(size=k) * 10.0 ** rng.integers(-12, 4, k) * (rng.random(k) < 0.8)
        found, turn = whitening.rank_one(values, np.eye(k), z)
        whole = np.diag(values) + np.outer(z, z)
        assert np.abs((turn * found) @ turn.T - whole).max() <= 1e-13 * max(1, np.abs(whole).max())
        assert np.abs(turn.T @ turn - np.eye(k)).max() < 1e-13 and (np.diff(found) >= 0).all()


def test_spectra_combine_to_the_scatter_of_all_rows():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(500, 12)) * 10.0 ** rng.uniform(-3, 3, 12) + 1e4
    rows[100:180] = rows[100]
    rows[:, 3] = rows[:, 4]
    for fold in (True, False):
        spectra = []
        for low, high in ((0, 90), (90, 91), (91, 300), (300, 500)):
            spectra.append(whitening.Spectrum.empty(12, 64))
            for k in range(low, high, 40):
                spectra[-1].add_rows(rows[k : min(k + 40, high)], fold)
        first, *others = spectra
        for other in others:
            first.add(other)
        centred = rows - rows.mean(axis=0)
        whole = centred.T @ centred
        assert first.n == 500 and np.allclose(first.mean, rows.mean(axis=0), rtol=1e-12)
        assert np.abs((first.vectors * first.values) @ first.vectors.T - whole).max() < 1e-11 * np.abs(whole).max()


def test_odd_vectors_are_dropped(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(50, 4)).tolist()
    odd = [None, [], [1.0, None, 1.0, 1.0], [math.nan] * 4, [1.0, math.inf, 0.0, 0.0], [1e30, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0], [0.5]]
    compare(whitening.whiten(table(spark, good + odd)).collect(), good)
    assert whitening.whiten(table(spark, odd[:6])).count() == 0
    assert whitening.whiten(table(spark, odd[:6]).limit(0)).columns == [c.split()[0] for c in whitening.SCHEMA.split(", ")]


def test_repeated_rows_missing_ids_and_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 6)).tolist()
    vectors += [vectors[0]] * 60
    compare(whitening.whiten(table(spark, vectors, parts=8)).collect(), vectors)
    found = whitening.whiten(table(spark, vectors, ids=[None] * 50 + [7] * 50)).collect()
    assert len(found) == 600 and sum(r.vec_id is None for r in found) == 300


def test_components_without_variance(spark):
    flat = [[float(k), 2.0 * k, 0.0] for k in range(1, 30)]
    found = whitening.whiten(table(spark, flat)).collect()
    assert {(r.component, r.whitened is None) for r in found} == {(1, False), (2, True), (3, True)}
    assert max(r.identity_error for r in found) < 1e-9
    assert all(r.whitened is None and r.deviation == 0 for r in whitening.whiten(table(spark, [[1.0, 2.0]] * 5)).collect())
    single = whitening.whiten(table(spark, [[3.0, -4.0]])).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in single] == [(1, 0, None, 0.0)] * 2


def test_deviation_beyond_a_long_is_null(spark):
    vectors = [[3e9, 0.0], [-3e9, 1.0], [0.0, 0.0]]
    found = whitening.whiten(table(spark, vectors)).collect()
    deviation = brute(vectors)[3]
    for r in found:
        assert r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None)
    assert any(r.deviation is None for r in found) and any(r.deviation is not None for r in found)
