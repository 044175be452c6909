"""Harmony: its ridge fit, its objective and what it does to batches that overlap."""

import numpy as np
import pytest

from platewise.operators import harmony as H


def test_offsets_equal_dense_ridge_regression():
    rng = np.random.default_rng(0)
    x, b, r = rng.normal(size=(40, 3)), rng.integers(0, 4, 40), rng.random((40, 2))
    counts = np.stack([[r[b == j, k].sum() for j in range(4)] for k in range(2)])
    sums = np.stack([[r[b == j, k] @ x[b == j] for j in range(4)] for k in range(2)])
    phi = np.hstack((np.ones((40, 1)), np.eye(4)[b]))
    got = H.ridge_offsets(counts, sums, 0.7)
    for k in range(2):
        w = r[:, k][:, None]
        want = np.linalg.solve(phi.T @ (w * phi) + np.diag([0, 0.7, 0.7, 0.7, 0.7]), phi.T @ (w * x))
        assert np.allclose(got[k], want[1:], atol=1e-6)


def test_assignment_prefers_what_its_batch_lacks():
    z, centres = H._unit(np.array([[1.0, 1.0]])), H._unit(np.array([[1.0, 0.9], [0.9, 1.0]]))
    even, _ = H.assign(z, np.array([0]), centres, np.zeros((2, 2)), 0.1)
    tilted, _ = H.assign(z, np.array([0]), centres, np.array([[-1.0, 0.0], [1.0, 0.0]]), 0.1)
    assert np.allclose(even, 0.5) and tilted[0, 1] > 0.8


@pytest.fixture(scope="module")
def screen(spark):
    rng = np.random.default_rng(1)
    kind, batch = np.arange(240) % 3, np.arange(240) // 3 % 2
    x = np.eye(4)[kind] * 8 + rng.normal(size=(240, 4)) * 0.6 + np.array([0, 0, 0, 2.5]) * batch[:, None]
    rows = [(i, f"b{batch[i]}", *map(float, x[i])) for i in range(240)] + [(900, "b0", None, 1.0, 1.0, 1.0)]
    return kind, batch, x, spark.createDataFrame(rows, "id long, plate string, a double, b double, c double, d double").repartition(3)


def test_batches_come_together_and_kinds_stay_apart(spark, screen):
    kind, batch, x, df = screen
    history: list = []
    run = lambda **k: {r["id"]: [r["a"], r["b"], r["c"], r["d"]] for r in H.harmony(df, list("abcd"), "plate", 3, 3, blocks=2, max_iter_cluster=3, **k).collect()}
    got = run(history=history)
    z = np.array([got[i] for i in range(240)])
    gap = lambda m: max(np.linalg.norm(m[(kind == k) & (batch == 0)].mean(0) - m[(kind == k) & (batch == 1)].mean(0)) for k in range(3))
    assert gap(z) < 0.2 * gap(x)
    own = [z[kind == k].mean(0) for k in range(3)]
    assert min(np.linalg.norm(own[i] - own[j]) for i in range(3) for j in range(i)) > 8
    assert got[900] == [None, 1.0, 1.0, 1.0]  # a missing feature leaves the row as it is
    assert history[-1] <= history[0] + 1e-6
    with pytest.raises(ValueError):
        H.harmony(df.where("plate = 'b0'"), list("abcd"), "plate", 3)
