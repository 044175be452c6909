"""Tiles and the nearest-neighbour join against all pairs."""

import numpy as np
import pytest

from platewise.operators import pairs as P
from platewise.operators import tiles


def _frame(spark, x, by=None):
    rows = [(i, None if by is None else by[i], [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row long, grp string, v array<double>").repartition(4)


def _all_pairs(x, k, by=None):
    out = set()
    for i in range(len(x)):
        d = []
        for j in range(len(x)):
            if j != i and (by is None or by[i] == by[j]):
                total = 0.0
                for a, b in zip(x[i], x[j]):
                    total += (a - b) * (a - b)
                d.append((float(np.sqrt(total)), j))
        out |= {(i, j, r + 1, round(v, 12)) for r, (v, j) in enumerate(sorted(d)[:k])}
    return out


def _got(df):
    return {(r["id"], r["o_id"], r["r"], round(r["d"], 12)) for r in df.collect()}


def _clustered(n, dim=8, clusters=12, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 30, (clusters, dim))[rng.integers(0, clusters, n)] + rng.normal(0, 1, (n, dim))


@pytest.mark.parametrize("block", [16, 1024])
def test_neighbours_equal_all_pairs(spark, block):
    x = _clustered(260)
    x[200:230] = x[3]  # a crowd of equal rows
    x[230:] = np.round(x[230:])  # ties
    assert _got(tiles.nearest_neighbours(_frame(spark, x), "row", "v", 5, block=block)) == _all_pairs(x, 5)


def test_neighbours_within_groups(spark):
    x = np.random.default_rng(1).integers(0, 6, (150, 2)).astype(float)
    by = [["a", "b", "c"][i % 3] if i < 146 else "few" for i in range(150)]
    got = tiles.nearest_neighbours(_frame(spark, x, by), "row", "v", 7, ["grp"], pivots=9, block=20)
    assert _got(got) == _all_pairs(x, 7, by)


def test_neighbours_of_few_or_no_rows(spark):
    x = np.array([[0.0, 1.0], [2.0, 2.0], [2.0, 2.0]])
    assert _got(tiles.nearest_neighbours(_frame(spark, x), "row", "v", 5)) == _all_pairs(x, 5)
    assert tiles.nearest_neighbours(_frame(spark, x[:1]), "row", "v", 5).count() == 0
    assert tiles.nearest_neighbours(_frame(spark, x[:0]), "row", "v", 5).count() == 0


def test_most_pairs_are_never_computed(spark):
    n, counted = 6000, []
    x = _clustered(n, 8, 120)
    got = tiles.nearest_neighbours(_frame(spark, x), "row", "v", 5, counted=counted)
    assert got.count() == 5 * n and counted[0] < 0.05 * n * n


@pytest.mark.parametrize("block", [7, 1024])
def test_tiles_equal_all_pairs(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    by = [["a", "b", None][i % 3] for i in range(60)]
    df = _frame(spark, x, by)
    sim = np.round(x @ x.T, 6)
    got = {(r["i"], r["j"]): r for r in tiles.pair_tiles(df, "row", "v", ["grp"], block=block).collect()}
    assert set(got) == {(i, j) for i in range(60) for j in range(i + 1, 60)}
    assert all(abs(r["sim"] - sim[i, j]) < 1e-9 and r["grp_i"] == by[i] and r["grp_j"] == by[j] for (i, j), r in got.items())
    best = tiles.pair_tiles(df, "row", "v", ordered=True, k=3, block=block).collect()
    want = {(i, j) for i in range(60) for j in sorted(set(range(60)) - {i}, key=lambda j: (-sim[i, j], j))[:3]}
    assert {(r["i"], r["j"]) for r in best} == want
    rules = tiles.pair_tiles(df, "row", "v", ["grp"], ordered=True, rules=[(["grp"], []), ([], ["grp"])], block=block).collect()
    assert {(r["i"], r["j"]) for r in rules} == {(i, j) for i in range(60) for j in range(60) if i != j and by[i] and by[j]}
    assert tiles.pair_tiles(df.limit(0), "row", "v", block=block).count() == 0


def test_no_nested_loop_join(spark):
    df = _frame(spark, np.eye(6))
    for plan in (P.similarity_pairs(df, "row", "v"), P.similarity_pairs(df, "row", "v", ordered=True, k=2), tiles.nearest_neighbours(df, "row", "v", 2)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
