"""One-scan correlations, exact quantiles of large groups, and the covariance of the concentrated half."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import effects as E
from platewise.operators import gram, mcd, quantiles
from platewise.operators import select as S


def _wide(spark, x, names):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)


def _slow(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return len(a), None
    return len(a), float(np.corrcoef(a, b)[0, 1])


@pytest.mark.parametrize("block", [3, 128])
def test_correlations_equal_pairs(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 8)) + 1e6
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=90)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 7.0  # constant
    x[:, 6] = np.nan  # never known
    x[1:, 7] = np.nan  # one value
    names = [f"f{i}" for i in range(8)]
    got = {(r["feature_a"], r["feature_b"]): (r["n"], r["r"]) for r in gram.pairwise_correlations(_wide(spark, x, names), names, block).collect()}
    assert set(got) == set(itertools.combinations(names, 2))
    for (i, a), (j, b) in itertools.combinations(enumerate(names), 2):
        n, r = _slow(x, i, j)
        assert got[a, b][0] == n and (got[a, b][1] is None) == (r is None) and (r is None or got[a, b][1] == pytest.approx(r, abs=1e-8))


def test_a_thousand_features_are_one_scan(spark):
    rng = np.random.default_rng(1)
    x, names = rng.normal(size=(40, 1000)), [f"f{i}" for i in range(1000)]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    df = df.select(*[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    out = S.correlated_pairs(df, names)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Scan ExistingRDD") == 3  # one pass and its merge; the table, and the names twice
    r = np.corrcoef(x.T)
    got = out.where("feature_a = 'f17'").collect()
    assert len(got) == 982 and all(a["r"] == pytest.approx(r[17, int(a["feature_b"][1:])], abs=1e-9) for a in got)
    assert out.count() == 1000 * 999 // 2


def _quantile_rows():
    rng = np.random.default_rng(2)
    a = np.concatenate((rng.normal(size=900), rng.lognormal(0, 8, 300), np.full(400, 3.25), [1e300, -1e300, 0.0, -0.0, math.inf]))
    b = rng.integers(0, 4, 700) * 1.0
    return [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", 5.0), ("d", None), ("d", math.nan), (None, 1.0), (None, 2.0)]


@pytest.mark.parametrize("buckets", [4, 1024])
def test_quantiles_equal_percentile(spark, buckets):
    df = spark.createDataFrame(_quantile_rows(), "g string, x double").repartition(4)
    q = [0.0, 0.05, 0.25, 0.5, 0.731, 0.99, 1.0]
    known = df.where("x is not null and not isnan(x)")
    want = {r["g"]: r for r in known.groupBy("g").agg(*[F.percentile("x", F.lit(p)).alias(f"q{i}") for i, p in enumerate(q)], *[F.expr(f"percentile_disc({p}) within group (order by x)").alias(f"l{i}") for i, p in enumerate(q)]).collect()}
    got = {r["g"]: r for r in quantiles.large_quantiles(df, ["g"], ["x"], q, buckets=buckets).collect()}
    low = {r["g"]: r for r in quantiles.large_quantiles(df, ["g"], ["x"], q, lower=True, buckets=buckets).collect()}
    assert set(got) == set(want) == set(low) == {"a", "b", "c", None}
    for g, r in want.items():
        assert [got[g][f"q{i}"] for i in range(len(q))] == pytest.approx([r[f"q{i}"] for i in range(len(q))], rel=1e-12)
        assert [low[g][f"q{i}"] for i in range(len(q))] == [r[f"l{i}"] for i in range(len(q))]


def test_quantiles_of_a_whole_table(spark):
    df = spark.range(20_000).select(F.sin(F.col("id") * 1.7).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(97)) * 1.0).alias("y"))
    got = {r["feature"]: r for r in quantiles.large_quantiles(df, [], ["x", "y"], [0.25, 0.5]).collect()}
    for f in "xy":
        assert [got[f]["q0"], got[f]["q1"]] == pytest.approx(df.agg(F.percentile(f, F.array(F.lit(0.25), F.lit(0.5)))).first()[0], rel=1e-12)
    mad = {r["feature"]: (r["center"], r["spread"]) for r in quantiles.large_median_and_mad(df, [], ["x", "y"]).collect()}
    for f in "xy":
        m = df.agg(F.median(f)).first()[0]
        assert mad[f] == pytest.approx((m, df.agg(F.median(F.abs(F.col(f) - m))).first()[0]), rel=1e-12)


def _points(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"f{i} double" for i in range(x.shape[1]))).repartition(4)


def _reweighted(x, mean, cov, h):
    n, p = x.shape
    raw = cov * mcd.consistency(p, h / n) * mcd.small_sample(p, n, False)
    keep = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(raw), x - mean) < mcd.chi2_quantile(0.975, p)
    cov = np.cov(x[keep].T)
    return x[keep].mean(0), cov * (mcd.consistency(p, 0.975) * mcd.small_sample(p, n, True) if keep.sum() < n else 1.0)


def test_mcd_finds_the_best_of_all_subsets(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(13, 2))
    x[:3] += 9
    h = mcd.subset_size(13, 2)
    best = min(itertools.combinations(range(13), h), key=lambda s: np.linalg.det(np.cov(x[list(s)].T)))
    want = _reweighted(x, x[list(best)].mean(0), np.cov(x[list(best)].T), h)
    got = mcd.robust_covariance(_points(spark, x), ["f0", "f1"], "id")
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_a_step_over_all_rows_equals_a_step_in_memory(spark):
    rng = np.random.default_rng(7)
    x = np.vstack((rng.normal(size=(90, 3)), np.zeros((30, 3))))  # equal rows at the cut
    df = _points(spark, x).select(F.array("f0", "f1", "f2").alias("x"))
    for h in (65, 100):
        got = mcd._step(df, 3, [(x.mean(0), np.cov(x.T)), (np.ones(3), np.eye(3))], h)
        for (mean, cov), (det, m, c) in zip([(x.mean(0), np.cov(x.T)), (np.ones(3), np.eye(3))], got):
            rows = x[np.argsort(mcd._squared(x, mean, cov), kind="stable")[:h]]
            assert np.allclose(m, rows.mean(0)) and np.allclose(c, np.cov(rows.T)) and det == pytest.approx(np.linalg.slogdet(np.cov(rows.T))[1])


def test_mcd_of_a_large_table(spark):
    """A quarter of the rows strays far; location and scatter are those of the others, and the table is beyond the sample."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2400, 3)) @ np.array([[2.0, 0, 0], [1, 1, 0], [0, 0.3, 0.5]])
    x[:600] += [60, -40, 30]
    mean, cov = mcd.robust_covariance(_points(spark, x), ["f0", "f1", "f2"], "id")
    true = np.cov(x[600:].T)
    assert np.abs(mean - x[600:].mean(0)).max() < 0.15 and np.abs(cov - true).max() < 0.15 * np.abs(true).max()
    with pytest.raises(ValueError):
        mcd.robust_covariance(_points(spark, np.ones((30, 2))), ["f0", "f1"], "id")


def test_a_robust_covariance_calls_what_stray_controls_hide(spark):
    rng = np.random.default_rng(0)
    ctl = rng.normal(size=(120, 4))
    ctl[:12, 0] += 12.0
    hit = rng.normal(size=(12, 4))
    hit[:, 0] += 4.0
    rows = [(i, "ctl" if i < 120 else "hit", i < 120, *map(float, r)) for i, r in enumerate(np.vstack((ctl, hit)))]
    df = spark.createDataFrame(rows, "id long, grp string, control boolean, a double, b double, c double, d double")
    p = {kind: E.hit_calling(df, list("abcd"), "grp", F.col("control"), "id", n_permutations=300, covariance=kind).first() for kind in ("empirical", "robust")}
    assert p["robust"]["statistic"] > 1.5 * p["empirical"]["statistic"] and p["robust"]["pvalue"] < 0.02


def test_sums_before_equal_a_window(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v), int(c)) for g in "ab" for v, c in zip(np.unique(np.concatenate((rng.lognormal(0, 5, 200), [-1e300, 0.0, math.inf]))), rng.integers(0, 5, 203))]
    df = spark.createDataFrame(rows, "g string, v double, c long").repartition(3)
    for buckets in (2, 1024):
        got = {(r["g"], r["v"]): r["s"] for r in quantiles.sum_before(df, ["g"], "v", "c", "s", buckets).collect()}
        assert got == {(g, v): sum(c2 for g2, v2, c2 in rows if g2 == g and v2 < v) for g, v, _ in rows}
