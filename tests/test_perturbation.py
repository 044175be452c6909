"""Classifier scores: the fit against plain Newton steps, levels, replicates and groups of several parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import perturbation as PS


def _fit(x, y, columns):
    """The same penalised model by Newton steps on all rows at once."""
    x = np.column_stack((x[:, columns], np.ones(len(x))))
    c = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (c * (p - y)) + w)
    return w


def _frequency(x, y):
    out = []
    for j in range(x.shape[1]):
        a, b = x[y == 1, j], x[y == 0, j]
        between = len(a) * (a.mean() - x[:, j].mean()) ** 2 + len(b) * (b.mean() - x[:, j].mean()) ** 2
        out.append(between / (((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) * (len(x) - 2))
    return np.array(out)


def test_features_and_steps_equal_plain_ones():
    rng = np.random.default_rng(0)
    x, y, fold = rng.normal(size=(120, 5)), rng.integers(0, 2, 120), rng.integers(0, 3, 120)
    x[y == 1, 2] += 1.5
    x[:, 4] = 3.0
    stats = np.array([[[((fold == f) & (y == s)).sum(), *x[(fold == f) & (y == s)].sum(0), *(x[(fold == f) & (y == s)] ** 2).sum(0)] for s in (0, 1)] for f in range(3)])
    picked = PS.best_features(stats.ravel(), 3, 5, 2)
    for f in range(3):
        t = fold != f
        assert picked[f].tolist() == sorted(np.argsort(_frequency(x[t][:, :4], y[t]))[-2:].tolist())
        m = PS.Model(picked[f], np.array([(y[t] == 0).sum(), (y[t] == 1).sum()]))
        for _ in range(PS.STEPS):
            m.update(PS.model_sums(np.column_stack((x[t][:, picked[f]], np.ones(t.sum()))), y[t], m.weight, m.w))
        assert m.done and np.allclose(m.w, _fit(x[t], y[t], picked[f]), atol=1e-6)


@pytest.fixture(scope="module")
def screen(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for gene, guides in (("HIT", 4), ("QUIET", 4), ("ctl", 8), ("FEW", 1)):
        for g in range(guides):
            offset = rng.normal(0, 1.2, 4)  # of the guide
            for _ in range(60 if gene != "FEW" else 10):
                v = rng.normal(size=4) + offset * (gene != "ctl") * 0.8 + np.array([2.5, 0, 0, 0]) * (gene == "HIT")
                rows.append((i, gene, f"{gene}{g}", "m" if i % 2 else "i", gene == "ctl", *map(float, v)))
                i += 1
    return spark.createDataFrame(rows, "id long, gene string, guide string, stage string, control boolean, a double, b double, c double, d double").repartition(4)


def test_scores_of_cells_and_groups(spark, screen, monkeypatch):
    monkeypatch.setattr(PS, "PART", 100)  # a group is several parts
    kind = dict(features=list("abcd"), group="gene", control=F.col("control"), row_id="id", n_features=3, min_cells=50)
    table, cells = PS.perturbation_score(screen, replicate="guide", n_folds=4, **kind)
    got = {r["gene"]: r for r in table.collect()}
    assert set(got) == {"HIT", "QUIET", "FEW"} and got["FEW"]["auc"] is None and got["FEW"]["n_cells"] == 10 and got["FEW"]["n_folds"] == 0
    assert got["HIT"]["auc"] > 0.8 and got["HIT"]["n_cells"] == got["HIT"]["n_reference"] == 240 and got["HIT"]["n_folds"] == 4
    score = {r["id"]: r["score"] for r in cells.where("gene = 'HIT'").collect()}
    assert len(score) == 240 and all(0 <= v <= 1 for v in score.values())
    loose = {r["gene"]: r["auc"] for r in PS.perturbation_score(screen, **kind)[0].collect()}
    assert loose["QUIET"] > got["QUIET"]["auc"] + 0.05  # folds over cells reward what a guide's cells share


def test_levels_are_scored_apart(spark, screen):
    kind = dict(features=list("abcd"), group="gene", control=F.col("control"), row_id="id", min_cells=50)
    both = {(r["stage"], r["gene"]): (r["n_cells"], r["auc"]) for r in PS.perturbation_score(screen, by="stage", **kind)[0].collect()}
    alone = {(r["stage"], r["gene"]): (r["n_cells"], r["auc"]) for r in PS.perturbation_score(screen.where("stage = 'm'"), by="stage", **kind)[0].collect()}
    assert {k: v for k, v in both.items() if k[0] == "m"} == {k: (n, None if a is None else pytest.approx(a, abs=1e-9)) for k, (n, a) in alone.items()}
    with pytest.raises(ValueError):
        PS.perturbation_score(screen.withColumn("a", F.lit(None).cast("double")), **kind)
