"""Reductions of all pairs inside tiles against the pair tables that say the same."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.operators import batch as BA
from platewise.operators import effects as E
from platewise.operators import folds
from platewise.operators import metrics as M
from platewise.operators import normalize as Z
from platewise.operators import nulls as N
from platewise.operators import pairs as P
from platewise.operators import select as S
from platewise.operators import tiles


@pytest.fixture(scope="module")
def frame(spark):
    """90 rows with equal rows, ties, and NULL labels."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(90, 4)), 1)
    x[80:] = x[:10]
    rows = [(i * 7 % 90, None if i % 13 == 5 else f"g{i % 4}", i % 3, i % 5 == 0, [float(v) for v in x[i]], [f"a{i % 4}", f"b{i % 6 // 3}"]) for i in range(90)]
    return spark.createDataFrame(rows, "id long, label string, batch long, control boolean, v array<double>, tags array<string>").repartition(3)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(folds, "LEAST", 16)
    monkeypatch.setattr(folds, "STRIP", 100)


def _pairs(frame, ordered=False):
    return P.similarity_pairs(frame, "id", "v", keep=["label", "batch", "control", "tags"], ordered=ordered)


def _rows(df, digits=9):
    cols = sorted(df.columns)
    return sorted((tuple(round(r[c], digits) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect()), key=str)


def test_medians_within_groups(frame):
    want = _pairs(frame).where("label_i = label_j").groupBy(F.col("label_i").alias("group")).agg(F.median("sim").alias("median"), F.count(F.lit(1)).alias("n"))
    assert _rows(P.replicate_medians(frame, "id", "v", "label")) == _rows(want)


@pytest.mark.parametrize("draws", [3, 200])
def test_percent_replicating(frame, draws):
    """With 3 draws the null takes part of the pairs, with 200 all of them."""
    assert _rows(P.replicating_rows(frame, "id", "v", "label", draws)) == _rows(P.percent_replicating(_pairs(frame), "label", draws))


def test_hash_is_sparks(spark):
    ids = np.array([0, 1, -5, 2**40, -(2**63)])
    rows = spark.createDataFrame([(int(i), int(j)) for i in ids for j in ids], "i long, j long").select("i", "j", F.xxhash64(F.lit(7), "i", "j").alias("h")).collect()
    got = folds.pair_hash(7, ids, ids).view(np.int64)
    at = {int(i): k for k, i in enumerate(ids)}
    assert all(got[at[r["i"]], at[r["j"]]] == r["h"] for r in rows)


def test_grit(frame):
    assert _rows(P.grit_rows(frame, "id", "v", "label", "control"), 7) == _rows(P.grit(_pairs(frame, True), "label", "control"), 7)


def test_means_of_label_pairs(frame):
    assert _rows(P.class_similarities(frame, "id", "v", "label")) == _rows(_pairs(frame).groupBy("label_i", "label_j").agg(F.avg("sim").alias("sim")))


def test_relationships_and_network(spark, frame):
    p = _pairs(frame)
    assert _rows(P.known_relationships_rows(frame, "id", "v", "label", 20.0)) == _rows(P.known_relationships(p, p.where("label_i = label_j"), 20.0))
    edges = spark.createDataFrame([(i * 11 % 97, i * 5 % 61) for i in range(400)], "a long, b long")
    genes = p.withColumns({"gene_i": F.col("i"), "gene_j": F.col("j")})
    assert _rows(P.network_rows(frame.withColumn("gene", F.col("id")), "id", "v", "gene", edges, 0.9)) == _rows(P.network_table(genes, "gene", edges, 0.9))


@pytest.mark.parametrize("rules", [(["label"], [], [], ["label"]), (["label"], ["batch"], ["batch"], ["label"]), (["label"], ["batch"], [], ["label", "batch"])])
def test_average_precision(frame, rules):
    names = ("pos_sameby", "pos_diffby", "neg_sameby", "neg_diffby")
    got = P.average_precision_rows(frame, "id", "v", **dict(zip(names, rules)))
    assert _rows(got) == _rows(P.average_precision(P.map_pairs(_pairs(frame, True), *rules)))


def test_average_precision_of_label_sets_and_references(frame):
    pairs = _pairs(frame, True)
    assert _rows(P.average_precision_rows(frame, "id", "v", label_sets="tags")) == _rows(P.average_precision(P.map_pairs(pairs, label_sets="tags")))
    flagged = frame.withColumn("treated", ~F.col("control"))
    got = P.average_precision_rows(flagged, "id", "v", pos_sameby=["label"], neg_sameby=["batch"], asked="treated", reference="control")
    pairs = pairs.where("not control_i").withColumns({"h_i": F.lit(-1), "h_j": F.when(F.col("control_j"), F.lit(1)).otherwise(-1)})
    assert _rows(got) == _rows(P.average_precision(P.map_pairs(pairs, ["label"], [], ["batch"], ["h"])))


@pytest.mark.parametrize("differ", [[], ["batch"]])
def test_dealt_labels(frame, differ):
    want = N.permutation_null_pvalues(_pairs(frame, True), frame, "id", "label", pos_diffby=differ, neg_sameby=["batch"], n_permutations=12, seed=3)
    got = N.permutation_null_rows(frame, "id", "v", "label", pos_diffby=differ, neg_sameby=["batch"], n_permutations=12, seed=3)
    assert _rows(got) == _rows(want)


def test_labels_dealt_among_all_rows(frame):
    want = P.map_permutation_pvalues(_pairs(frame, True), frame.select(F.col("id").alias("i"), "label"), "label", 9, 2)
    assert _rows(P.map_permutation_rows(frame, "id", "v", "label", 9, 2)) == _rows(want)


def test_integration_scores(frame):
    a, b = (frame.select(F.col("id").alias(k), F.col("label").alias(f"label_{k}"), F.col("batch").alias(f"batch_{k}"), F.col("v").alias(f"v{k}")) for k in "ij")
    d = a.join(b, F.col("i") != F.col("j")).withColumn("d", F.round(F.sqrt(P.sq_euclidean("vi", "vj")), 6))
    assert _rows(M.silhouette_rows(frame, "id", "v", "label")) == _rows(M.silhouette(d, "label"))
    assert _rows(M.lisi_rows(frame, "id", "v", "batch", 7)) == _rows(M.lisi(d, "batch", 7))


def test_distances_of_large_vectors_keep_their_digits():
    x = 1e6 + np.random.default_rng(0).normal(size=(30, 5))
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(folds.distances(x, x) / folds.SCALE, want, atol=1e-6)


def test_nearest_rows_without_clusters_are_found_in_tiles(spark):
    """The bounds rule nothing out in many dimensions, so no row is carried into every cell."""
    x = np.random.default_rng(1).normal(size=(300, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row long, v array<double>")
    near = tiles.nearest_neighbours(df, "row", "v", 4, block=64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag(np.full(300, np.inf))
    assert {(r["id"], r["r"], r["o_id"]) for r in near.collect()} == {(i, r + 1, int(j)) for i in range(300) for r, j in enumerate(np.argsort(d[i])[:4])}
    assert "cell" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_energy_distance_makes_no_table_of_distances(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ctl" if i < 40 else "t", [float(v) for v in rng.normal(size=3)]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    got = E.edistance(df, "id", "v", "g", F.col("g") == "ctl", 20).first()
    x, c = np.array([r[2] for r in rows[40:]]), np.array([r[2] for r in rows[:40]])
    mean = lambda a, b, n: ((a[:, None] - b[None]) ** 2).sum() / n
    assert got["distance"] == pytest.approx(2 * mean(x, c, 2400) - mean(x, x, 60 * 59) - mean(c, c, 40 * 39))
    assert "z @ z.T" not in inspect.getsource(E.edistance)


def test_kruskal_has_no_window_over_a_feature(spark):
    df = spark.createDataFrame([(i % 3, float(i % 7)) for i in range(200)], "g int, x double")
    got = S.kruskal(df, ["x"], "g")
    x, g = np.array([i % 7 for i in range(200)]), np.array([i % 3 for i in range(200)])
    rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    ties = sum((x == v).sum() ** 3 - (x == v).sum() for v in set(x))
    h = (12 / (200 * 201) * sum(rank[g == k].sum() ** 2 / (g == k).sum() for k in range(3)) - 3 * 201) / (1 - ties / (200**3 - 200))
    assert got.first()["h"] == pytest.approx(h)
    assert "rank(value" not in S.kruskal(df, ["x"], "g", p_values=False)._jdf.queryExecution().optimizedPlan().toString()


def test_guide_medians_meet_no_control_guides(spark):
    df = spark.createDataFrame([(i % 5, i % 2, i % 10 < 3, float(i % 4)) for i in range(60)], "guide int, gene int, control boolean, x double")
    plan = E.guide_medians(df, "x", "guide", "gene", F.col("control"))
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString() and plan.count() > 0


def test_null_genes_are_drawn_in_parts(spark):
    rows = [(i, i % 4, (i * 37 % 101 + 1) / 103.0, i % 4 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "guide long, gene long, p double, control boolean")
    for method in ("stouffer", "fisher", "order"):
        got = {r["gene"]: r for r in E.aggregate_guides(df, "p", "gene", F.col("control"), "guide", method, 500).collect()}
        pool = np.array([r[2] for r in rows if r[3]])
        x = np.random.default_rng([0, 30]).choice(pool, (500, 30))
        null = {"stouffer": -E.S.ndtri(x).sum(1) / np.sqrt(30), "fisher": -2 * np.log(x).sum(1), "order": -np.sort(x, 1)[:, 15]}[method]
        for r in got.values():
            s = -r["statistic"] if method == "order" else r["statistic"]
            assert r["pvalue"] == pytest.approx((1 + (null >= s - 1e-12).sum()) / 501)


def test_gaps_of_a_group_are_filled_in_parts(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 3)), 1)
    x[rng.random((150, 3)) < 0.15] = np.nan
    rows = [(i, "p", i % 2 == 0, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, plate string, control boolean, a double, b double, c double")
    order = [r["id"] for r in df.where("control").orderBy(F.xxhash64("id"), "id").collect()]
    d = x[order]
    out = Z.impute(df, ["a", "b", "c"], ["plate"], F.col("control"), "knn", row_id="id")
    got = {r["id"]: [r["a"], r["b"], r["c"]] for r in out.collect()}
    for i in range(150):
        seen = ~np.isnan(x[i])
        both = ~np.isnan(d) & seen
        n = both.sum(1)
        dist = np.where(n > 0, np.where(both, (np.nan_to_num(d) - np.nan_to_num(x[i])) ** 2, 0.0).sum(1) * 3 / np.maximum(n, 1), np.inf)
        for j in range(3):
            near = [k for k in np.argsort(dist, kind="stable") if not np.isnan(d[k, j]) and np.isfinite(dist[k])][:5]
            assert got[i][j] == pytest.approx(x[i, j] if seen[j] else d[near, j].mean() if near else np.nanmean(d[:, j]))
    assert "__part" in out._jdf.queryExecution().analyzed().toString()


def test_epsilon_of_the_sphere(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, i % 5, i % 5 == 0, *[float(v) for v in rng.normal(size=3)]) for i in range(80)], "id long, label long, control boolean, a double, b double, c double")
    got = {r["epsilon"]: r["score"] for r in BA.select_epsilon(df, ["a", "b", "c"], F.col("control"), "label", "id", [1e-6, 1.0]).collect()}
    fit = F.col("control") & (F.pmod(F.xxhash64("id"), F.lit(2)) == 0)
    mean, cov, _ = BA.covariance(df.where(fit), ["a", "b", "c"])
    for e, score in got.items():
        center, m = BA.sphere_matrix(mean, cov, "ZCA-cor", e)
        z = BA.apply_matrix(df.where(~fit), ["a", "b", "c"], m, center).withColumn("v", F.array("a", "b", "c"))
        p = P.similarity_pairs(z, "id", "v", keep=["label"], ordered=True)
        assert score == pytest.approx(P.average_precision(P.map_pairs(p, ["label"], [], [], ["label"])).agg(F.avg("ap")).first()[0])


def test_no_pairs_are_shuffled(frame):
    for df in (P.replicate_medians(frame, "id", "v", "label"), P.class_similarities(frame, "id", "v", "label"), M.silhouette_rows(frame, "id", "v", "label"), P.average_precision_rows(frame, "id", "v", pos_sameby=["label"], neg_diffby=["label"])):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text and "MapInArrow" in text
