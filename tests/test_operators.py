"""Small hand-computed cases: missing values, ties, zero spread, controls that are missing, infinite values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.functions import wells as W
from platewise.operators import aggregate as A
from platewise.operators import batch as B
from platewise.operators import dose as D
from platewise.operators import effects as E
from platewise.operators import metrics as M
from platewise.operators import normalize as Z
from platewise.operators import pairs as P
from platewise.operators import qc as Q
from platewise.operators import reference as R
from platewise.operators import select as S
from platewise.operators import stats as ST
from platewise.sources import profiles as SRC


@pytest.fixture(scope="module")
def cells(spark):
    rows = [("P1", True, 1.0, 5.0), ("P1", True, 2.0, 5.0), ("P1", True, 3.0, 5.0), ("P1", False, 10.0, 7.0), ("P2", True, None, 1.0), ("P2", True, None, 2.0), ("P2", False, 4.0, float("inf"))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, plate string, ctl boolean, x double, y double")


def test_normalize_policies(cells):
    got = {r["id"]: (r["x"], r["y"]) for r in Z.normalize(cells, ["x", "y"], ["plate"], "ctl").collect()}
    assert got[3][0] == pytest.approx(8 / 1.4826)
    assert got[3][1] is None  # no spread among the controls of P1
    assert got[6][0] == 4.0  # nothing measured in the controls of P2: unchanged
    assert got[6][1] == float("inf")
    assert got[4][0] is None


def test_normalize_refuses_groups_without_controls(spark, cells):
    more = cells.unionByName(spark.createDataFrame([(9, "P3", False, 1.0, 1.0)], cells.schema))
    with pytest.raises(ValueError, match="P3"):
        Z.normalize(more, ["x"], ["plate"], "ctl")
    with pytest.raises(TypeError):
        R.resolve(cells, "x")
    with pytest.raises(ValueError):
        ST.assert_no_null_keys(cells, ["x"])


def test_controls(spark):
    df = spark.createDataFrame([("DMSO", None), ("a", "negcon"), ("b", "poscon"), (None, None)], "Metadata_Compound string, Metadata_Control_Type string")
    got = [tuple(r) for r in R.annotate_controls(df).collect()]
    assert [g[1] for g in got] == ["negcon", "treatment", "poscon", "treatment"] and [g[2] for g in got] == [True, False, True, False]


def test_clean_and_grouped_statistics(spark):
    df = ST.clean(spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", 9.0), ("a", 5.0), ("b", None)], "g string, x double"), ["x"])
    get = lambda stat, **k: {r["g"]: r["x"] for r in ST.grouped_stat(df, ["g"], ["x"], stat, **k).collect()}
    assert get("median") == {"a": 4.0, "b": None} and get("lower_median")["a"] == 3.0
    assert get("mad")["a"] == 2.0 and get("iqr")["a"] == pytest.approx(3.5) and get("quantile", q=1.0)["a"] == 9.0
    assert get("mean")["b"] is None


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, None, 0.03, 0.2]
    df = spark.createDataFrame(list(enumerate(p)), "i long, pvalue double")
    got = {r["i"]: r["qvalue"] for r in ST.benjamini_hochberg(df, tie=["i"]).collect()}
    assert got == {0: 0.04, 1: pytest.approx(0.16 / 3), 2: None, 3: pytest.approx(0.16 / 3), 4: 0.2}


def test_permutation_pvalue(spark):
    df = spark.createDataFrame([(2.0, [1.0, 2.0, float("nan"), 3.0]), (None, [1.0]), (1.0, [])], "o double, n array<double>")
    assert [r[0] for r in df.select(ST.permutation_pvalue(F.col("o"), F.col("n"))).collect()] == [0.75, None, None]


def test_wells(spark):
    names = ["a1", "B-03", "c 12", "AA/2", "A0", "nope", None, "P24"]
    df = spark.createDataFrame([(n,) for n in names], "w string").withColumn("n", W.normalize_well(F.col("w")))
    got = [(r["n"], r["r"], r["c"], r["again"]) for r in df.select("n", W.well_row(F.col("n")).alias("r"), W.well_col(F.col("n")).alias("c"), W.well_name(W.well_row(F.col("n")), W.well_col(F.col("n"))).alias("again")).collect()]
    assert got[:4] == [("A01", 0, 0, "A01"), ("B03", 1, 2, "B03"), ("C12", 2, 11, "C12"), ("AA02", 26, 1, "AA02")]
    assert [g[0] for g in got[4:7]] == [None] * 3
    sizes = spark.createDataFrame([("H12",), ("P24",)], "Metadata_Well string")
    assert W.detect_plate_format(sizes).first()[0] == 384


def test_feature_names():
    f = W.parse_feature_name("Cytoplasm_Texture_Contrast_ER_3_00_256")
    assert (f.object, f.feature_group, f.measure, f.channel, f.scale, f.angle, f.gray_levels) == ("Cytoplasm", "Texture", "Contrast", "ER", "3", "00", "256")
    assert not W.parse_feature_name("Nuclei_Location_Center_X").is_feature and W.parse_feature_name("emb_1").feature_group is None
    assert W.canonical_channel("DAPI|Foo") == "dna|foo"


def test_qc_flags(spark):
    df = spark.createDataFrame([(i, "P", float(v), 5.0) for i, v in enumerate([10, 11, 9, 10, 500])] + [(9, "P", None, 5.0)], "id long, plate string, a double, b double")
    got = {r["id"]: r for r in Q.calculate_qc_metrics(df, ["a", "b"], ["plate"], area=["a", "b"], max_nan_fraction=0.4).collect()}
    assert got[4]["qc_area_outlier"] and not got[0]["qc_area_outlier"] and got[9]["qc_high_nan"] and got[9]["qc_fail"] and not got[1]["qc_fail"]
    assert Q.filter_cells(df.withColumn("qc_fail", F.col("id") == 4), ["plate"], 5).count() == 5


def test_outlier_flags_take_the_top_and_never_null(spark):
    s = spark.createDataFrame([(i, float(i)) for i in range(10)] + [(10, None)], "id long, outlier_score double")
    assert {r["id"] for r in Q.flag_outliers(s, "id", contamination=0.15).where("is_outlier").collect()} == {8, 9}


def test_isolation_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))] + [(999, 9.0, -9.0)], "id long, a double, b double")
    assert Q.isolation_scores(df, ["a", "b"], "id", 60, 64).orderBy(F.desc("outlier_score")).first()["id"] == 999


def test_correlation_threshold_drops_the_later_on_ties(spark):
    df = spark.range(20).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), (F.col("id") % 3).cast("double").alias("c"))
    got = {r["feature"]: r["keep"] for r in S.correlation_threshold(df, ["a", "b", "c"]).collect()}
    assert got == {"a": True, "b": False, "c": True}
    assert S.correlation_iterative([("a", "b", 0.95), ("b", "c", 0.95), ("a", "c", 0.1)], ["a", "b", "c"]) == ["a", "c"]
    assert S.decorrelate(df, ["a", "b", "c"], 0.99) == ["a", "c"] or S.decorrelate(df, ["a", "b", "c"], 0.99) == ["b", "c"]


def test_chatterjee_sees_dependence(spark):
    df = spark.range(200).select("id", F.floor(F.col("id") / 20).alias("g"), (F.floor(F.col("id") / 20) + F.rand(1) * 0.01).alias("dep"), F.rand(2).alias("ind"))
    got = {r["feature"]: r["xi"] for r in S.grouped_xi(df, "g", ["dep", "ind"], "id").collect()}
    assert got["dep"] > 0.7 and abs(got["ind"]) < 0.3


def test_aggregate_and_consensus(spark):
    df = spark.createDataFrame([("P", "A", "c", 1.0), ("P", "A", "c", 3.0), ("P", "B", None, 5.0)], "plate string, well string, k string, x double")
    got = {r["well"]: tuple(r)[2:] for r in A.aggregate(df, ["x"], ["plate", "well"], min_cells=1, carry=["k"]).collect()}
    assert got == {"A": ("c", 2, 2.0), "B": (None, 1, 5.0)}
    assert A.constant_columns(df, ["plate", "well"], ["k", "x"]) == ["k"] and A.resolution_of(["Metadata_Plate", "Metadata_Well"]) == "well"
    reps = spark.createDataFrame([("g", 1, 1.0, 2.0, 3.0), ("g", 2, 1.0, 2.0, 4.0), ("g", 3, 3.0, 2.0, 1.0), ("h", 1, 1.0, 1.0, 1.0)], "g string, o long, a double, b double, c double")
    r = A.consensus_modz(reps, ["a", "b", "c"], "g", "o", min_replicates=1).orderBy("g").collect()
    assert r[0]["a"] == pytest.approx(0.495 * 2 + 0.0099 * 3, abs=1e-9) and r[1]["b"] == 1.0


def test_average_precision_ranks_positives_first_on_ties(spark):
    rows = [(0, 1, 0.5, True), (0, 2, 0.5, False), (0, 3, 0.4, True), (0, 4, 0.9, False)]
    ap = P.average_precision(spark.createDataFrame(rows, "i long, j long, sim double, positive boolean")).first()
    assert ap["ap"] == pytest.approx((1 / 2 + 2 / 4) / 2) and (ap["n_pos"], ap["n_total"]) == (2, 4)
    null = P.random_average_precisions(1, 2, 20_000, 0)
    assert null.mean() == pytest.approx(0.75, abs=0.01)


def test_similarity_of_zero_and_missing(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, None]), (2, [2.0, 0.0])], "id long, v array<double>")
    got = {(r["i"], r["j"]): r["sim"] for r in P.similarity_pairs(df, "id", "v").collect()}
    assert got == {(0, 1): 0.0, (0, 2): 0.0, (1, 2): 1.0}


def test_effects(spark):
    df = spark.createDataFrame([("c", True, 1.0), ("c", True, 2.0), ("c", True, 3.0), ("t", False, 4.0), ("t", False, 5.0), ("t", False, 6.0)], "g string, ctl boolean, x double").withColumn("id", F.monotonically_increasing_id())
    assert E.cohens_d(df, ["x"], "g", F.col("ctl")).first()["effect"] == pytest.approx(3.0)
    r = E.mann_whitney(df, ["x"], "g", F.col("ctl"), "id").first()
    assert r["u"] == 9.0 and r["pvalue"] == pytest.approx(0.1)
    assert E.wasserstein(df, ["x"], "g", F.col("ctl")).first()["distance"] == pytest.approx(3.0)


def test_hits_are_calibrated_and_powerful(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ctl" if i < 80 else f"g{(i - 80) // 10}", i < 80, *(rng.normal(size=3) + (6 if i >= 160 else 0)).tolist()) for i in range(180)]
    df = spark.createDataFrame(rows, "id long, g string, ctl boolean, a double, b double, c double")
    got = {r["group"]: r for r in E.hit_calling(df, ["a", "b", "c"], "g", F.col("ctl"), "id", n_permutations=200).collect()}
    assert got["g8"]["is_hit"] and got["g9"]["is_hit"]
    assert sum(got[f"g{k}"]["pvalue"] < 0.05 for k in range(8)) <= 2


def test_moderated_t_shrinks(spark):
    s2 = np.array([0.5, 1.0, 2.0, 4.0, 0.1, 8.0])
    post, prior = E.moderate(s2, 3.0)
    assert prior > 0 and post.std() < s2.std()
    flat, inf = E.moderate(np.ones(5), 3.0)
    assert np.isinf(inf) and np.allclose(flat, flat[0])


def test_median_polish_recovers_effects():
    grid = 10 + np.arange(4)[:, None] + 2.0 * np.arange(6)[None, :]
    grid[1, 1] = np.nan
    a, b, level = B.median_polish(grid)
    assert np.allclose(np.diff(a), 1.0) and np.allclose(np.diff(b), 2.0) and np.isfinite(level)


def test_sphering_whitens(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) @ np.array([[2.0, 1.0, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 3.0]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    for method in ("ZCA", "ZCA-cor", "PCA", "PCA-cor"):
        z = B.sphere(df, ["a", "b", "c"], F.lit(True), method, 1e-9).toPandas()[["a", "b", "c"]].to_numpy()
        assert np.allclose(np.cov(z.T), np.eye(3), atol=1e-5)
    with pytest.raises(ValueError):
        B.sphere(df.withColumn("c", F.col("a")), ["a", "b", "c"], F.lit(True))


def test_regress_out_leaves_no_slope(spark):
    df = spark.range(60).select("id", F.lit("P").alias("plate"), F.col("id").cast("double").alias("k"), (F.col("id") * 2.0 + F.rand(3)).alias("x"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("lab"))
    assert abs(B.regress_out_one(df, ["x"], "k", ["plate"]).agg(F.regr_slope("x", "k")).first()[0]) < 1e-9
    assert abs(B.regress_out(df, ["x"], ["k", "lab"], ["plate"]).agg(F.regr_slope("x", "k")).first()[0]) < 1e-6


def test_curve_fit_recovers_parameters():
    x = np.linspace(-2, 2, 25)
    par, r2 = D.fit_curve(x, D.four_parameter(x, 1.0, 9.0, 0.3, 1.5))
    assert r2 > 0.9999 and 10 ** par[2] == pytest.approx(10**0.3, rel=0.02)


def test_clustering():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0]], float)
    z = M.linkage(d)
    assert z[:, 2].tolist() == [1.0, 2.0, 9.0] and M.cut_tree(z, 4, 2).tolist() == [0, 0, 1, 1]
    assert M.silhouette_matrix(d, np.array([0, 0, 1, 1])) > 0.7


def test_robust_covariance_ignores_outliers():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(200, 2)), rng.normal(30, 1, size=(30, 2))])
    loc, cov = M.robust_covariance(x, 0.75)
    assert np.abs(loc).max() < 0.5 and cov[0, 0] < 3


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("P", "a1", 1.0, -999.0), ("P", "B2", float("nan"), 2.0)], "Metadata_Plate string, Metadata_Well string, f double, Nuclei_Location_Center_X double")
    df.toPandas().to_csv(tmp_path / "batch7.csv", index=False)
    out, meta = SRC.read_profiles(spark, [str(tmp_path / "batch7.csv")], path_columns={"Metadata_Batch": r"batch(\d+)"}, sentinels=[-999.0])
    assert meta.features == ("f",) and meta.resolution == "well"
    rows = out.orderBy("Metadata_Well").collect()
    assert [r["Metadata_Well"] for r in rows] == ["A01", "B02"] and rows[1]["f"] is None and rows[0]["Metadata_Batch"] == "7" and rows[1]["Metadata_Row"] == 1
    SRC.write(out, meta, str(tmp_path / "store"))
    again, same = SRC.read(spark, str(tmp_path / "store"))
    assert same == meta and again.count() == 2
    dup = spark.createDataFrame([("A01", "x"), ("A01", "y")], "Metadata_Well string, k string")
    with pytest.raises(ValueError):
        SRC.join_platemap(out, dup)
    with pytest.raises(ValueError):
        SRC.stack([df, df.drop("f")])
    assert SRC.validate(out.unionByName(out), meta).where("level = 'error'").count() == 1


def test_export_directory(spark, tmp_path):
    (tmp_path / "Cells.csv").write_text("ImageNumber,ObjectNumber,AreaShape_Area,Parent_Nuclei\n1,1,10,2\n1,2,20,1\n")
    (tmp_path / "Nuclei.csv").write_text("ImageNumber,ObjectNumber,AreaShape_Area\n1,1,3\n1,2,4\n")
    (tmp_path / "Image.csv").write_text("ImageNumber,Metadata_Plate,Count_Cells\n1,P,2\n")
    rows = SRC.read_export(spark, str(tmp_path), objects=["Nuclei"]).orderBy("ObjectNumber").collect()
    assert [r["Nuclei_AreaShape_Area"] for r in rows] == [4, 3] and rows[0]["Metadata_Plate"] == "P"


def test_streams(spark, tmp_path):
    from platewise.streaming import scoring

    df = spark.createDataFrame([("P", True, 1.0), ("P", True, 3.0), ("P", True, 2.0), ("P", False, 9.0)], "plate string, ctl boolean, x double")
    df.write.parquet(str(tmp_path / "in"))
    fitted = Z.fit(df, ["x"], ["plate"], "ctl")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = scoring.flag_stream(scoring.normalize_stream(stream, fitted, ["x"], ["plate"]), ["x"], 3.0)
    q = out.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from scored where qc_fail").first()[0] == 1


def test_knn_imputation(spark):
    rows = [(0, "P", True, 1.0, 10.0), (1, "P", True, 2.0, 20.0), (2, "P", True, 9.0, 90.0), (3, "P", False, 1.4, None), (4, "P", False, None, None)]
    df = spark.createDataFrame(rows, "id long, plate string, ctl boolean, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in Z.impute(df, ["a", "b"], ["plate"], "ctl", "knn", k=2, row_id="id").collect()}
    assert got[3] == (1.4, 15.0) and got[4] == (4.0, 40.0) and got[0] == (1.0, 10.0)


def test_guide_screens(spark):
    df = spark.createDataFrame([(i, f"g{i // 4}", i < 40, 0.001 if 40 <= i < 44 else (i * 37 % 100 + 0.5) / 100) for i in range(80)], "guide long, gene string, ctl boolean, p double")
    got = {r["gene"]: r for r in E.aggregate_guides(df, "p", "gene", F.col("ctl"), "guide", n_null=2000).collect()}
    assert got["g10"]["is_hit"] and math.isclose(got["g10"]["statistic"], 2 * 3.0902323, rel_tol=1e-6)
    assert sum(r["is_hit"] for r in got.values()) <= 2


def test_correlation_of_constant_tied_and_short_input(spark):
    rows = [("const", 1.0, 2.0), ("const", 1.0, 3.0), ("one", 1.0, 1.0), ("line", 1.0, 2.0), ("line", 2.0, 4.0), ("line", 3.0, 6.0), ("gap", 1.0, None), ("gap", None, 2.0), ("ties", 1.0, 1.0), ("ties", 1.0, 2.0), ("ties", 2.0, 1.0), ("ties", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r["r"] for r in df.groupBy("k").agg(ST.correlation("x", "y").alias("r")).collect()}
    assert got["const"] is None and got["one"] is None and got["gap"] is None
    assert abs(got["line"] - 1.0) < 1e-12 and abs(got["ties"]) < 1e-12
    assert df.where("k = 'none'").agg(ST.correlation("x", "y")).first()[0] is None


def test_correlating_operators_take_constant_features(spark):
    rows = [(i, i % 3, float(i), 7.0, float(i * i % 5), i < 4, 0.0 if i < 4 else float(1 + i % 4)) for i in range(16)]
    df = spark.createDataFrame(rows, "id long, g long, a double, b double, c double, control boolean, dose double").withColumn("compound", F.lit("x"))
    for method in ("pearson", "spearman"):
        got = {(r["feature_a"], r["feature_b"]): r["r"] for r in S.correlated_pairs(df, ["a", "b", "c"], method).collect()}
        assert got["a", "b"] is None and got["b", "c"] is None and got["a", "c"] is not None
    assert {r["feature"]: r["r2"] for r in M.pearson_r2(df, ["a", "b"], "c").collect()}["b"] == 0.0
    assert A.spearman_within(df, "b", "c", ["g"]).where("rho is not null").count() == 0
    assert D.spearman(df, "compound", "dose", "b").first()["rho"] is None
    assert D.dose_features(df, ["a", "c"], "compound", "dose", F.col("control"), 0.1, 2).count() == 2


def test_pseudogene_null_draws_controls_only(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ctl" if i < 120 else f"g{i % 6}", i < 120, i % 40 if i < 120 else 100 + i // 6, *(rng.normal(0.0 if i < 120 or i % 6 else 6.0, 1.0, 3).tolist())) for i in range(180)]
    df = spark.createDataFrame(rows, "id long, grp string, control boolean, unit long, a double, b double, c double")
    got = {r["group"]: r for r in E.hit_calling(df, ["a", "b", "c"], "grp", F.col("control"), "id", n_permutations=199, replicate="unit", null="pseudogenes", n_pseudogenes=30).collect()}
    assert got["g0"]["pvalue"] == 0.005 and got["g0"]["is_hit"]
    assert sum(got[f"g{k}"]["pvalue"] > 0.05 for k in range(1, 6)) >= 3
    fake = [r["pvalue"] for k, r in got.items() if k.startswith("pseudogene_")]
    assert len(fake) == 30 and 0.3 < np.mean(fake) < 0.75
    few = E.hit_calling(df.withColumn("unit", F.when(F.col("control"), F.col("unit") % 4).otherwise(F.col("unit"))), ["a", "b", "c"], "grp", F.col("control"), "id", n_permutations=9, replicate="unit", null="pseudogenes")
    assert few.where("pvalue is not null").count() == 0  # more units than controls have


def test_stamp_and_resource_files(spark, tmp_path):
    df = spark.createDataFrame([("P", "A01", 1.0)], "Metadata_Plate string, Metadata_Well string, Cells_AreaShape_Area double")
    meta = SRC.stamp(df, "well", grouped_by=["Metadata_Plate"])
    assert meta.features == ("Cells_AreaShape_Area",) and meta.grouped_by == ("Metadata_Plate",)
    with pytest.raises(ValueError):
        SRC.stamp(df, "well", grouped_by=["nothing"])
    (tmp_path / "e.tsv").write_text("A\tB\nx\ty\ny\tx\nz\tz\n\tq\n")
    assert [tuple(r) for r in SRC.read_edges(spark, str(tmp_path / "e.tsv"), "A", "B").collect()] == [("x", "y")]
    (tmp_path / "c.tsv").write_text("name\tgenes\nC1\ta; b;\nC1\ta\n")
    assert sorted(tuple(r) for r in SRC.read_complexes(spark, str(tmp_path / "c.tsv"), "name", "genes").collect()) == [("C1", "a", 1.0), ("C1", "b", 1.0)]


def test_clusters_by_stability(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[9, 0, 0, 0], [0, 9, 0, 0], [0, 0, 9, 0]], float)
    rows = [(f"n{i:02d}", *(centres[i % 3] + rng.normal(0, 0.3, 4)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "name string, a double, b double, c double, d double")
    for criterion in ("stability", "silhouette"):
        got = {r["name"]: r["cluster"] for r in M.cluster(df, "name", list("abcd"), criterion=criterion)[0].collect()}
        assert len(set(got.values())) == 3 and all(len({got[f"n{i:02d}"] for i in range(k, 30, 3)}) == 1 for k in range(3))
    assert M.adjusted_rand(np.array([0, 0, 1, 1]), np.array([5, 5, 2, 2])) == 1.0
    assert abs(M.adjusted_rand(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])) + 0.5) < 1e-12
    with pytest.raises(ValueError):
        M.cluster(df, "name", list("abcd"), criterion="other")
