"""Queries without SQL read their whole tables."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

import __spark_entry__
from platewise.operators import pairs as P
from platewise.plans import data as T

SF = "/root/testdata/sf0.01"


def _query(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


def test_impute_knn_fills_every_cell(spark):
    got = _query(spark, "impute_knn").agg(F.count(F.lit(1)), F.count("q")).first()
    assert tuple(got) == (T.cells(spark, SF).count(),) * 2


def test_bootstrap_features_has_every_guide(spark):
    guides = T.cells(spark, SF).where("not control").select("supp").distinct().count()
    assert _query(spark, "bootstrap_features").agg(F.sum("n_guides")).first()[0] == guides > 24


def test_dendrogram_has_every_profile(spark):
    assert _query(spark, "pl_dendrogram").count() == T.wells(spark, SF).select("well", "pert").distinct().count() - 1 > 59


def test_moa_enrichment_plot_has_every_row(spark):
    assert _query(spark, "pl_moa_enrichment").count() == T.embedded(spark, SF).count() > 20


def test_map_permutation_scores_are_of_the_whole_table(spark):
    e = T.embedded(spark, SF)
    p = P.similarity_pairs(e, "vec_id", "v", keep=["label"], ordered=True)
    ap = P.average_precision(P.map_pairs(p, ["label"], [], [], ["label"]))
    want = {r["label"]: r["score"] for r in P.map_scores(ap, e.select(F.col("vec_id").alias("i"), "label"), "label").collect()}
    got = {r["label"]: r["score"] for r in _query(spark, "map_permutation_pvalues").collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_map_permutation_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    n, n_permutations = 14, 9
    label = {i: None if i == 5 else int(rng.integers(0, 3)) for i in range(n)}
    sims = {(i, j): float(rng.integers(0, 4)) / 4 for i in range(n) for j in range(n) if i != j}  # many are equal
    schema = StructType([StructField("i", LongType()), StructField("label", LongType())])
    labels = spark.createDataFrame(list(label.items()), schema)
    pairs = spark.createDataFrame([(i, j, s) for (i, j), s in sims.items()], "i long, j long, sim double")
    h = spark.range(n_permutations).selectExpr("id as d").crossJoin(spark.range(n).selectExpr("id as i")).select("d", "i", F.xxhash64(F.lit(0), "d", "i").alias("h")).collect()
    dealt = [label]
    for d in range(n_permutations):
        order = [r["i"] for r in sorted((r for r in h if r["d"] == d), key=lambda r: (r["h"], r["i"]))]
        dealt.append({to: label[k] for k, to in enumerate(order)})
    scores = []
    for of in dealt:
        by = {}
        for i in range(n):
            row = sorted((j for j in range(n) if j != i), key=lambda j: (-sims[i, j], of[i] is None or of[i] != of[j], j))
            ranks = [r for r, j in enumerate(row, 1) if of[i] is not None and of[i] == of[j]]
            if ranks:
                by.setdefault(of[i], []).append(np.mean([k / r for k, r in enumerate(ranks, 1)]))
        scores.append({k: np.mean(v) for k, v in by.items()})
    got = {r["label"]: (r["score"], r["pvalue"]) for r in P.map_permutation_pvalues(pairs, labels, "label", n_permutations).collect()}
    assert got.keys() == scores[0].keys()
    for k, s in scores[0].items():
        null = [x[k] for x in scores[1:] if k in x]
        assert np.isclose(got[k][0], s) and np.isclose(got[k][1], (sum(x >= s - 1e-12 for x in null) + 1) / (len(null) + 1))


def test_write_replaces_whole_and_keeps_old_data_on_failure(spark, tmp_path):
    from pyspark.sql import functions as F

    from platewise.sources import profiles as SRC

    path = f"file:{tmp_path}/p"
    meta = SRC.ProfileMeta("well", ("Cells_x",))
    rows = spark.createDataFrame([("P1", "A01", 1.0), ("P1", "A02", 2.0)], "Metadata_Plate string, Metadata_Well string, Cells_x double")
    SRC.write(rows, meta, path)
    again, _ = SRC.read(spark, path)
    SRC.write(again.withColumn("Cells_x", F.col("Cells_x") * 10), meta, path)  # reads what it replaces
    assert sorted(r["Cells_x"] for r in SRC.read(spark, path)[0].collect()) == [10.0, 20.0]
    broken = again.withColumn("Cells_x", F.raise_error(F.lit("no")).cast("double"))
    try:
        SRC.write(broken, meta, path)
        raise AssertionError("a broken table was written")
    except AssertionError:
        raise
    except Exception:
        pass
    assert sorted(r["Cells_x"] for r in SRC.read(spark, path)[0].collect()) == [10.0, 20.0]
