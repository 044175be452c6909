"""The driver's tables seen as profiles, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["q", "p", "d", "t"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0 made 0), so that engines that sum in another order agree."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as cells: plate by line number, well by supplier, treatment by return flag (N is the control)."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("plate"),
        F.concat(F.char(65 + F.col("l_suppkey") % 8), F.lpad((F.col("l_suppkey") % 12 + 1).cast("string"), 2, "0")).alias("well"),
        F.col("l_returnflag").alias("pert"), (F.col("l_returnflag") == "N").alias("control"), F.col("l_linestatus").alias("moa"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.when(F.col("l_orderkey") % 17 != 0, F.col("l_quantity")).alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
    )


CELLS = """
SELECT l_orderkey * 10 + l_linenumber AS row_id, 'P' || l_linenumber AS plate,
       chr(CAST(65 + l_suppkey % 8 AS INTEGER)) || lpad(CAST(l_suppkey % 12 + 1 AS VARCHAR), 2, '0') AS well,
       l_returnflag AS pert, l_returnflag = 'N' AS control, l_linestatus AS moa, l_partkey AS part, l_suppkey AS supp,
       CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity END AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t
FROM lineitem
"""


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median profile of each plate, well and treatment, with its number of cells."""
    g = cells(spark, sf_dir).groupBy("plate", "well", "pert", "control")
    out = g.agg(F.count(F.lit(1)).alias("n"), *[F.median(f).alias(f) for f in FEATURES])
    return out.withColumn("id", F.concat_ws("_", "plate", "well", "pert"))


WELLS = f"""
SELECT plate, well, pert, control, count(*) AS n, median(q) AS q, median(p) AS p, median(d) AS d, median(t) AS t,
       plate || '_' || well || '_' || pert AS id
FROM ({CELLS}) GROUP BY plate, well, pert, control
"""


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as profiles: label is treatment and mechanism, 0 the control, batch by id."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), (F.col("vec_id") % 5).cast("long").alias("batch"), (F.col("label") == 0).alias("control"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


EMBEDDED = """
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label, CAST(vec_id % 5 AS BIGINT) AS batch, label = 0 AS control,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
FROM embeddings
"""

PAIRS = f"""
WITH e AS ({EMBEDDED}), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS nn FROM e),
u AS (SELECT vec_id, label, batch, control, list_transform(v, lambda x: CASE WHEN nn > 0 THEN x / nn ELSE 0 END) AS u FROM n),
pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS label_i, b.label AS label_j, a.batch AS batch_i, b.batch AS batch_j,
                 a.control AS control_i, b.control AS control_j, round(list_dot_product(a.u, b.u), 6) AS sim
          FROM u a JOIN u b ON a.vec_id <> b.vec_id)
"""


def doses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a dose series: compound by brand, dose by size (sizes of a multiple of 10 are controls), two features."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("compound"), (F.col("p_size") % 10).cast("double").alias("dose"), (F.col("p_size") % 10 == 0).alias("control"),
        (F.col("p_retailprice") / 100.0).alias("f1"), (F.col("p_retailprice") % 17 + F.col("p_size") % 10).alias("f2"), (F.col("p_partkey") % 7).cast("double").alias("f3"), (F.col("p_partkey") % 2 == 0).alias("half"),
    )


DOSES = """
SELECT p_partkey AS row_id, p_brand AS compound, CAST(p_size % 10 AS DOUBLE) AS dose, p_size % 10 = 0 AS control,
       p_retailprice / 100.0 AS f1, p_retailprice % 17 + p_size % 10 AS f2, CAST(p_partkey % 7 AS DOUBLE) AS f3, p_partkey % 2 = 0 AS half
FROM part
"""

DOSE_FEATURES = ["f1", "f2", "f3"]


def guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as guides: gene by nation, p and z from keys, cells from the balance."""
    c = read(spark, sf_dir, "customer")
    p = ((F.col("c_custkey") * 7919) % 10_007 + 1) / F.lit(10_009.0)
    return c.select(F.col("c_custkey").alias("guide"), F.col("c_nationkey").cast("long").alias("gene"), F.when(F.col("c_custkey") % 13 != 0, p).alias("pvalue"), ((F.col("c_custkey") * 31 % 400).cast("double") / 100.0 - 2.0).alias("z"), (F.col("c_custkey") % 40 + 1).cast("long").alias("cells"), (F.col("c_nationkey") == 0).alias("control"))


GUIDES = """
SELECT c_custkey AS guide, CAST(c_nationkey AS BIGINT) AS gene,
       CASE WHEN c_custkey % 13 <> 0 THEN ((c_custkey * 7919) % 10007 + 1) / CAST(10009.0 AS DOUBLE) END AS pvalue,
       CAST(c_custkey * 31 % 400 AS DOUBLE) / CAST(100.0 AS DOUBLE) - CAST(2.0 AS DOUBLE) AS z, CAST(c_custkey % 40 + 1 AS BIGINT) AS cells,
       c_nationkey = 0 AS control
FROM customer
"""


def populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as cells in clusters: cluster by event type, well by user, treatment by user, replicate by event."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("cluster"), F.col("user_id").cast("long").alias("user"), (F.col("user_id") % 6).cast("long").alias("grp"), (F.col("user_id") % 6 == 0).alias("control"), (F.col("event_id") % 3).cast("long").alias("block"), F.col("value"), (F.col("event_id") % 2 == 0).alias("half"))


POPULATIONS = """
SELECT event_id AS row_id, event_type AS cluster, CAST(user_id AS BIGINT) AS "user", CAST(user_id % 6 AS BIGINT) AS grp, user_id % 6 = 0 AS control,
       CAST(event_id % 3 AS BIGINT) AS block, value, event_id % 2 = 0 AS half
FROM events
"""
