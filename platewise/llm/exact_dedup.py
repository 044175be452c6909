"""Exact deduplication by salted combining of equal texts.

1. Local: Spark's partial aggregation on (digest, text, salt) leaves one row per distinct text and task.
2. Salted: the rows of a text meet in one of `salts` groups, chosen by the task that read them, so that a text held by
   a third of all rows never meets in one task.
3. Global: at most `salts` winners of each text are combined.

The text itself is a grouping key of every stage, so two texts that share a digest stay apart. Each row is then
given its group by its digest; digests that several texts share (never seen with SHA-256) are told apart by the text.

Defined results: null counts as the empty text; ties of the id column (repeated rows) count each row; a null id is the
smallest: a group of null ids alone has a null keep_id and all its rows are kept, as no id tells them apart; an empty
table gives an empty result; other columns are ignored. `distinct_texts` returns exactly one row per text whatever the
ids are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import materialize


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def groups(rows: DataFrame, salts: int = 16) -> DataFrame:
    """(digest, text, keep_id, group_size) of rows (doc_id, text, digest): the largest id of every distinct text stays."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = salted.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return winners.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, salts: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for every row.

    `digest` maps a text column to a binary column; any function is right, a better one only spares comparisons.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    found = groups(rows, salts)
    shared = found.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    shared = materialize(shared)
    ids = rows.select("doc_id", "digest")
    clash = shared.where("texts > 1").select("digest")
    if clash.isEmpty():
        out = ids.join(shared.drop("texts"), "digest")
    else:
        one = ids.join(shared.where("texts = 1").drop("texts"), "digest")
        wide = rows.join(clash, "digest", "left_semi")
        told = wide.join(groups(wide, salts), ["digest", "text"]).select("digest", "doc_id", "keep_id", "group_size")
        out = one.select("digest", "doc_id", "keep_id", "group_size").unionByName(told)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, salts: int = 16) -> DataFrame:
    """The row with the largest id of every distinct text, with all its columns; repeated ids lose nothing.

    The same three steps; whole rows travel with their texts, so no join by id follows. Of rows with equal text and id
    the larger hash of all columns stays.
    """
    cols = docs.columns
    key = F.coalesce(docs[text_col], F.lit(""))
    order = F.struct(F.col(id_col).cast("long"), F.xxhash64(*cols))
    rows = docs.select(digest(key).alias("__digest"), key.alias("__text"), F.struct(*[c for c in cols if c != text_col], F.col(text_col).isNull().alias("__null")).alias("__row"), order.alias("__order"))
    rows = rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    best = [F.max_by("__row", "__order").alias("__row"), F.max("__order").alias("__order")]
    found = rows.groupBy("__digest", "__text", "__salt").agg(*best).groupBy("__digest", "__text").agg(*best)
    return found.select(*[F.when(~F.col("__row.__null"), F.col("__text")).alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in cols])
