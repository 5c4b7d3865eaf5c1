"""Exact dedup by skew-safe combining.

Three combining stages: every task first merges its own rows (Spark's partial aggregation), then the
groups meet under (salt, digest, text), then the salts' winners meet under (digest, text). Whole texts
are grouping keys in each stage, so equality of content, not of digests, decides. A group that holds
a third of all rows reaches a reducer as one row per map task and salt.

Defined cases: null text is the empty text; null ids never win against an id; rows repeated with
id and text count in ``group_size`` and share ``kept``; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of

SALTS = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).select(
        "doc_id", "t", F.sha2("t", 256).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    )
    salted = rows.groupBy("salt", "digest", "t").agg(F.max("doc_id").alias("best"), F.count("*").alias("n"))
    whole = salted.groupBy("digest", "t").agg(
        F.max("best").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"),
    )
    # Only groups of several rows go back to their members, one row for each salt in use.
    shared = (
        whole.filter("group_size > 1")
        .select("digest", F.xxhash64("t").alias("h"), "keep_id", "group_size", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(salts, s) & 1L) = 1L)")).alias("salt"))
    )
    members = rows.select("doc_id", "digest", F.xxhash64("t").alias("h"), "salt")
    joined = members.join(shared, ["salt", "digest", "h"], "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
