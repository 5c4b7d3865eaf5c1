"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns what goes on, with the columns of docs; the last
returns packed pieces. ``run`` writes each stage's rows as Parquet and reads them as the next one's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.common import documents, scratch
from veilspark.llm.exact_dedup import exact_dedup
from veilspark.llm.minhash_dedup import near_groups
from veilspark.llm.mixing import mixed_documents
from veilspark.llm.packing import packed_documents
from veilspark.llm.toxicity import learn, score

SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted field scores 0.5 or more go."""
    field = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("text"))
    return score(rows, field, ["row"]).filter(F.col("score") < 0.5).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; of its repeated rows one."""
    key, digest = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("__digest")
    stays = exact_dedup(docs).filter("kept").select(key, F.col("text_sha256").alias("__digest")).dropDuplicates()
    kept = docs.select("*", key, digest).join(stays, ["__key", "__digest"], "left_semi")
    one = F.row_number().over(Window.partitionBy("__key", "__digest").orderBy(F.lit(0)))
    return kept.withColumn("__nth", one).filter("__nth = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles) the smallest id stays; of its texts in the group the one with the least digest."""
    keyed = docs.withColumn("__digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    groups = scratch(near_groups(keyed, k=SHINGLE, more=("__digest",)).filter("label IS NOT NULL").select("label", F.col("doc_id").alias("__id"), F.col("__digest").alias("__text")), "groups")
    stays = groups.groupBy("label").agg(F.min(F.struct("__id", "__text")).alias("stays"))
    gone = groups.join(stays, "label").filter(F.struct("__id", "__text") != F.col("stays")).select("__id", "__text")
    # Rows with null ids belong to no group, so no null has to be met.
    return keyed.join(gone, (keyed["doc_id"].cast("long") == gone["__id"]) & (keyed["__digest"] == gone["__text"]), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: a row for each document and round of the mix."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of at most 1024 ids."""
    return packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

# The fitted field and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
