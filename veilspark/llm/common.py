"""What the operators share: the scratch folder, document access and registration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that part words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on a local master, where none is named, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Few rows that stand for much work, dealt to as many tasks as shuffles have; small partitions are not merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def text_of(column: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column):
    """Number of words ``[^\\x20\\x09-\\x0D]+``: of the blank-normalised text, one more than its single blanks."""
    flat = F.btrim(column, F.lit(BLANKS))
    return F.when(F.length(flat) == 0, F.lit(0)).otherwise(F.size(F.split(flat, WORD_GAP))).cast("long")


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_slices(batches, column: int = -1, most: int = 4 << 20):
    """Record batches cut so that the texts of each hold about ``most`` bytes: bounds what a worker holds."""
    for batch in batches:
        sizes = batch.column(column % batch.num_columns).cast("binary").to_pylist()
        start = held = 0
        for i, text in enumerate(sizes):
            if held and held + len(text) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += len(text)
        if batch.num_rows > start:
            yield batch.slice(start)
