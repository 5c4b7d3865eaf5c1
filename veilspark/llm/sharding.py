"""Sharding by extendible hashing.

A row's hash is taken from its id and text. The directory is addressed by the first bits of the
hash. It starts with one bucket; only buckets over the byte limit are split on another bit, until
each fits. One pass sums the bytes under all prefixes of the next ``STEP`` bits of the oversized
buckets, so a pass settles ``STEP`` splits at once and later passes touch oversized buckets only.

Defined cases: null text has 0 bytes; rows that agree in id and text have the same hash and can't be
parted, and neither can a single row over the limit: such buckets end with ``fits`` false; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of

STEP, BITS, LIMIT = 12, 60, 16 * 1024 * 1024


def _prefix(n):
    """The first n of the BITS hash bits, as a number."""
    return F.expr(f"shiftright(hash, {BITS} - ({n}))") if isinstance(n, int) else F.expr(f"shiftright(hash, {BITS} - {n})")


def extendible_shards(docs: DataFrame, limit_bytes: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, depth, shard (its prefix as bits), shard_bytes, shard_rows, fits."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
        F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text_col).cast("binary"))).cast("binary")), 1, BITS // 4), 16, 10).cast("long").alias("hash"),
    )
    open_rows, done, depth = rows, None, 0
    while True:
        far = min(depth + STEP, BITS)
        fine = open_rows.groupBy(_prefix(far).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("r"))
        # Each fine prefix counts for all its own prefixes, from this pass's depth on.
        every = fine.select("fine", "b", "r", F.explode(F.sequence(F.lit(depth), F.lit(far))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(fine, {far} - depth)"))
        sums = every.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit_bytes) | ((F.col("depth") == BITS) if far == BITS else F.lit(False))
        found = every.select("fine", "depth", "prefix").join(sums.filter(fits), ["depth", "prefix"])
        # The shallowest prefix that fits is the bucket.
        directory = found.groupBy("fine").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("at"))
        placed = open_rows.withColumn("fine", _prefix(far)).join(directory, "fine", "left")
        here = placed.filter(F.col("at").isNotNull()).select("doc_id", "n_bytes", "at.*")
        done = here if done is None else done.unionAll(here)
        if far == BITS or sums.filter((F.col("depth") == far) & (F.col("shard_bytes") > limit_bytes) & (F.col("shard_rows") > 0)).isEmpty():
            break
        open_rows, depth = placed.filter(F.col("at").isNull()).select("doc_id", "n_bytes", "hash"), far
    bits = F.expr(f"substring(lpad(conv(prefix, 10, 2), {BITS}, '0'), {BITS + 1} - depth, depth)")
    return done.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), bits.alias("shard"), "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit_bytes).alias("fits"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(documents(spark, sf_dir))


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, {BITS // 4}))::BIGINT AS h
  FROM documents),
e AS (SELECT *, depth, h >> ({BITS} - depth) AS prefix FROM d, range(0, {BITS + 1}) AS r(depth)),
s AS (SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM e GROUP BY ALL),
p AS (SELECT e.doc_id, e.n_bytes, e.h, min(e.depth) AS depth FROM e JOIN s USING (depth, prefix)
      WHERE shard_bytes <= {LIMIT} OR depth = {BITS} GROUP BY ALL)
SELECT p.doc_id, p.n_bytes, p.depth::INTEGER AS depth,
       substr(lpad(to_binary(h >> ({BITS} - p.depth)), {BITS}, '0'), {BITS + 1} - p.depth, p.depth) AS shard,
       shard_bytes, shard_rows, shard_bytes <= {LIMIT} AS fits
FROM p JOIN s ON s.depth = p.depth AND s.prefix = p.h >> ({BITS} - p.depth)
"""
