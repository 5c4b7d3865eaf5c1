"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches, largest ids first. A batch's line hashes are merge-anti-joined with the runs so
far: a hash that no run holds becomes an entry of the batch's own run, sorted by hash, with its number of rows; for one
that a run holds the batch only says how often it was seen again. So every hash has one entry in all
runs. When a level has ``FANOUT`` runs they are compacted into one run of the next level. A hash lies in enough
rows if its entry tells so by itself, or together with what was seen again. Those few lines are then taken
again and grouped by their whole keys, so a hash collision cannot drop a line.

Defined cases: null or empty text is one empty line; each row counts as one document, also when an
id is repeated; all rows with the largest id that holds a line keep it; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, documents, scratch, text_of

BATCHES, BATCH_ROWS, FANOUT, MIN_CHARS, MIN_DOCS = 3, 1 << 30, 2, 20, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class LevelledRuns:
    """Sorted runs of entries (hash, n); level i holds compacted runs of level i - 1. Beside them, what was seen again."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels, self.again = fanout, [[]], []

    def held(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def union(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for other in runs[1:]:
            both = both.unionAll(other)
        return both

    def add(self, batch: DataFrame) -> None:
        """Takes in a batch (hash, a row for each time): hashes new to the runs as entries, others as seen again."""
        run = batch.groupBy("hash").agg(F.count("*").alias("n"))
        if self.held():
            known = self.union(self.held()).select("hash", F.lit(True).alias("old"))
            met = scratch(run.join(known.hint("merge"), "hash", "left").sortWithinPartitions("hash"), "run")
            self.again.append(met.filter("old").select("hash", "n"))
            run = met.filter("old IS NULL").select("hash", "n")
        else:
            run = scratch(run.sortWithinPartitions("hash"), "run")
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = scratch(self.union(self.levels[level]).repartition("hash").sortWithinPartitions("hash"), "run")
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)

    def repeated(self, least: int) -> DataFrame:
        """Hashes that came ``least`` times at least."""
        entries = self.union(self.held())
        often = entries.filter(F.col("n") >= least).select("hash")
        if not self.again:
            return often
        again = self.union(self.again).groupBy("hash").agg(F.sum("n").alias("more"))
        return often.unionAll(entries.filter(F.col("n") < least).join(again, "hash").filter(F.col("n") + F.col("more") >= least).select("hash"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the distinct trimmed lines long enough to count."""
    long_enough = F.filter(F.transform(F.split(text_of(text_col), "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: F.length(x) >= MIN_CHARS)
    return docs.select(F.col(id_col).alias("doc_id"), F.array_distinct(long_enough).alias("lines"))


def repeated_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes of lines that lie in ``min_docs`` rows at least, by way of the levelled runs; more batches for more than ``BATCH_ROWS`` rows each."""
    batches = max(batches, -(-docs.count() // BATCH_ROWS))
    hashes = _lines(docs, id_col, text_col).select("doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(F.lower(x))))).alias("hash"))
    cuts = docs.select(F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    runs, cuts = LevelledRuns(), sorted(set(cuts), reverse=True)
    for i in range(len(cuts) + 1):
        lies = F.lit(True)
        if i < len(cuts):
            lies = F.col("doc_id") > cuts[i]
        if i:
            lies = lies & (F.col("doc_id") <= cuts[i - 1])
        if i == len(cuts):
            lies = lies | F.col("doc_id").isNull()
        runs.add(hashes.filter(lies))
    return runs.repeated(min_docs)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text."""
    suspects = repeated_hashes(docs, id_col, text_col, batches, min_docs)
    lines = _lines(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode("lines").alias("line"))
    lines = lines.withColumn("hash", F.xxhash64(F.lower("line"))).join(suspects, "hash", "left_semi")
    lines = scratch(lines.select("doc_id", "row", F.translate("line", UPPER, LOWER).alias("key")).dropDuplicates(["row", "key"]), "lines")
    keepers = lines.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
    later = F.col("keeper").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    drops = lines.join(keepers, "key").filter(later).groupBy("doc_id").agg(F.collect_set("key").alias("drops")).withColumnRenamed("doc_id", "drop_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    rows = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left").withColumn("all_lines", F.split("t", "\n"))
    rows = rows.withColumn("kept", F.when(F.col("drops").isNull(), F.col("all_lines")).otherwise(F.filter("all_lines", lambda x: ~F.array_contains("drops", line_key(x)))))
    return rows.select(
        "doc_id",
        F.size("all_lines").cast("long").alias("n_lines"),
        (F.size("all_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, u.i AS i, u.line AS line,
         translate(trim(u.line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, j: {'line': x, 'i': j})) AS u FROM documents)
),
h AS (SELECT k, max(doc_id) AS keeper FROM (SELECT DISTINCT k, doc_id FROM l WHERE length(k) >= 20) GROUP BY k HAVING count(*) >= 3),
m AS (SELECT l.*, h.keeper IS NOT NULL AND l.doc_id < h.keeper AS gone FROM l LEFT JOIN h USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
