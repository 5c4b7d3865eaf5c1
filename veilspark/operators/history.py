"""Run history: recording, validation, newest per id, cap per client, deletion and totals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .review import category_order

RECORD = "client_id long, id string, created_at timestamp, version string, counts array<struct<category:string,replaced:double,kept:double>>"


def run_counts(matches: DataFrame) -> DataFrame:
    """doc_id, counts: present categories in dictionary order with replaced and kept."""
    each = matches.groupBy("doc_id", "category").agg(F.count_if("selected").alias("replaced"), F.count_if(~F.col("selected")).alias("kept"))
    rows = F.array_sort(F.collect_list(F.struct(category_order(F.col("category")).alias("o"), F.struct("category", "replaced", "kept").alias("c"))))
    return each.groupBy("doc_id").agg(F.transform(rows, lambda x: x["c"]).alias("counts"))


def new_run_id(*keys: Column, seed: str | None = None) -> Column:
    """Run ids, one for each value of ``keys``, drawn once: the job draws a seed when the plan is made, and a row's id follows from it and the row's keys.

    So a task that runs again, and a record and a report that are made from the same rows, have the same ids.
    """
    drawn = F.lit(uuid.uuid4().hex if seed is None else seed)
    h = F.sha2(F.concat_ws("\x1f", drawn, *[F.coalesce(k.cast("string"), F.lit("\x1e")) for k in keys]), 256)
    return F.concat(F.lit("JQ-"), F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def well_formed() -> Column:
    """Whether a record's id and version have the asked form."""
    return F.col("id").rlike(fixed.RUN_ID) & F.col("version").rlike(fixed.VERSION)


def valid(records: DataFrame, now: Column) -> DataFrame:
    recent = (F.col("created_at") > now - F.expr(f"INTERVAL {fixed.HISTORY_DAYS} DAYS")) & (F.col("created_at") <= now)
    return records.filter(well_formed() & recent & F.col("counts").isNotNull())


def clean_counts(counts: Column) -> Column:
    """For each known category, in order, its first entry if that is valid."""
    first = F.transform(F.array(*map(F.lit, fixed.CATEGORIES)), lambda c: F.get(F.filter(counts, lambda x: x["category"] == c), F.lit(0)))
    good = lambda n: (n >= 0) & (n <= fixed.SAFE_INTEGER) & (n == F.floor(n))
    kept = F.filter(first, lambda x: x.isNotNull() & F.coalesce(good(x["replaced"]) & good(x["kept"]), F.lit(False)))
    return F.transform(kept, lambda x: F.struct(x["category"].alias("category"), x["replaced"].cast("long").alias("replaced"), x["kept"].cast("long").alias("kept")))


def cleaned(records: DataFrame, now: Column, most: int = fixed.HISTORY_MOST) -> DataFrame:
    """Valid records, the newest of each id, the newest ``most`` of each client; ties by ``pos``.

    The newest of an id is a grouped minimum, combined before the shuffle; of a client's records each task sends
    ``most`` at most to the task that ranks them.
    """
    good = valid(records, now)
    newest = good.groupBy("client_id", "id").agg(F.min(F.struct((-F.unix_micros("created_at")).alias("__age"), "pos", F.struct(*good.columns).alias("__row"))).alias("__first"))
    top = Window.partitionBy("client_id").orderBy(F.desc("created_at"), "pos")
    one = newest.select("__first.__row.*").withColumn("__r", F.row_number().over(top)).filter(F.col("__r") <= most)
    return one.drop("__r").withColumn("counts", clean_counts(F.col("counts")))


def deleted(records: DataFrame, tombstones: DataFrame, opted_in: DataFrame | None = None) -> DataFrame:
    """Without deleted runs (client_id, id; a null id clears the client) and clients that opted out."""
    left = records.join(tombstones.filter("id IS NOT NULL").select("client_id", "id"), ["client_id", "id"], "left_anti").join(tombstones.filter("id IS NULL").select("client_id"), "client_id", "left_anti")
    return left if opted_in is None else left.join(opted_in.select("client_id"), "client_id", "left_semi")


def totals(counts: Column) -> tuple[Column, Column]:
    total = lambda field: F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x[field])
    return total("replaced"), total("kept")
