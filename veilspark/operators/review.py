"""Review: decisions on matches, batch toggles, counters and retained risks.

Matches stay nested in their document's row. Decisions are nested to one row per document, so one join
on doc_id serves; match ids are looked up inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def _lookup(key: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def batch_group(category: Column) -> Column:
    return _lookup(category, {c: g for g, cats in fixed.BATCH_GROUPS.items() for c in cats})


def label(category: Column) -> Column:
    return _lookup(category, {c: v[0] for c, v in fixed.CATEGORIES.items()})


def risk(category: Column) -> Column:
    return _lookup(category, {c: v[2] for c, v in fixed.CATEGORIES.items()})


def category_order(category: Column) -> Column:
    return _lookup(category, {c: i for i, c in enumerate(fixed.CATEGORIES)})


def with_decisions(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Applies decisions (doc_id, match_id, selected, placeholder and, if there is one, decided_at); an empty placeholder becomes the deleted token.

    Of several decisions on one match the last selection and the last placeholder count, each for itself (a null decides nothing); of
    decisions of one time, or without a time, the greatest. Decisions without a match id or document are left out.
    """
    named = decisions.filter("doc_id IS NOT NULL AND match_id IS NOT NULL")
    at = F.col("decided_at") if "decided_at" in decisions.columns else F.lit(None).cast("timestamp")
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v"))))["v"].alias(c)
    nested = named.groupBy("doc_id", "match_id").agg(last("selected"), last("placeholder")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("match_id", F.struct("selected", "placeholder").alias("d")))).alias("__decided"))

    def decided(m):
        d = F.try_element_at("__decided", m["match_id"])
        shown = F.when(d["placeholder"] == "", fixed.DELETED).otherwise(d["placeholder"])
        return m.withField("selected", F.coalesce(d["selected"], m["selected"])).withField("placeholder", F.coalesce(shown, m["placeholder"]))

    return docs.join(nested, "doc_id", "left").withColumn("matches", F.transform("matches", decided)).drop("__decided")


def batch_toggled(docs: DataFrame, group: str) -> DataFrame:
    """Selects all of a group if all of it is kept, else keeps all of it."""
    inside = lambda m: m["category"].isin(*fixed.BATCH_GROUPS[group])
    all_kept = F.forall(F.filter("matches", inside), lambda m: ~m["selected"])
    return docs.withColumn("matches", F.transform("matches", lambda m: m.withField("selected", F.when(inside(m), all_kept).otherwise(m["selected"]))))


def all_selected(docs: DataFrame) -> DataFrame:
    return docs.withColumn("matches", F.transform("matches", lambda m: m.withField("selected", F.lit(True))))


def batch_counters(docs: DataFrame) -> DataFrame:
    """doc_id, batch_group, total, kept, all_kept: three rows for each document."""
    groups = F.array(*[F.struct(F.lit(g).alias("g"), F.array(*map(F.lit, cats)).alias("cats")) for g, cats in fixed.BATCH_GROUPS.items()])
    rows = docs.select("doc_id", "matches", F.explode(groups).alias("x"))
    mine = F.filter("matches", lambda m: F.array_contains(F.col("x.cats"), m["category"]))
    total, kept = F.size(mine).cast("long"), F.size(F.filter(mine, lambda m: ~m["selected"])).cast("long")
    return rows.select("doc_id", F.col("x.g").alias("batch_group"), total.alias("total"), kept.alias("kept"), ((total > 0) & (kept == total)).alias("all_kept"))


def n_high_risk_kept(matches: Column) -> Column:
    return F.size(F.filter(matches, lambda m: ~m["selected"] & (risk(m["category"]) == "high"))).cast("long")


def high_risk_kept(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", n_high_risk_kept(F.col("matches")).alias("high_risk_kept"))


def match_rows(docs: DataFrame) -> DataFrame:
    """One row per match with its 1-based place in the document."""
    return docs.select("doc_id", F.posexplode("matches").alias("__i", "m")).select("doc_id", (F.col("__i") + 1).alias("ordinal"), "m.*")
