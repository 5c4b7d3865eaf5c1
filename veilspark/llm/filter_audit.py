"""Filter interaction audit: what a chain of filters does in every order, and each filter's fair share of it.

Five filters are five bits of a document. Documents are counted by part and by bits, at most 32 rows a part; everything
after that is arithmetic on these counts. The removal game of a part gives each of the 32 coalitions of filters
the number of documents that it removes, v(S). Its Hart-Mas-Colell potential is P(0) = 0 and P(S) = (v(S) + sum of P(S - i) over i in S) / |S|, and the
Shapley value of filter i is P(all) - P(all - i). Potentials are kept 120-fold, which makes them whole
numbers, and 120 times the Shapley value is what the filter removes summed over all 120 orders. A step of an order goes from
one coalition to the next: the difference of the two is what its filter removes there.

Repeats are found by counting: rows are combined by (id, text digest, part), then by (digest, part) with the least id and
its count, so a text that a third of all rows share is a few rows of each task.

Defined cases: null text is the empty text; null part is the empty string; null ids are neither repeats nor make others one; rows repeated with
id and text are no repeats of each other, and each counts; documents without labels are neither good nor toxic, an id with several labels is
good (toxic) if one says so; parts without documents don't occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, WORD_GAP, documents, scratch, text_of

FILTERS = "ABCDE"
ALL = 2 ** len(FILTERS) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column, words: Column) -> list[Column]:
    """Whether a text with these words fails A, B, C and D; E is a matter of the table."""
    n = F.size(words)
    return [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 2 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def counted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, bits (filters a document fails), n, good, toxic."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    words = F.filter(F.split(F.btrim("t", F.lit(BLANKS)), WORD_GAP), lambda w: w != "")
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(F.col("t"), F.col("words")))), F.lit(0))
    copies = rows.withColumn("words", words).select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), bits.alias("bits")).groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n"))
    marks = labels.select(F.col("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    known = copies.join(marks, "doc_id", "left").select("doc_id", "digest", "part", "bits", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("bad"))
    # One id may be in several parts: the least id of a text, with its rows in this part and mark.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    alike = scratch(known.groupBy("digest", "part", "bits", "good", "bad").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), least.alias("least")), "alike")  # texts are read once
    firsts = alike.groupBy("digest").agg(F.min("least.doc_id").alias("first"), F.count("*").alias("several"))
    placed = alike.join(firsts, "digest")
    stay = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    tallies = placed.select("part", "good", "bad", F.explode(F.array(
        F.struct(F.col("bits").alias("bits"), stay.alias("n")), F.struct((F.col("bits") + (1 << 4)).alias("bits"), (F.col("n") - stay).alias("n")),
    )).alias("x")).filter("x.n > 0")
    return tallies.groupBy("part", F.col("x.bits").alias("bits")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("bad"), F.col("x.n")).otherwise(0)).alias("toxic")
    )


def _only(bits: int):
    return lambda c: c["bits"] == bits


def games(counts: DataFrame) -> DataFrame:
    """A row a part: n, arrays over the 32 coalitions (removed, good, toxic), alone (fails only this filter) and the potential, 120-fold."""
    part = counts.groupBy("part").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))  # 32 cells at most
    of = lambda field, met: F.aggregate(F.filter("cells", met), F.lit(0).cast("long"), lambda s, c: s + c[field])
    over = lambda field: F.transform(F.sequence(F.lit(0), F.lit(ALL)), lambda s: of(field, lambda c: c["bits"].bitwiseAND(s) != 0))
    table = part.select("part", "n", over("n").alias("removed"), over("good").alias("good"), over("toxic").alias("toxic"), F.array(*[of("n", _only(1 << i)) for i in range(len(FILTERS))]).alias("alone"))
    without = " + ".join(f"IF((s & {1 << i}) != 0, p[s ^ {1 << i}], 0L)" for i in range(len(FILTERS)))
    potential = f"aggregate(sequence(1, {ALL}), array(0L), (p, s) -> array_append(p, (120L * removed[s] + {without}) div bit_count(s)))"
    return table.withColumn("potential", F.expr(potential))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    steps = F.array(*[
        F.struct(F.lit(order).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(FILTERS.index(f)).alias("f"), F.lit(sum(1 << FILTERS.index(x) for x in order[:i])).alias("s"))
        for order in ORDERS for i, f in enumerate(order)
    ])
    rows = games(counted(docs, labels, id_col, text_col, part_col)).withColumn("x", F.explode(steps)).select("*", "x.*").withColumn("own", F.expr("shiftleft(1, f)")).withColumn("after", F.expr("s | own"))
    gained = lambda field: F.expr(f"{field}[after] - {field}[s]")
    return rows.select(
        "part", "filter_order", "step", F.expr("n - removed[after]").alias("kept"), gained("removed").alias("removed"), F.expr("removed[own] - (removed[after] - removed[s])").alias("redundant"),
        F.expr("alone[f]").alias("unique_fails"), gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"), F.expr(f"potential[{ALL}] - potential[{ALL} ^ own]").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN g USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest([1, 2, 3, 4, 5]) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, l.x AS step, o[l.x] AS own, o[1:l.x - 1] AS before FROM o, l),
r AS (SELECT c.part, o, step, own, n, good, toxic, fails[own] AS hit, len(list_filter(before, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS single FROM c, s),
q AS (SELECT part, o, step, any_value(own) AS own, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (hit AND single), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM r GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda x: chr(64 + x)), '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM q"""
