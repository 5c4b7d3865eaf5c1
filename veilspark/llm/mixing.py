"""Mixing sources to target weights.

Each source's words, document after document, are one stream, packed into blocks of ``block_words``.
The mix has one slot for each block that a source's target asks for. For each output shard the number
of slots of each source is drawn: a multinomial draw, given that the totals meet the targets (one pseudorandom
permutation deals all slots to shards). The drawn counts, added up from shard to shard, say which of a source's slots
a shard holds; these map to the source's blocks by a pseudorandom permutation of the blocks, and
documents join them by the block's number. A second round begins only when all blocks are used.
Permutations are swap-or-not shuffles: each place is computed alone, nothing is sorted or gathered.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all
words; none takes more than ``most`` times its own words, what is over goes to the others by weight.

Defined cases: null text has no words; documents without words take none; null source is a source;
repeated rows are separate documents; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dealt, documents, text_of, word_count

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_SLOTS, ROUNDS, SEED = 64, 4096, 8, 20250
SLOT_RUN, CHUNK_ROWS, SHARD_RUN = 65536, 8192, 4096


def shuffled(place: Column, n: Column, key: Column, rounds: int = ROUNDS, seed: int = SEED) -> Column:
    """Where ``place`` goes in the pseudorandom permutation of 0..n-1 that ``key`` names."""

    def turn(at, i):
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), key, i), n) - at, n)
        swap = F.pmod(F.xxhash64(F.lit(seed + 1), key, i, F.greatest(at, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place.cast("long"), turn)


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """From skey, source, source_size (a row for each source): with target and its plan of slots."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", pick.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    # The sources that stop at their cap are the first ones by cap to weight: fill up in that order.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    t = t.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    t = t.withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    t = t.withColumn("share", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("skey", "source_size", F.when(F.col("open"), F.least("cap", F.col("share") * F.col("weight"))).otherwise(F.col("cap")).alias("target"))


def slot_plan(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds blocks, slots, last_words (words of the last slot) and first_slot (slots of sources before)."""
    t = targets.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    t = t.withColumn("whole", F.floor(F.col("target") / F.col("source_size"))).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    t = t.withColumn("more", F.ceil(F.col("rest") / block_words))
    t = t.withColumn("slots", F.col("whole") * F.col("blocks") + F.col("more"))
    t = t.withColumn("last_words", F.when(F.col("more") == 0, F.lit(block_words)).otherwise(F.col("rest") - (F.col("more") - 1) * block_words))
    upto = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("first_slot", F.coalesce(F.sum("slots").over(upto), F.lit(0))).withColumn("all_slots", F.sum("slots").over(Window.partitionBy(F.lit(0))))


def shard_counts(plan: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The draw: shard, skey, n (slots of the source in this output shard)."""
    runs = plan.filter("slots > 0").withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / SLOT_RUN))))
    slots = dealt(runs, "skey", "run").withColumn("slot", F.explode(F.sequence(F.col("run") * SLOT_RUN, F.least(F.col("slots"), (F.col("run") + 1) * SLOT_RUN) - 1)))
    place = shuffled(F.col("first_slot") + F.col("slot"), F.col("all_slots"), F.lit("mix"))
    return slots.select("skey", F.floor(place / shard_slots).alias("shard")).groupBy("shard", "skey").agg(F.count("*").alias("n"))


def draw_slots(plan: DataFrame, counts: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each slot of the mix: skey, block, limit (words to take), round, shard, place (its order there)."""
    # A source's slots before a shard: those of earlier runs of shards, and those of earlier shards of its run.
    split = counts.withColumn("run", F.floor(F.col("shard") / SHARD_RUN))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = split.groupBy("skey", "run").agg(F.sum("n").alias("all")).withColumn("runs_before", F.coalesce(F.sum("all").over(earlier(Window.partitionBy("skey").orderBy("run"))), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("skey", "run").orderBy("shard"))), F.lit(0))
    rows = split.withColumn("inside", inside).join(runs.select("skey", "run", "runs_before"), ["skey", "run"]).join(plan.select("skey", "blocks", "slots", "last_words"), "skey")
    slots = dealt(rows, "shard", "skey").withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("slot", F.col("runs_before") + F.col("inside") + F.col("nth"))
    return slots.select(
        "skey",
        shuffled(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), F.col("skey")).alias("block"),
        F.when(F.col("slot") == F.col("slots") - 1, F.col("last_words")).otherwise(F.lit(block_words)).cast("long").alias("limit"),
        F.floor(F.col("slot") / F.col("blocks")).cast("int").alias("round"),
        "shard",
        F.xxhash64(F.lit(SEED), "shard", "skey", "nth").alias("place"),
    )


def _laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source's stream, and the plan by source."""
    chunks_due = max(1, -(-docs.count() // CHUNK_ROWS))  # a source's documents are laid out in chunks of about CHUNK_ROWS at most
    tie = F.xxhash64(text_of(text_col)).alias("tie")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _source_key(source_col).alias("skey"), word_count(text_of(text_col)).alias("size"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(chunks_due)).alias("chunk"), tie, *keep)
    chunks = rows.groupBy("skey", "chunk").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    starts = chunks.withColumn("chunk_start", F.sum("words").over(Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    sizes = chunks.groupBy("skey").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    plan = source_targets(sizes)
    inside = Window.partitionBy("skey", "chunk").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = rows.join(starts.select("skey", "chunk", "chunk_start").hint("merge"), ["skey", "chunk"])
    laid = laid.withColumn("start", F.col("chunk_start") + F.sum("size").over(inside) - F.col("size")).withColumn("row", F.count("*").over(inside))
    return laid, plan


def _pieces(laid: DataFrame, keys: list[str], slots: DataFrame, block_words: int) -> DataFrame:
    """Documents' parts of blocks with the slots that take them: keys, at (first word of the part), take, round."""
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = laid.filter("size > 0").select(*keys, "skey", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest("start", F.col("block") * block_words)
    parts = parts.withColumn("at", low - F.col("start")).withColumn("low", low - F.col("block") * block_words)
    parts = parts.withColumn("high", F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words)))
    taken = parts.join(slots.hint("merge"), ["skey", "block"])
    return taken.withColumn("take", F.least("high", "limit") - F.col("low")).filter("take > 0")


def _slots(targets: DataFrame) -> DataFrame:
    plan = slot_plan(targets)
    return draw_slots(plan, shard_counts(plan))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, and the output shards that hold it: first_shard, last_shard, n_slots."""
    laid, targets = _laid_out(docs, id_col, text_col, source_col, [])
    keys = ["skey", "chunk", "row"]
    taken = _pieces(laid, ["chunk", "row"], _slots(targets), BLOCK_WORDS).groupBy(*keys).agg(F.sum("take").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"), F.count("*").alias("n_slots"))
    out = laid.select("doc_id", "size", *keys).join(taken, keys, "left").join(targets, "skey")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard", F.coalesce("n_slots", F.lit(0)).alias("n_slots"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each document and round with the words taken.

    A document taken whole keeps its text as it is; of others the words taken are joined by a blank. Within a partition
    rows stand in the order of the mix: by output shard and place of the document's first slot.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("whole")
    laid, targets = _laid_out(docs, id_col, text_col, source_col, [row])
    keys = ["skey", "chunk", "row"]
    parts = _pieces(laid, ["chunk", "row"], _slots(targets), BLOCK_WORDS)
    rounds = parts.groupBy(*keys, "round").agg(F.sum("take").alias("taken"), F.array_sort(F.collect_list(F.struct("at", "take"))).alias("spans"), F.min(F.struct("shard", "place")).alias("spot"))
    mixed = laid.join(rounds.hint("merge"), keys)
    words = F.split(F.btrim(text_of(f"whole.{text_col}"), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")
    # The words are bound once, as the only element of an array: within the spans' lambda they would be split again for each span.
    of_spans = lambda w: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(w, (s["at"] + 1).cast("int"), s["take"].cast("int")))), " ")
    cut = F.element_at(F.transform(F.array(words), of_spans), 1)
    text = F.when(F.col("taken") == F.col("size"), F.col(f"whole.{text_col}")).otherwise(cut)
    mixed = mixed.select("whole", text.alias("__mixed"), "spot").sortWithinPartitions("spot")
    out = [F.col("__mixed").alias(c) if c == text_col else F.length("__mixed").cast("long").alias(c) if c == "n_chars" else F.col(f"whole.{c}").alias(c) for c in docs.columns]
    return mixed.select(*out)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))
