"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Texts of equal shingle sets are one node. A node's shingles are ranked rarest first (a global order: shingles met at least ``LEAST`` times, the ``FREQUENT`` most
frequent of them at most, come last by their counts; all others come first by hash). Two sets that are similar enough share a shingle
among the first ``n - ceil(t * n) + 1`` of either, so only these prefixes are posted, each with its position and the sizes of
eight ranges of the shingles after it. A pair is sought where it shares a posted shingle, and left out
- by length: the smaller set has fewer than t times as many shingles;
- by position: too few shingles are left from the shared one on;
- by suffix: shingles before the shared one, and the differences of the ranges' sizes after it, are already too different.
These bounds hold for a pair's first shared shingle, whose row always decides for the pair. A pair that passes is held once more against the sizes of ``RANGES``
ranges of the whole sets (kept with the nodes, a byte each), and what is left is verified on the full sets, once for each pair.

Links are asked for as components, so not all pairs of a group are listed. First each posting list is passed once in order of position:
every node is paired with the list's first node, the one with the fewest rare shingles. Then only lists whose nodes still
lie in several components are joined with themselves, nodes of different components only, under the shingle and a class of lengths:
a node asks the classes of those shorter partners that its own position allows. Lists of a known frequent shingle are dealt to several tasks in the
first pass. Nothing is dropped by frequency or size of a list.

Defined cases: null text has no words; texts without words link with nothing and stand alone; rows with null ids are
their own component (null); rows of one id with different texts are linked each for itself; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch, text_of, text_slices
from .components import components
from .shingles import WordHashes, set_hash, shingle_set

SHINGLE, PERCENT = 3, 90
LEAST, FREQUENT = 8, 1 << 18  # shingles ranked by count: met so often, and at most so many (4 MiB in a task)
LIST = 50_000  # nodes of one list that a task of the first pass takes
FEW = 1 << 20  # ids that are broadcast at most (8 MiB); more are joined by a shuffle
CLASS = math.log(1.03)
RANGES = 128


def _sets(texts, k: int, hashes: WordHashes) -> list[np.ndarray]:
    return [shingle_set(hashes.of(t.lower().split()), k) for t in texts]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))


def _ranges(s: np.ndarray) -> bytes | None:
    """The numbers of shingles in RANGES ranges of hashes, modulo 256."""
    return np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=RANGES).astype(np.uint8).tobytes() if len(s) else None


def sketch(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts. kind 0: a document's id, set size, node and sizes of ranges; kind 1: a shingle met again in the task, its count."""

    def run(batches):
        hashes, again, once = WordHashes(), {}, np.zeros(0, dtype=np.uint64)

        def shingles():
            keys = np.fromiter(again.keys(), dtype=np.uint64, count=len(again)).view(np.int64)
            counts = pa.array(np.fromiter(again.values(), dtype=np.int64, count=len(again)))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(again), dtype=np.int32)), pa.array(keys), counts, pa.nulls(len(again), pa.int64()), pa.nulls(len(again), pa.binary())], ["kind", "a", "b", "c", "d"])

        for batch in text_slices(batches):
            sets = _sets(batch.column(1).cast(pa.binary()).to_pylist(), k, hashes)
            node = pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), dtype=np.int32)), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), node, pa.array([_ranges(s) for s in sets], pa.binary())], ["kind", "a", "b", "c", "d"])
            keys, counts = np.unique(np.concatenate([once, *sets]), return_counts=True)
            for x, n in zip(keys[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
                again[x] = again[x] + n - 1 if x in again else n
            once = keys if len(keys) < 2_000_000 else keys[:0]  # bounded: what is met once counts from here anew
            if len(again) > 1_000_000:
                yield shingles()
                again.clear()
        yield shingles()

    return _texts(docs, id_col, text_col).mapInArrow(run, "kind int, a long, b long, c long, d binary")


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (FREQUENT at most, in order of hash) and their counts."""
    often = scratch(counts.groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("n")).filter(F.col("n") >= LEAST), "frequent")
    classes = sorted(often.groupBy(F.floor(F.log2("n") * 8).alias("of")).count().collect(), key=lambda r: -r["of"])  # 512 rows at most
    total, bound = 0, None
    for row in classes:
        total += row["count"]
        if total > FREQUENT:
            break
        bound = row["of"]
    found = often.filter(F.floor(F.log2("n") * 8) >= (bound if bound is not None else 1 << 20)).toArrow()
    tokens, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order].astype(np.int64)


def _sizes(ranked: np.ndarray, prefix: int) -> np.ndarray:
    """For each place of the prefix: the numbers of later shingles in eight ranges of hashes, a byte each, 255 at most."""
    ranges = (ranked >> np.uint64(61)).astype(np.int64)
    left = np.bincount(ranges, minlength=8) - np.cumsum(np.eye(8, dtype=np.int64)[ranges[:prefix]], axis=0)
    return (np.minimum(left, 255).astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)


def postings(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, frequent) -> DataFrame:
    """token, part (of a frequent token's list; -1: there is one), node, n, pos, sizes; a node may come from several rows."""

    def run(batches):
        tokens, often = frequent.value
        hashes, known = WordHashes(), set()
        for batch in text_slices(batches):
            out = []
            for s in _sets(batch.column(1).cast(pa.binary()).to_pylist(), k, hashes):
                node = set_hash(s) if len(s) else None
                if node is None or node in known:
                    continue
                known.add(node)
                if len(known) > 500_000:
                    known.clear()
                at = np.minimum(np.searchsorted(tokens, s), max(len(tokens) - 1, 0))
                count = np.where(tokens[at] == s, often[at], 0) if len(tokens) else np.zeros(len(s), dtype=np.int64)
                order = np.lexsort((s, count))
                prefix = len(s) + (-len(s) * percent // 100) + 1
                first = order[:prefix]
                parts = -(-count[first] // LIST)
                part = np.where(parts > 1, node % np.maximum(parts, 1), -1)
                same = np.ones(prefix, dtype=np.int64)
                out.append((s[first].view(np.int64), part, same * node, same * len(s), np.arange(prefix, dtype=np.int64), _sizes(s[order], prefix).view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["token", "part", "node", "n", "pos", "sizes"])

    rows = _texts(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "token long, part long, node long, n long, pos long, sizes long")


ROW = ["token", "part", "node", "n", "pos", "sizes"]


def allowed(n, m, percent: int):
    """The number of shared shingles that makes sets of n and m shingles similar enough."""
    return -(-percent * (n + m) // (100 + percent))


def _hopeful(x: dict, y: dict, percent: int) -> np.ndarray:
    """Length, positional and suffix filter of two rows of one list."""
    n, m, i, j = x["n"], y["n"], x["pos"], y["pos"]
    need = allowed(n, m, percent)
    bytes_of = lambda s: np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8).astype(np.int64)
    apart = i + j + np.abs(bytes_of(x["sizes"]) - bytes_of(y["sizes"])).sum(axis=1)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - i, m - j) >= need) & (apart <= n + m - 2 * need)


def lists(posted: DataFrame, percent: int) -> DataFrame:
    """The rows of lists with several nodes, each node once, with ``head``: the list's first node where the filters let the pair
    pass. A task streams its lists in order and holds one batch and one row."""

    def run(batches):
        carry, told, last = None, False, None  # the open list's first row, whether it went out, and the last row's key and node
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {c: batch.column(i).to_numpy() for i, c in enumerate(ROW)}
            fresh = np.ones(batch.num_rows, dtype=bool)
            fresh[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in ("token", "part", "node")], axis=0)
            if last is not None:
                fresh[0] = last != tuple(cols[c][0] for c in ("token", "part", "node"))
            last = tuple(cols[c][-1] for c in ("token", "part", "node"))
            cols = {c: x[fresh] for c, x in cols.items()}
            if carry is not None:
                cols = {c: np.concatenate([carry[c], x]) for c, x in cols.items()}
            size = len(cols["token"])
            if not size:
                continue
            opens = np.ones(size, dtype=bool)
            opens[1:] = (cols["token"][1:] != cols["token"][:-1]) | (cols["part"][1:] != cols["part"][:-1])
            starts = np.flatnonzero(opens)
            lengths = np.diff(np.append(starts, size))
            run_of = np.cumsum(opens) - 1
            head = {c: x[starts[run_of]] for c, x in cols.items()}
            passes = _hopeful(cols, head, percent) & ~opens
            out = (lengths[run_of] > 1) | (cols["part"] >= 0)
            if told:  # only a carried row can have gone out
                out[0] = False
            told = bool(lengths[-1] > 1 or cols["part"][-1] >= 0 or (told and len(starts) == 1))
            carry = {c: x[starts[-1]][None] for c, x in cols.items()}
            made = pa.RecordBatch.from_arrays([pa.array(cols[c]) for c in ROW if c != "part"] + [pa.array(head["node"], mask=~passes)], ["token", "node", "n", "pos", "sizes", "head"])
            yield made.filter(pa.array(out))

    dealt = posted.repartition("token", "part").sortWithinPartitions("token", "part", "pos", "n", "node")
    return dealt.mapInArrow(run, "token long, node long, n long, pos long, sizes long, head long")


def _apart(x: str, y: str) -> Column:
    """Differences of the sizes of eight ranges, summed."""
    byte = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
    return sum((F.abs(byte(x, i) - byte(y, i)) for i in range(8)), F.lit(0))


def _class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(CLASS)).cast("int")


def crossing(rows: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of nodes of different components that pass the filters at a shared shingle."""
    placed = rows.join(labels, "node", "left").select("token", "node", "n", "pos", "sizes", F.coalesce("label", "node").alias("label"))
    several = placed.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("token")
    open_rows = scratch(placed.join(several, "token"), "open")
    top = F.least(F.col("n"), F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent).cast("long") - F.col("n"))
    low = F.ceil(F.col("n") * percent / 100).cast("long")
    asks = open_rows.withColumn("top", top).filter(F.col("top") >= low).select(
        "token", F.col("node").alias("a"), F.col("n").alias("m"), F.col("pos").alias("i"), F.col("sizes").alias("sizes_a"), F.col("label").alias("other"),
        F.explode(F.sequence(_class(low), _class(F.col("top")))).alias("class"),
    )
    need = F.ceil((F.col("m") + F.col("n")) * percent / F.lit(100 + percent)).cast("long")
    shorter = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") < F.col("a")))
    position = (F.col("m") - F.col("i") >= need) & (F.col("n") - F.col("pos") >= need) & (100 * F.col("n") >= percent * F.col("m"))
    suffix = F.col("i") + F.col("pos") + _apart("sizes_a", "sizes") <= F.col("m") + F.col("n") - 2 * need
    met = asks.join(open_rows.withColumn("class", _class(F.col("n"))), ["token", "class"])
    return met.filter((F.col("label") != F.col("other")) & shorter & position & suffix).select("a", F.col("node").alias("b")).dropDuplicates()


def near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose ranges' sizes do not tell that they differ too much; sizes are known modulo 256, so their difference is at least the shorter way round."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, RANGES) for i in (4, 5))
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            apart = np.abs((x - y).view(np.int8).astype(np.int64)).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array(apart <= n + m - 2 * allowed(n, m, percent)))

    left, right = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("ranges").alias(f"ranges_{k}")) for k in "ab")
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "ranges_a", "ranges_b")
    return rows.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a stored table) whose full sets are similar enough."""
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).dropDuplicates()
    ids = scratch(nodes.join(wanted, "node").select(F.col("rep").alias("doc_id")).dropDuplicates(), "wanted")
    if ids.count() <= FEW:
        ids = F.broadcast(ids)

    def run(batches):
        hashes = WordHashes()
        for batch in text_slices(batches):
            sets = [s for s in _sets(batch.column(0).cast(pa.binary()).to_pylist(), k, hashes) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    sets = scratch(_texts(docs, id_col, text_col).join(ids, "doc_id", "left_semi").select("t").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "sets")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    found = scratch(sketch(docs, k, id_col, text_col), "sketch", "kind")
    members = found.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("node"))
    takes_part = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    of_set = found.filter("kind = 0 AND a IS NOT NULL AND c IS NOT NULL").groupBy(F.col("c").alias("node"))
    nodes = scratch(of_set.agg(F.min("a").alias("rep"), F.first("b").alias("n"), F.first("d").alias("ranges")), "nodes")
    frequent = spark.sparkContext.broadcast(_frequent(found.filter("kind = 1")))
    rows = scratch(lists(postings(docs, k, percent, id_col, text_col, frequent), percent), "lists")
    check = lambda pairs: verified(scratch(near(pairs, nodes, percent), "pairs"), docs, nodes, k, percent, id_col, text_col)
    links = scratch(check(rows.filter("head IS NOT NULL").select(F.col("head").alias("a"), F.col("node").alias("b")).dropDuplicates()), "links")
    labels = components(links)
    more = scratch(check(crossing(rows, labels, percent)), "links")
    if not more.isEmpty():
        labels = components(scratch(links.unionAll(more), "links"))
    where = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    of_node = where.join(where.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("node", "component_id")
    linked = members.filter(takes_part).join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    return linked.unionAll(members.filter(~takes_part).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
