"""MinHash near-dedup by a signature-coordinate inverted join.

Texts of equal shingle sets are one node. A node's signature has ``COORDS`` coordinates. Every
(coordinate, value) pair is a posting list. A pair of nodes that agrees in ``MATCHES`` coordinates
shares one of the ``COORDS - MATCHES + 1`` rarest of either (a global order, by counts in a table of fixed
size), so only these prefixes are posted. Lists are merged in three steps. First each node is compared
with the smallest node of its lists (the one most alike), which joins large groups by stars, without all pairs. Then lists
whose nodes already lie in one component are skipped; the nodes of the others are compared with a core: the node of
their lists' largest component that is in most of such lists; and those that stay outside it once more with its node that has the
fewest shingles of its own. Last, in lists that still span components, the nodes outside the
list's largest component are compared with all the rest of other components, unless
coordinates' last bits tell that too few agree (a pair is listed once, at the first token that both hold), or a bound rules a link out: the core that a node was compared with is its hub, so it is known which of the
hub's shingles the node holds (a bit each) and which others. Two nodes of one hub share
at most the hub's shingles that both hold, and of the others no more than either has that occur in several nodes of that
hub. Both tests are exact. Candidates are kept if their
signatures agree in ``MATCHES`` coordinates, and links are confirmed on the full shingle sets.

``MATCHES`` of 36 of 64 loses a pair of similarity 0.8 with a probability of about 1e-5.

Defined cases: null text has no words; texts without words link with nothing and stand alone; rows
with null ids are their own component (null) and are kept; rows of one id with different texts are
linked each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, scratch, text_of
from .components import components
from .shingles import WordHashes, mixed, shingle_set

COORDS, MATCHES, SHINGLE, PERCENT = 64, 36, 4, 80
PREFIX, BUCKETS = COORDS - MATCHES + 1, 1 << 18
_seeds = mixed(np.arange(1, 2 * COORDS + 1, dtype=np.uint64))
MULTIPLY, FLIP = _seeds[:COORDS] | np.uint64(1), _seeds[COORDS:]


def _sets(texts, k: int, hashes: WordHashes) -> list[np.ndarray]:
    return [shingle_set(hashes.of(t.lower().split()), k) for t in texts]


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of COORDS 32-bit minima; sets are not empty."""
    if not sets:
        return np.zeros((0, COORDS), dtype=np.uint32)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDS), dtype=np.uint32)
    for i in range(COORDS):
        out[:, i] = np.minimum.reduceat((flat ^ FLIP[i]) * MULTIPLY[i], starts) >> np.uint64(32)
    return out


def briefs(sig: np.ndarray) -> np.ndarray:
    """The last four bits of each coordinate, 16 of them to a number."""
    last = (sig & np.uint32(15)).astype(np.uint64).reshape(len(sig), COORDS // 16, 16)
    return np.bitwise_or.reduce(last << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def _unlike(i: int) -> str:
    """SQL for how many of 16 coordinates differ in their last four bits."""
    x = f"(brief_a[{i}] ^ brief[{i}])"
    return f"bit_count(({x} | shiftrightunsigned({x}, 1) | shiftrightunsigned({x}, 2) | shiftrightunsigned({x}, 3)) & {0x1111111111111111}L)"


def sketch(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n (set size), node (from the set; null for empty sets), sig, brief, and ``more`` columns as they are."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"), *more)
    schema = rows.select(F.col("doc_id"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("node"), F.lit(b"").alias("sig"), F.array(F.lit(0).cast("long")).alias("brief"), *more).schema
    for field in schema:
        field.nullable = True

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = _sets(batch.column(1).cast(pa.binary()).to_pylist(), k, hashes)
            found = signatures([s for s in sets if len(s)])
            sig, short = iter(found), iter(briefs(found))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                "sig": pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                "brief": pa.array([next(short) if len(s) else None for s in sets], pa.list_(pa.int64())),
                **{name: batch.column(2 + i) for i, name in enumerate(more)},
            })

    return rows.mapInArrow(run, schema)


def _tokens(batch) -> np.ndarray:
    """Hashes of all (coordinate, value) pairs, a row for each node."""
    sig = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sig")).to_pylist()), dtype=np.uint32).reshape(-1, COORDS)
    return mixed((sig.astype(np.uint64) << np.uint64(6)) | np.arange(COORDS, dtype=np.uint64))


def _rarity(nodes: DataFrame) -> np.ndarray:
    """How many (coordinate, value) pairs fall in each of BUCKETS buckets."""

    def run(batches):
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            counts += np.bincount((_tokens(batch) % np.uint64(BUCKETS)).astype(np.int64).ravel(), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(counts[at])})

    found = nodes.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def postings(nodes: DataFrame) -> DataFrame:
    """token, node, n: the PREFIX rarest pairs of each node."""
    rarity = nodes.sparkSession.sparkContext.broadcast(_rarity(nodes))

    def run(batches):
        for batch in batches:
            tokens = _tokens(batch)
            if not len(tokens):
                continue
            often = rarity.value[(tokens % np.uint64(BUCKETS)).astype(np.int64)]
            order = np.lexsort((tokens, often), axis=1)[:, :PREFIX]
            picked = np.take_along_axis(tokens, order, 1)
            yield pa.RecordBatch.from_pydict({
                "token": pa.array(picked.ravel().view(np.int64)),
                "node": pa.array(np.repeat(batch.column(batch.schema.get_field_index("node")).to_numpy(), PREFIX)),
                "n": pa.array(np.repeat(batch.column(batch.schema.get_field_index("n")).to_numpy(), PREFIX)),
            })

    return nodes.select("node", "n", "sig").mapInArrow(run, "token long, node long, n long")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, same (equal coordinates) of the pairs that agree in MATCHES of them."""
    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(x)).to_pylist()), dtype=np.uint32).reshape(-1, COORDS) for x in ("sig_a", "sig_b"))
            same = (a == b).sum(1)
            out = pa.RecordBatch.from_pydict({"a": batch.column(batch.schema.get_field_index("a")), "b": batch.column(batch.schema.get_field_index("b")), "same": pa.array(same.astype(np.int32))})
            yield out.filter(pa.array(same >= MATCHES))

    return pairs.select("a", "b").dropDuplicates().join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, same int")


COMPARED = "a long, b long, linked boolean, bits array<long>, rest array<long>"


def _compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs with: whether their full sets are similar enough, which of a's shingles b holds (bits, in order), and b's
    others (rest). ``pairs`` is a stored table."""
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).dropDuplicates()
    ids = nodes.join(wanted, "node").select(F.col("rep").alias("doc_id")).dropDuplicates()

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [s for s in _sets(batch.column(0).cast(pa.binary()).to_pylist(), k, hashes) if len(s)]
            yield pa.RecordBatch.from_pydict({"node": pa.array([_node(s) for s in sets], pa.int64()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).join(ids, "doc_id", "left_semi").select("t")
    sets = scratch(texts.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "sets")

    def check(batches):
        for batch in batches:
            linked, bits, rest = [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                hit = x[at] == y
                both = int(hit.sum())
                held = np.zeros(-(-len(x) // 64) * 64, dtype=np.uint8)
                held[at[hit]] = 1
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
                bits.append(np.packbits(held).view(np.int64))
                rest.append(y[~hit].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(bits, pa.list_(pa.int64())), pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "linked", "bits", "rest"])

    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, COMPARED)


def _spanning(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists that span components: token, node, n, label, most (the list's largest component), outside."""
    placed = posted.join(labels, "node", "left").select("token", "node", "n", F.coalesce("label", "node").alias("label"))
    spans = placed.groupBy("token", "label").agg(F.count("*").alias("size")).groupBy("token").agg(F.max(F.struct("size", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1").select("token", F.col("most.label").alias("most"))
    return placed.join(spans, "token").withColumn("outside", F.col("label") != F.col("most"))


def _marked(crowd: DataFrame, hubs: DataFrame) -> DataFrame:
    """Of the nodes in ``crowd``: node, hub, bits, several (shingles that are not the hub's but are in other nodes of the
    hub), own (those in no other); a node without a hub is its own."""
    rest = hubs.select("hub", "node", F.explode("rest").alias("shingle"))
    shared = rest.groupBy("hub", "shingle").agg(F.count("*").alias("k")).filter("k > 1").select("hub", "shingle")
    several = rest.join(shared, ["hub", "shingle"]).groupBy("node").agg(F.count("*").alias("several"))
    known = hubs.select("node", "hub", "bits", F.size("rest").alias("others")).join(several, "node", "left")
    every = F.array_repeat(F.lit(-1).cast("long"), F.ceil(F.col("n") / 64).cast("int"))
    return crowd.join(known, "node", "left").select("node", F.coalesce("hub", "node").alias("hub"), F.coalesce("bits", every).alias("bits"), F.coalesce("several", F.lit(0)).alias("several"), (F.coalesce("others", F.lit(0)) - F.coalesce("several", F.lit(0))).alias("own"))


def near_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n, label (of the group; null where a row takes no part), component_id (the group's
    smallest id) and ``more`` columns. Groups that hold different texts of one id differ in label only."""
    sketches = scratch(sketch(docs, k, id_col, text_col, more), "sketches")
    linkable = sketches.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = scratch(linkable.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("brief").alias("brief")), "nodes")
    posted = scratch(postings(nodes), "postings")
    compared = lambda pairs: _compared(pairs, docs, nodes, k, percent, id_col, text_col)
    near = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    # Stars: each node with the smallest node of its lists; of several such, the one most alike.
    heads = posted.groupBy("token").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("size")).filter("size > 1").select("token", F.col("head.node").alias("a"), F.col("head.n").alias("m"))
    stars = _alike(posted.join(heads, "token").filter((F.col("node") != F.col("a")) & near).select("a", F.col("node").alias("b")), nodes)
    best = stars.groupBy("b").agg(F.max(F.struct("same", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = scratch(compared(scratch(best, "stars")).filter("linked").select("a", "b"), "links")
    labels = components(links)
    # Cores: each node of lists that span components with the core of the component that is most often the largest in them.
    lists = _spanning(posted, labels)
    crowd = scratch(lists.groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.count("*").alias("times"), F.mode("most", True).alias("most")), "crowd")
    cores = crowd.groupBy("label").agg(F.max(F.struct("times", "node", "n")).alias("core")).select(F.col("label").alias("most"), F.col("core.node").alias("a"), F.col("core.n").alias("m"))
    asked = crowd.select("most", F.col("node").alias("b"), "n").join(cores, "most").filter((F.col("a") != F.col("b")) & near)
    seen = scratch(compared(scratch(_alike(asked, nodes), "cores")), "compared")
    marked = scratch(_marked(crowd, seen.select(F.col("b").alias("node"), F.col("a").alias("hub"), "bits", "rest")), "marked")
    links = scratch(links.unionAll(seen.filter("linked").select("a", "b")), "links")
    labels = components(links)
    # Once more, nodes outside the largest component with its node that has the fewest shingles of its own.
    lists = _spanning(posted, labels)
    crowd = scratch(lists.groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.mode("most", True).alias("most")), "crowd")
    cores = crowd.join(marked.filter("hub <> node").select("node", "own"), "node").groupBy("label").agg(F.min(F.struct("own", "node", "n")).alias("core")).select(F.col("label").alias("most"), F.col("core.node").alias("a"), F.col("core.n").alias("m"))
    asked = crowd.filter("label <> most").select("most", F.col("node").alias("b"), "n").join(cores, "most").filter(near)
    links = scratch(links.unionAll(compared(scratch(_alike(asked, nodes), "cores")).filter("linked").select("a", "b")), "links")
    labels = components(links)
    # The rest: lists that still span components, but for pairs that the hub rules out.
    spanning = _spanning(posted, labels).withColumn("held", F.collect_set("token").over(Window.partitionBy("node")))  # PREFIX tokens at most
    spanning = spanning.withColumn("before", F.filter("held", lambda t: t < F.col("token"))).drop("held")
    mixed_lists = scratch(spanning.join(marked.select("node", "hub", "bits", "several"), "node").join(nodes.select("node", "brief"), "node"), "lists")
    one = mixed_lists.filter("outside").select("token", F.col("node").alias("a"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("hub").alias("hub_a"), F.col("bits").alias("bits_a"), F.col("several").alias("several_a"), F.col("brief").alias("brief_a"), F.col("before").alias("before_a"))
    two = mixed_lists.select("token", F.col("node").alias("b"), "n", "label", "outside", "hub", "bits", "several", "brief", "before")
    once = ~F.arrays_overlap("before_a", "before")  # a pair is listed at the first of its shared tokens
    both = F.expr("aggregate(zip_with(bits_a, bits, (x, y) -> bit_count(x & y)), 0, (s, x) -> s + x)") + F.least("several", "several_a")
    alike = F.expr(f"{' + '.join(map(_unlike, range(COORDS // 16)))} <= {COORDS - MATCHES}")  # else fewer than MATCHES coordinates agree
    may = (F.col("hub") != F.col("hub_a")) | (both * (100 + percent) >= (F.col("n") + F.col("m")) * percent)
    pairs = one.join(two, "token").filter((F.col("label") != F.col("other")) & near & (~F.col("outside") | (F.col("a") < F.col("b"))) & alike & may & once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    candidates = scratch(_alike(pairs, nodes), "pairs")
    if not candidates.isEmpty():
        labels = components(scratch(links.unionAll(compared(candidates).filter("linked").select("a", "b")), "links"))
    where = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    first = where.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_node = where.join(first, "label").select("node", "label", "component_id")
    return sketches.join(of_node, "node", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("label")).alias("label"), "component_id", *more)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    out = near_groups(docs, k, percent, id_col, text_col)
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=4)
