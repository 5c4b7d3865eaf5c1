"""Approximate nearest neighbours: an NN-descent graph from iterative Spark joins, searched greedily.

Nearness is the inner product. For the graph each vector gets one more component that makes all norms
equal, so that near means near by angle. Equal vectors are one node, named by the smallest of their ids. The graph begins with neighbours inside cells of vectors that
lie close along a few random lines. Each round joins every node's neighbours and strongest reverse neighbours with each
other, where one of the two is new to the node, and nodes keep the best of what their common neighbours
suggest; rounds end when few edges are new. A query walks the graph in
rounds of joins: it expands the best nodes it has not expanded, scores what is new, keeps the best, and
ends when its best nodes are all expanded; edges are walked both ways. The best are scored again on the original vectors,
and each node found stands for its smallest ids.

Every valid row is indexed. Groups are bounded: cells by ``CELL`` vectors side by side on a line, neighbour lists by ``DEGREE``
and ``REVERSE``.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and vectors of
another length than most, take no part; of rows that repeat an id the least vector counts; rows
with null ids take no part; equal scores go to the smaller id; fewer rows give shorter lists; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch

LINES, CELL, DEGREE, REVERSE, ROUNDS, OFFERS = 10, 256, 40, 64, 12, 24
STILL = 0.01  # rounds end when a smaller share of the edges is new
BEAM, EXPAND, STEPS, RERANK, NEAREST, QUERY_EVERY, MATES, LONG = 96, 48, 24, 60, 20, 20, 64, 64


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector (array of doubles) of the rows that take part."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").first()
    return rows.filter(F.size("vector") == (common["k"] if common else 0)).groupBy("id").agg(F.min("vector").alias("vector"))


def _matrix(column, kind) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1) if raw else np.zeros((0, 1), dtype=kind)


def norms(rows: DataFrame) -> DataFrame:
    """id, norm; computed by the largest component, so that no square overflows."""
    top = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    parts = rows.select("id", "vector", top.alias("top"))
    return parts.select("id", (F.col("top") * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top"))))).alias("norm"))


def scaling(rows: DataFrame) -> tuple[float, dict[int, float]]:
    """The norm that codes are scaled by, and how many times longer each of the LONG longest vectors is.

    A few very long vectors would press all others to nothing if they set the scale.
    """
    top = [(r.id, r.norm) for r in norms(rows).orderBy(F.desc("norm"), "id").limit(LONG + 1).collect()]
    if len(top) <= LONG:
        return (top[0][1] if top else 1.0), {}
    return top[-1][1], {i: n / top[-1][1] for i, n in top[:-1]}


def _coded(rows: DataFrame, scale: float) -> DataFrame:
    """id, code (half floats of the vector over ``scale``, or of its direction if it is longer, with the norm-filling component last)."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1) / scale
            top = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1.0)
            x /= top  # squares stay finite
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            x *= np.where(norm * top > 1, 1 / norm, top)
            last = np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))
            codes = np.hstack((x, last)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    return rows.mapInArrow(run, "id long, code binary")


def _edges(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"id": pa.array(a), "other": pa.array(b), "score": pa.array((np.rint(score * 16384) / 16384).astype(np.float32))})


EDGE = "id long, other long, score float"


def _cell_neighbours(codes: DataFrame, lines: int, cell: int) -> DataFrame:
    """Neighbours inside cells of about ``cell`` vectors in a row along each of ``lines`` random lines."""

    def project(batches):
        for batch in batches:
            x = _matrix(batch.column(1), np.float16).astype(np.float32)
            for line in range(lines):
                to = np.random.default_rng(line).standard_normal(x.shape[1]).astype(np.float32)
                at = pa.array((x @ to).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), line, dtype=np.int32)), batch.column(0), batch.column(1), at], ["line", "id", "code", "at"])

    along = codes.mapInArrow(project, "line int, id long, code binary, at double")
    # Dealt by range of the place on each line, from a sample of bounded size; cells are cut while the rows pass by.
    dealt = along.repartitionByRange(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "line", "at", "id").sortWithinPartitions("line", "at", "id")

    def join(batches):
        for rows in _cells(batches, cell):
            ids = rows.column(1).to_numpy()
            x = _matrix(rows.column(2), np.float16).astype(np.float32)
            k = min(DEGREE // 2, len(ids) - 1)
            if k > 0:
                near = x @ x.T
                np.fill_diagonal(near, -np.inf)
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                yield _edges(np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(near, best, 1).ravel())

    return dealt.select("line", "id", "code").mapInArrow(join, EDGE)


def _cells(batches, cell: int):
    """Runs of ``cell`` rows at most that lie side by side on one line."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        line, start = rows.column(0).to_numpy(), 0
        while start < len(line):
            end = min(start + cell, start + int(np.searchsorted(line[start:], line[start], side="right")))
            if end == len(line):  # the run may go on in the next batch
                break
            yield rows.slice(start, end - start).combine_chunks()
            start = end
        held = rows.slice(start)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _whole_groups(batches):
    """Tables that hold all rows of their first column's values; rows come sorted by it."""
    tail = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
        keys = rows.column(0).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        tail = rows.slice(cut)
    if tail is not None:
        yield tail.combine_chunks()


def _graph(edges: DataFrame) -> DataFrame:
    """id, near: the DEGREE best of each node's edges (id, other, score, fresh), equal ones by the smaller id."""
    ranked = edges.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("far"), "other", "fresh"))), 1, 4 * DEGREE).alias("near"))
    others = ranked.withColumn("others", F.col("near.other"))  # an edge may have come with scores that differ by rounding
    first = F.slice(F.filter("near", lambda e, i: F.array_position("others", e["other"]) == i + 1), 1, DEGREE)
    return others.select("id", F.transform(first, lambda e: F.struct((-e["far"]).alias("score"), e["other"].alias("other"), e["fresh"].alias("fresh"))).alias("near"))


def _common_neighbours(graph: DataFrame, codes: DataFrame) -> DataFrame:
    """What nodes learn from neighbours of neighbours: edges better than their worst, by way of at least one new edge."""
    ahead = graph.select("id", F.explode("near").alias("e")).select(F.col("id").alias("mid"), F.col("e.other").alias("id"), F.col("e.score").alias("score"), F.col("e.fresh").alias("fresh"))
    back = Window.partitionBy("mid").orderBy(F.desc("score"), "id")
    reverse = ahead.select(F.col("id").alias("mid"), F.col("mid").alias("id"), "score", "fresh").withColumn("r", F.row_number().over(back)).filter(F.col("r") <= DEGREE)
    members = ahead.select("mid", "id", "fresh").unionAll(reverse.select("mid", "id", "fresh")).repartition("mid").groupBy("mid", "id").agg(F.max("fresh").alias("fresh"))
    members = members.withColumn("any", F.max("fresh").over(Window.partitionBy("mid"))).filter("any").select("mid", "id", "fresh")
    worst = graph.select("id", F.when(F.size("near") < DEGREE, F.lit(-2.0)).otherwise(F.element_at("near", -1)["score"]).cast("float").alias("worst"))
    rows = members.join(codes.join(worst, "id"), "id").repartition("mid").sortWithinPartitions("mid").select("mid", "id", "worst", "code", "fresh")

    def join(batches):
        for rows in _whole_groups(batches):
            yield from suggest(rows)

    def suggest(rows):
        mids, ids, worst = (rows.column(i).to_numpy() for i in range(3))
        x = _matrix(rows.column(3), np.float16).astype(np.float32)
        fresh = rows.column(4).to_numpy(zero_copy_only=False)
        bounds = np.flatnonzero(np.concatenate(([True], mids[1:] != mids[:-1], [True])))
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            near = x[a:b] @ x[a:b].T
            np.fill_diagonal(near, -np.inf)
            near[~(fresh[a:b, None] | fresh[a:b])] = -np.inf
            k = min(OFFERS, b - a - 1)
            if k > 0:
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                score = np.take_along_axis(near, best, 1)
                row, col = np.nonzero(score > worst[a:b, None])
                out.append((ids[a:b][row], ids[a:b][best[row, col]], score[row, col]))
        if out:
            yield _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return rows.mapInArrow(join, EDGE)


def neighbour_graph(codes: DataFrame, lines: int = LINES, cell: int = CELL, rounds: int = ROUNDS) -> DataFrame:
    """id, near (array of score and other, best first)."""
    edges = _cell_neighbours(codes, lines, cell).withColumn("fresh", F.lit(True))
    graph = scratch(_graph(edges), "graph")
    for _ in range(rounds):
        old = graph.select("id", F.explode("near").alias("e")).select("id", "e.other", "e.score", F.lit(False).alias("fresh"))
        graph = scratch(_graph(old.unionAll(_common_neighbours(graph, codes).withColumn("fresh", F.lit(True)))), "graph")
        edges = graph.select(F.explode("near.fresh").alias("fresh")).agg(F.count("*").alias("n"), F.count_if("fresh").alias("new")).first()
        if edges["new"] <= STILL * edges["n"]:
            break
    return graph


def both_ways(graph: DataFrame, most: int = REVERSE) -> DataFrame:
    """id, others: each node's neighbours and the strongest of those that have it as neighbour."""
    ahead = graph.select("id", F.explode("near").alias("e")).select("id", F.col("e.other").alias("other"), F.col("e.score").alias("score"))
    strongest = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    back = ahead.select(F.col("other").alias("id"), F.col("id").alias("other"), "score").withColumn("r", F.row_number().over(strongest)).filter(F.col("r") <= most)
    return ahead.select("id", "other").unionAll(back.select("id", "other")).groupBy("id").agg(F.collect_set("other").alias("others"))


def _scored(asked: DataFrame, codes: DataFrame, longer: dict[int, float]) -> DataFrame:
    """q, id, score of the asked q, own (the query's code), id (the inner product of the coded vectors, for the longest times what their codes lack)."""
    ids, times = np.array(sorted(longer), dtype=np.int64), np.array([longer[i] for i in sorted(longer)])
    pairs = asked.join(codes, "id").select("q", "id", "code", "own")

    def run(batches):
        for batch in batches:
            x, y = (_matrix(batch.column(i), np.float16).astype(np.float32)[:, :-1] for i in (2, 3))
            score = np.einsum("ij,ij->i", x, y).astype(np.float64)
            if len(ids):
                node = batch.column(1).to_numpy()
                at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                score = np.where(ids[at] == node, score * times[at], score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["q", "id", "score"])

    return pairs.mapInArrow(run, "q long, id long, score double")


def drawn_starts(codes: DataFrame, query_ids: DataFrame, mates: int = MATES) -> DataFrame:
    """q, id: for each query about ``mates`` nodes drawn by a hash, wherever they lie; all nodes of a small table."""
    groups = max(1, codes.count() // mates)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    nodes = codes.select("id", of("id").alias("draw"))
    return query_ids.select("q", of("q").alias("draw")).join(nodes, "draw").select("q", "id").filter("q <> id")


def _offers(scored: DataFrame) -> DataFrame:
    """q, met: what was scored for each query in one row, far (the score with its sign turned), id and old."""
    return scored.groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", F.lit(False).alias("old"))).alias("met"))


def _walks(near: Column, seen: Column, held: int) -> list[Column]:
    """The state of a walk: the ``held`` best nodes with the marks of expanded ones, all nodes that were scored, and the nodes to expand next."""
    near = F.slice(F.sort_array(near), 1, held)
    front = F.transform(F.slice(F.filter(F.slice(near, 1, BEAM), lambda e: ~e["old"]), 1, EXPAND), lambda e: e["id"])
    return [near.alias("near"), seen.alias("seen"), front.alias("front")]


def greedy_search(graph: DataFrame, codes: DataFrame, query_ids: DataFrame, longer: dict[int, float], rounds: int = STEPS, keep: int = RERANK) -> DataFrame:
    """q, id, score of the ``keep`` best of all nodes that were scored for each query; ``graph`` has id, others.

    A walk starts at the query's own links, at the longest vectors and at nodes drawn from the whole table, so that it leaves a group of nodes
    without links to others and no list stays short where there are enough nodes. In each round the EXPAND best nodes that
    were not expanded before offer their links; what was scored once is not scored again. A walk ends when its BEAM best nodes are expanded.
    It is one row, and one that has ended is set aside, so that a round's work is that of the walks that go on.
    """
    held = max(keep, BEAM)
    queries = scratch(codes.join(query_ids.select(F.col("q").alias("id")), "id").select(F.col("id").alias("q"), F.col("code").alias("own")), "queries")
    start = graph.join(queries.select(F.col("q").alias("id")), "id").select(F.col("id").alias("q"), F.explode("others").alias("id"))
    start = start.unionAll(drawn_starts(codes, query_ids))
    if longer:
        start = start.unionAll(queries.select("q", F.explode(F.array(*[F.lit(i).cast("long") for i in longer])).alias("id")))
    first = queries.join(_offers(_scored(start.filter("q <> id").dropDuplicates().join(queries, "q"), codes, longer)), "q")
    walks = scratch(first.select("q", "own", *_walks(F.col("met"), F.col("met.id"), held)), "walks")
    ended = []
    for _ in range(rounds):
        ended.append(walks.filter(F.size("front") == 0).select("q", "near"))
        walks = walks.filter(F.size("front") > 0)
        if walks.isEmpty():
            break
        links = walks.select("q", F.explode("front").alias("id")).join(graph, "id").groupBy("q").agg(F.flatten(F.collect_list("others")).alias("others"))
        unseen = F.array_except("others", F.concat("seen", F.array("q")))
        asked = walks.select("q", "own", "seen").join(links, "q").select("q", "own", F.explode(unseen).alias("id"))
        met = walks.join(_offers(_scored(asked, codes, longer)), "q", "left").withColumn("met", F.coalesce("met", F.slice("near", 1, 0)))
        now = F.transform("near", lambda e: F.struct(e["far"].alias("far"), e["id"].alias("id"), (e["old"] | F.array_contains("front", e["id"])).alias("old")))
        walks = scratch(met.select("q", "own", *_walks(F.concat(now, "met"), F.concat("seen", "met.id"), held)), "walks")
    ended.append(walks.select("q", "near"))
    return reduce(DataFrame.unionAll, ended).select("q", F.explode(F.slice("near", 1, keep)).alias("e")).select("q", "e.id", (-F.col("e.far")).alias("score"))


def nearest_neighbours(table: DataFrame, nearest: int = NEAREST, query_every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query (ids divisible by ``query_every``)."""
    same = Window.partitionBy("vector").orderBy("id")
    valid = valid_vectors(table, id_col, vector_col).select("id", "vector", F.first("id").over(same).alias("node"), F.row_number().over(same).alias("nth"))
    valid = scratch(valid, "vectors")
    rows = valid.filter("nth = 1").select("id", "vector")
    scale, longer = scaling(rows)
    codes = scratch(_coded(rows, scale), "codes")
    graph = neighbour_graph(codes)
    asked = valid.filter(F.col("id") % query_every == 0).select(F.col("id").alias("query_id"), F.col("node").alias("q"))
    nodes = asked.select("q").dropDuplicates()
    queries = rows.select(F.col("id").alias("q"), F.col("vector").alias("own")).join(nodes, "q", "left_semi")
    found = greedy_search(scratch(both_ways(graph), "links"), codes, nodes, longer, keep=max(RERANK, 2 * nearest)).select("q", "id")
    found = found.unionAll(nodes.select("q", F.col("q").alias("id")))  # a node holds its query's copies
    exact = F.aggregate(F.zip_with("own", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = found.join(rows, "id").join(queries, "q").select("q", F.col("id").alias("node"), exact.alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    # One more than asked for, as a query may meet its own id.
    members = valid.filter(F.col("nth") <= nearest + 1).select("node", "id")
    ids = scored.join(members, "node").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= nearest + 1).select("q", "id", "score")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = asked.join(ids, "q").filter("query_id <> id").withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
