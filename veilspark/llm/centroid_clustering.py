"""Centroid clustering whose assignment step is Orchard's search.

The centroids are few (``k``; with their neighbour lists k * k numbers travel to the tasks) and each has a list of all
others, nearest first. A vector starts at some centroid and walks its list; a closer centroid found on the
way becomes the current one and its list is walked from the start, centroids seen before are not measured again, and the
walk ends at the first list entry that lies strictly beyond twice the current distance from the current centroid, as no
later one can be as near. Tasks walk with all vectors of an Arrow batch at a time. All arithmetic is on integers: components are floor(scale * x),
centroids are exact floors of means, distances are squared. A round reads the table, and returns at most k * dim sums from a task.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; fewer than
``k`` vectors are as many centroids; null ids come last among the seeds, equal ids are ordered by their vectors; repeated rows
count each for itself; integers too large for 64-bit squares are handled exactly, a distance
beyond the range of a long is null and sums leave it out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
LIMB = 40  # sums travel in parts of so many bits, so no count of tasks makes a long overflow


def usable(vectors: DataFrame, dim: int = DIM, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above infinity
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter((F.size("v") == dim) & finite)


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python integers where squares of their differences could leave 64 bits."""
    most = math.isqrt((2**63 - 1) // (16 * x.shape[1])) if x.size else 0
    if not x.size or np.abs(x).max() * scale < most:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[int(y) * scale if abs(y) >= 2.0**53 else math.floor(y * scale) for y in row] for row in x.tolist()], dtype=object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


class Orchard:
    """Centroids with their sorted neighbour lists."""

    def __init__(self, centroids: list[list[int]]):
        top = max((abs(x) for c in centroids for x in c), default=0)
        small = not centroids or top <= math.isqrt((2**63 - 1) // (16 * len(centroids[0])))
        self.points = np.array(centroids, dtype=np.int64 if small else object)
        between = [[int(squared(a, b)) for b in self.points] for a in self.points]
        lists = [sorted((d, j) for j, d in enumerate(row) if j != i) for i, row in enumerate(between)]
        self.order = np.array([[j for _, j in x] for x in lists], dtype=np.int64).reshape(len(lists), -1)
        self.apart = np.array([[d for d, _ in x] for x in lists], dtype=self.points.dtype).reshape(len(lists), -1)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid; of equal ones the smaller number."""
        n, last = len(v), self.order.shape[1]
        best, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        near = squared(v, self.points[0]) if n else np.zeros(0, dtype=np.int64)
        seen = np.zeros((n, len(self.points)), dtype=bool)
        seen[:, 0] = True
        live = np.arange(n if last else 0)
        while len(live):
            live = live[at[live] < last]
            live = live[(self.apart[best[live], at[live]] <= 4 * near[live]).astype(bool)]
            other = self.order[best[live], at[live]]
            at[live] += 1
            new = ~seen[live, other]
            asked, other = live[new], other[new]
            seen[asked, other] = True
            gap = squared(v[asked], self.points[other])
            nearer = ((gap < near[asked]) | ((gap == near[asked]) & (other < best[asked]))).astype(bool)
            moved = asked[nearer]
            best[moved], near[moved], at[moved] = other[nearer], gap[nearer], 0
        return best, near


def _rows(batch, dim: int, scale: int) -> np.ndarray:
    return scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)


def seeds(rows: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The k vectors of smallest hash: k rows, by a top-k."""
    first = rows.select("v", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return [scaled(np.array([r.v]), scale)[0].tolist() for r in first]


def moved(rows: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """One round: every centroid with vectors becomes the floor of their mean."""
    dim = len(centroids[0])

    def run(batches):
        orchard, counts, sums = Orchard(centroids), defaultdict(int), defaultdict(lambda: [0] * dim)
        for batch in batches:
            v = _rows(batch, dim, scale)
            best, _ = orchard.nearest(v)
            for c in np.unique(best).tolist():
                mine = v[best == c]
                counts[c] += len(mine)
                sums[c] = [a + b for a, b in zip(sums[c], mine.sum(axis=0).tolist(), strict=True)]
        out = [(c, -1, 0, n) for c, n in counts.items()]
        for c, total in sums.items():
            for i, x in enumerate(total):
                sign, x, limb = (-1 if x < 0 else 1), abs(x), 0
                while x:
                    out.append((c, i, limb, sign * (x & ((1 << LIMB) - 1))))
                    x, limb = x >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["c", "i", "limb", "part"])

    found = rows.mapInArrow(run, "c long, i long, limb long, part long").groupBy("c", "i", "limb").agg(F.sum("part").alias("part")).collect()  # k * (dim + 1) * limbs rows
    counts, sums = {r.c: r.part for r in found if r.i < 0}, defaultdict(int)
    for r in found:
        if r.i >= 0:
            sums[r.c, r.i] += r.part << (LIMB * r.limb)
    return [[sums[c, i] // counts[c] for i in range(dim)] if c in counts else centroids[c] for c in range(len(centroids))]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = usable(vectors, dim, id_col, vec_col)
    centroids = seeds(rows, k, scale)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids, scale)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches):
        orchard = Orchard(centroids) if centroids else None
        for batch in batches:
            if batch.num_rows:
                best, near = orchard.nearest(_rows(batch, dim, scale))
                near = [d if d < 2**63 else None for d in near.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(near, pa.int64()), pa.array([digests[c] for c in best.tolist()])], ["vec_id", "cluster", "distance", "centroid_sha256"])

    schema = rows.select("vec_id", F.lit(0).cast("int").alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit("").alias("centroid_sha256")).schema
    for field in schema:
        field.nullable = True
    placed = scratch(rows.mapInArrow(run, schema), "clusters")
    own = placed.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    whole = own.agg(F.try_sum("cluster_inertia").alias("inertia"))
    return placed.join(F.broadcast(own.join(F.broadcast(whole))), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows and one


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS b
  FROM (SELECT k.row, k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k CROSS JOIN c{i} c) GROUP BY row)"""


def _centroids_sql(i: int) -> str:
    return f""",
s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(v) AS x, unnest(range(1, {DIM + 1})) AS i FROM a{i - 1}) GROUP BY c, i),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{i} GROUP BY c),
c{i} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i - 1} o LEFT JOIN m{i} m USING (c)),"""


OP11_SQL = (
    f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {K})),"""
    + _round_sql(0)
    + "".join(_centroids_sql(i) + _round_sql(i) for i in range(1, ROUNDS + 1))
    + f"""
SELECT a.vec_id, a.b.c::INTEGER AS "cluster", a.b.d AS distance, (sum(a.b.d) OVER (PARTITION BY a.b.c))::BIGINT AS cluster_inertia, (sum(a.b.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.b.c"""
)
