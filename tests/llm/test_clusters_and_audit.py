"""Centroid clustering and the filter audit against brute force, on odd rows too."""

import hashlib
import math
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from veilspark.llm import centroid_clustering as cc
from veilspark.llm import filter_audit as fa

VECTORS = "vec_id long, embedding array<double>, cluster string, v int"


def brute_clusters(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    seed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in seed[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        places = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), p in zip(kept, places, strict=True) if p == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    own = Counter()
    for _, d, c in last:
        own[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, own[c], sum(own.values()), digest[c]) for i, d, c in last)


def found(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def random_vectors(n, ties=False):
    rng = np.random.default_rng(3)
    values = rng.integers(-2, 3, (n, 64)) / 64 if ties else rng.normal(size=(n, 64))
    return [(i, v.tolist(), "x", 1) for i, v in enumerate(values)]


@pytest.mark.parametrize("rows", [
    random_vectors(300),
    random_vectors(200, ties=True),
    random_vectors(5),
    [(i, [float(i % 3)] * 64, "x", 1) for i in range(60)],
    [(1, [1.0] * 64, "x", 1)] * 40 + [(1, [2.0] * 64, "x", 1)] * 20,
    random_vectors(40) + [(None, [0.5] * 64, "x", 1), (7, None, "x", 1), (8, [], "x", 1), (9, [1.0] * 63, "x", 1), (10, [None] + [1.0] * 63, "x", 1), (11, [float("nan")] * 64, "x", 1), (12, [float("inf")] * 64, "x", 1)],
    random_vectors(30) + [(100, [2.5e6] * 64, "x", 1), (101, [-1e7] + [0.3] * 63, "x", 1)],
], ids=["random", "ties", "few", "equal", "repeated ids", "odd", "large"])
def test_clusters_by_brute_force(spark, rows):
    assert found(cc.cluster(spark.createDataFrame(rows, VECTORS))) == brute_clusters(rows)


def test_clusters_of_huge_and_no_vectors(spark):
    huge = [(i, [x * 1e30 for x in v], c, n) for i, v, c, n in random_vectors(50)]
    got = {r.vec_id: r for r in cc.cluster(spark.createDataFrame(huge, VECTORS)).collect()}
    want = {x[0]: x for x in brute_clusters(huge)}
    assert {i: (r.cluster, r.centroid_sha256) for i, r in got.items()} == {i: (x[1], x[5]) for i, x in want.items()}
    assert all(r.distance == (want[i][2] if want[i][2] < 2**63 else None) for i, r in got.items())
    assert cc.cluster(spark.createDataFrame([], VECTORS)).count() == 0


def test_orchard_measures_fewer_than_all():
    """The walk finds the nearest without measuring every centroid."""
    rng = np.random.default_rng(1)
    centroids = rng.integers(-1000, 1000, (64, 8))
    v = centroids[rng.integers(0, 64, 500)] + rng.integers(-20, 20, (500, 8))
    asked, plain = [], cc.squared
    cc.squared = lambda a, b: asked.append(len(a)) or plain(a, b)
    try:
        orchard = cc.Orchard(centroids.tolist())
        asked.clear()
        best, near = orchard.nearest(v)
    finally:
        cc.squared = plain
    gaps = ((v[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == gaps.argmin(1)).all() and (near == gaps.min(1)).all()
    assert sum(asked) < 0.6 * gaps.size


DOCS = "doc_id long, text string, source string, n int, good string, bits string"
MARKS = "doc_id long, quality int, toxic int, n int"


def brute_audit(docs, marks):
    rows = [(i, t or "", s or "") for i, t, s, *_ in docs]
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    fails, good, toxic = [], [], []
    for i, t, _ in rows:
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails.append({f for f, x in zip("ABCDE", [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > first[t]], strict=True) if x})
        good.append(any(m[0] == i and m[1] == 1 for m in marks if i is not None))
        toxic.append(any(m[0] == i and m[2] == 1 for m in marks if i is not None))
    out, removed_by = [], Counter()
    for part in {s for _, _, s in rows}:
        mine = [k for k, r in enumerate(rows) if r[2] == part]
        for order in permutations("ABCDE"):
            left = set(mine)
            for step, f in enumerate(order, 1):
                hit = {k for k in left if f in fails[k]}
                left -= hit
                removed_by[part, f] += len(hit)
                failing = sum(f in fails[k] for k in mine)
                out.append([part, "".join(order), step, len(left), len(hit), failing - len(hit), sum(fails[k] == {f} for k in mine), sum(good[k] for k in hit), sum(toxic[k] for k in hit), f])
    return Counter((*x[:-1], removed_by[x[0], x[-1]]) for x in out)


def test_audit_by_brute_force(spark):
    rng = np.random.default_rng(9)
    long = " ".join(f"w{i}" for i in range(250))
    pool = ["", " \t\n ", "short text", "SHOUTING TEXT", "a # b", long, long + " #", "w " * 220, "W " * 220 + "|", "x" * 3_000_000, "Word " * 60_000, None]
    docs = [(int(rng.integers(0, 60)) if rng.random() < 0.9 else None, pool[rng.integers(0, len(pool))], ["s", "t", None][rng.integers(0, 3)], 1, "x", "y") for _ in range(150)]
    docs += docs[:10]
    marks = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2)), 1) for i in rng.integers(0, 60, 50)] + [(None, 1, 1, 1), (3, None, None, 1)]
    got = fa.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(marks, MARKS))
    assert Counter(map(tuple, got.collect())) == brute_audit(docs, marks)


def test_audit_of_no_documents_and_no_labels(spark):
    none = spark.createDataFrame([], DOCS)
    assert fa.audit(none, spark.createDataFrame([], MARKS)).count() == 0
    docs = [(1, "a", "s", 1, "x", "y"), (2, "a", "s", 1, "x", "y")]
    assert Counter(map(tuple, fa.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], MARKS)).collect())) == brute_audit(docs, [])
