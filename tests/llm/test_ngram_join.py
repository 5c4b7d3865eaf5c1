"""The n-gram Jaccard join against brute force, on graded groups, odd rows and lists cut into parts."""

import numpy as np
import pytest

from veilspark.llm import ngram_join as nj

SCHEMA = "doc_id long, text string"


def brute(rows, k=3, percent=90):
    """Sorted (doc_id, n_shingles, component_id)."""
    low = [bytes(t or "", "utf8").lower().split() for _, t, *_ in rows]
    sets = [{tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set() for w in low]
    ids = [r[0] for r in rows]
    links = [[j for j, y in enumerate(sets) if x and ids[i] is not None and ids[j] is not None and 100 * len(x & y) >= percent * len(x | y)] for i, x in enumerate(sets)]
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in near)]) for i, near in enumerate(links)]
        if new == label:
            break
        label = new
    least = {}
    for i, x in enumerate(label):
        if ids[i] is not None:
            least[x] = min(least.get(x, ids[i]), ids[i])
    return sorted((str(ids[i]), len(s), str(least[label[i]] if ids[i] is not None else None)) for i, s in enumerate(sets))


def found(spark, rows, **more):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nj.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect())


def families(seed, n=260, shared=6):
    """Groups whose members lie at all similarities; some edits are common to many members."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = i % 3
        words = [f"g{g}b{j}" for j in range(120 + 40 * g)]
        for at in rng.integers(0, len(words), i % 8):
            words[at] = f"e{rng.integers(0, shared)}" if i % 2 else f"own{i}x{at}"
        if i % 5 == 0:
            words = words[: len(words) - int(rng.integers(0, 12))]
        rows.append((i, " ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_graded_groups_by_brute_force(spark, seed):
    rows = families(seed)
    want = brute(rows)
    assert 3 < len({c for *_, c in want}) < len(rows)
    assert found(spark, rows) == want


def test_other_sizes_by_brute_force(spark):
    rows = families(4)
    assert found(spark, rows, k=2, percent=75) == brute(rows, 2, 75)


def test_frequent_shingles_and_cut_lists_change_nothing(spark, monkeypatch):
    """The lists of frequent shingles are dealt to several tasks; the order of shingles does not matter."""
    rows = families(5)
    monkeypatch.setattr(nj, "LIST", 20)
    monkeypatch.setattr(nj, "LEAST", 2)
    assert found(spark, rows) == brute(rows)
    monkeypatch.setattr(nj, "FREQUENT", 0)
    assert found(spark, rows) == brute(rows)


def test_filters_never_part_what_links():
    """Every pair that links passes the filters at its first shared shingle."""
    rng = np.random.default_rng(7)
    hit = 0
    for _ in range(400):
        n = int(rng.integers(3, 300))
        x = rng.choice(2**62, n, replace=False).astype(np.uint64)
        y = x.copy()
        y[: int(rng.integers(0, max(1, n // 15)))] += np.uint64(1)
        y = y[: n - int(rng.integers(0, max(1, n // 30)))]
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if 100 * both < 90 * (len(x) + len(y) - both):
            continue
        first = np.intersect1d(x, y)[0]
        row = []
        for s in (x, y):
            prefix = len(s) + (-len(s) * 90 // 100) + 1
            at = int(np.searchsorted(s, first))
            assert at < prefix
            row.append({"n": np.array([len(s)]), "pos": np.array([at]), "sizes": nj._sizes(s, prefix)[at : at + 1]})
        assert nj._hopeful(*row, 90).all()
        hit += 1
    assert hit > 100


def test_odd_rows(spark):
    long = "word " * 400_000 + " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words under one id"), (2, None), (3, ""), (4, " \t\n "), (None, "a b c d e f"), (5, "A B C d e f"), (6, "a b"), (7, "A  b"), (8, "b a"), (9, "a"), (10, long), (11, long + " more"), (12, "x" * 3_000_000), (None, None)]
    assert found(spark, rows) == brute(rows)
    assert nj.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    crowded = spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4) for i, t in rows], SCHEMA + ", t string, node string, n int, token int, kind int, label int")
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nj.jaccard_components(crowded).collect()) == brute(rows)


def test_documents_by_brute_force(spark):
    """The registered query over a whole small table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nj.op13_ngram_join(spark, "/root/testdata/sf0.001").collect())
    assert got == brute([tuple(r) for r in docs])
