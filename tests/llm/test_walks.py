"""The walk of the neighbour search: against a plain walk, the rows its rounds write, and recall where links are few."""

import numpy as np
import pytest

from veilspark.llm import nn_descent


@pytest.fixture
def searched(spark, monkeypatch):
    """Searches with an exact graph of few links; gives the vectors, the result and the rows written in rounds, with the shortest and longest of their walks."""

    def run(n, dim, links, n_queries, seed=3):
        x = np.random.default_rng(seed).standard_normal((n, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        others = [set(r.tolist()) for r in np.argsort(-near, axis=1)[:, :links]]
        for i in range(n):
            for j in list(others[i]):
                others[j].add(i)
        codes = nn_descent._coded(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>"), 1.0)
        codes = nn_descent.scratch(codes, "codes")
        graph = spark.createDataFrame([(i, sorted(o)) for i, o in enumerate(others)], "id long, others array<long>")
        asked = spark.createDataFrame([(i * (n // n_queries),) for i in range(n_queries)], "q long")
        written, write = [], nn_descent.scratch

        def counted(df, tag, *more):
            out = write(df, tag, *more)
            if tag != "queries":
                written.append(out.count())
            return out

        monkeypatch.setattr(nn_descent, "scratch", counted)
        starts = nn_descent.drawn_starts(codes, asked).toPandas().groupby("q").id.apply(set)
        got = nn_descent.greedy_search(graph, codes, asked, {}).toPandas()
        score = {r.id: np.frombuffer(r.code, dtype=np.float16).astype(np.float32)[:-1] for r in codes.collect()}
        return near, others, starts, score, got.sort_values(["q", "score", "id"], ascending=[True, False, True]), written

    return run


def test_walks_equal_plain_walks_and_ended_ones_are_not_written_again(searched, monkeypatch):
    monkeypatch.setattr(nn_descent, "BEAM", 6)
    monkeypatch.setattr(nn_descent, "EXPAND", 2)
    monkeypatch.setattr(nn_descent, "MATES", 4)
    near, others, starts, score, got, written = searched(600, 8, 4, 12)
    going = []
    for q in range(0, 600, 50):
        seen, old, rounds = {}, set(), 1
        new = (others[q] | starts.get(q, set())) - {q}
        while True:
            seen |= {i: float(score[i] @ score[q]) for i in new}
            best = sorted(seen, key=lambda i: (-seen[i], i))
            front = [i for i in best[:6] if i not in old][:2]
            if not front or rounds > nn_descent.STEPS:
                break
            old |= set(front)
            new = set().union(*(others[i] for i in front)) - set(seen) - {q}
            rounds += 1
        going.append(rounds)
        mine = got[got.q == q]
        assert np.allclose(sorted(mine.score), sorted(seen[i] for i in best[: nn_descent.RERANK]), atol=1e-6)
        assert len(set(mine.id)) == len(mine) == min(len(seen), nn_descent.RERANK)
    assert min(going) < max(going)
    assert sum(written) == sum(going)  # a row for each round of a walk


def test_recall_where_links_hold_few_of_the_nearest(searched):
    near, *_, got, _ = searched(4000, 24, 5, 25)
    hits = [len(set(np.argsort(-near[q])[:20].tolist()) & set(r.id.head(20))) / 20 for q, r in got.groupby("q")]
    assert len(hits) == 25 and np.mean(hits) >= 0.9
