"""Sizes, targets and words taken of the mix against a plain computation of them."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from veilspark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes: dict, weights=(3, 1, 2), share=Fraction(3, 2), most=2) -> dict:
    """Targets by handing the excess out again until no source is over its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, still, target = sum(sizes.values()) * share, set(order), {}
    while still:
        unit = left / sum(weight[s] for s in still)
        over = {s for s in still if unit * weight[s] > most * sizes[s]}
        for s in over or still:
            target[s] = Fraction(most * sizes[s]) if over else unit * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        still -= over
    return target


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    sources = ["b", "B", "", "é", "😀", "zz", None, "empty"]
    blanks = [" ", "\t", "\n", " \x0b ", "\r\n", "\x0c"]
    rows = []
    for i in range(260):
        source = rng.choices(sources, weights=[60, 20, 5, 20, 3, 10, 10, 2])[0]
        n = 0 if source == "empty" else rng.choice([0, 1, 3, 40, 200, 900 if source == "b" else 90])
        text = None if n == 0 and rng.random() < 0.5 else "".join(f"w {k}{rng.choice(blanks)}" for k in range(n))
        rows.append((rng.choice([i, i, i, 7, None]), text, source))
    return rows + rows[:20]


@pytest.mark.parametrize("seed,chunk_rows", [(1, mixing.CHUNK_ROWS), (2, 16), (3, 3)])
def test_against_plain_targets(spark, monkeypatch, seed, chunk_rows):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", chunk_rows)
    rows = corpus(seed)
    size = lambda t: len(WORD.findall(t or ""))
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    targets = plain_targets(sizes)
    assert sum(targets.values()) == sum(sizes.values()) * Fraction(3, 2)
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    shown = lambda i, n, all_, target: (i, n, all_, round(float(target), 6))
    assert Counter(shown(r.doc_id, r["size"], r.source_size, r.target) for r in got) == Counter(shown(i, size(t), sizes[s], targets[s]) for i, t, s in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    # Sources of equal size and target can't be told apart in the result; there are none here.
    taken: Counter = Counter()
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s, target in targets.items():
        assert abs(taken[sizes[s], round(float(target), 6)] - target) <= 2 * mixing.BLOCK_WORDS, s
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_one_source_and_no_words(spark):
    """A lone source takes 150 % of its words; sources without words take none."""
    got = {r.doc_id: (r["size"], r.target, r.taken) for r in mixing.mix_sources(spark.createDataFrame([(1, "a b c d", "x"), (2, None, "x"), (3, " ", "x")], SCHEMA)).collect()}
    assert got == {1: (4, 6.0, 6), 2: (0, 6.0, 0), 3: (0, 6.0, 0)}
    got = mixing.mix_sources(spark.createDataFrame([(1, None, "x"), (2, "\t", None)], SCHEMA)).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
