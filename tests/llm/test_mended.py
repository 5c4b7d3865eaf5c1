"""Cases that gave wrong results before: other file splits between two scans, one very long vector, one very long text."""

import numpy as np
from pyspark.sql import functions as F

from veilspark.llm import lm_scoring, nn_descent, toxicity

TEXTS = [" ".join(f"w{(i * j) % 37}" for j in range(5 + i % 50)) for i in range(400)]


def test_scores_stay_when_files_are_split_otherwise(spark, tmp_path):
    """The second scan of the table has other splits than the first one."""
    path = str(tmp_path / "a b%c")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.repartition(4).write.option("parquet.block.size", 4096).parquet(path)
    learn = F.col("doc_id") % 7 != 2
    scored = lambda: lm_scoring.score(spark.read.parquet(path), learn, ["doc_id"], stored=True)
    shown = lambda d: {r.doc_id: (r.n_tokens, round(r.score, 6)) for r in d.collect()}
    want = shown(scored())
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    had = [spark.conf.get(n) for n in names]
    try:
        late = scored()  # the first scan is done
        for n, v in zip(names, ("2000", "1"), strict=True):
            spark.conf.set(n, v)
        splits = spark.read.parquet(path).rdd.getNumPartitions()
        got = shown(late)
    finally:
        for n, v in zip(names, had, strict=True):
            spark.conf.set(n, v)
    assert splits > 8 and got == want and len(want) == 400


def test_one_very_long_vector(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    for factor in (1.0, 1e7, 1e200):
        x[7] = rng.normal(size=16) * factor
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got = {}
        for r in nn_descent.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q in range(0, 600, 20):
            own = x @ x[q]
            own[q] = -np.inf
            hits += len(set(np.argsort(-own)[:20].tolist()) & got[q])
        assert hits >= 0.95 * 30 * 20, factor


def test_one_long_text_does_not_silence_the_classifier(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FIT_BYTES", 60_000)
    rng = np.random.default_rng(4)
    word = lambda k: f"{chr(97 + k // 10)}{chr(97 + k % 10)}x"
    some = lambda: [word(k) for k in rng.integers(0, 60, 8)]
    said = lambda i: " ".join([*some(), "idiot" if i % 2 == 0 else word(i % 60), *some()])
    docs = spark.createDataFrame([(i, " ".join(said(i) for _ in range(2000 if i in (4, 5, 6, 7) else 1))) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)], "doc_id long, toxic int")
    field = toxicity.learn(docs, labels)
    rows = {r.doc_id: r.score for r in toxicity.score(docs.filter("doc_id >= 40"), field, ["doc_id"]).collect()}
    assert all((s >= 0.5) == (i % 2 == 0) for i, s in rows.items())
