"""Decisions as events against the batch: late, repeated, before their match, in several micro-batches."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from veilspark.operators import review
from veilspark.streaming import review as stateful
from veilspark.streaming.jobs import read_stream

DOCS = "doc_id long, matches array<struct<match_id:string,start:int,`end`:int,value:string,category:string,placeholder:string,selected:boolean>>"
DECISIONS = "doc_id long, match_id string, selected boolean, placeholder string, decided_at timestamp"


def test_outcomes_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    docs = [(d, [(f"m{i}", i, i + 1, "v", "amount", "P", True) for i in range(4)]) for d in range(12)]
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=int(rng.integers(0, 6)))
    pick = lambda *x: x[rng.integers(0, len(x))]
    rows = [(int(rng.integers(0, 14)), f"m{rng.integers(0, 5)}", pick(True, False, None), pick("", "R", "S", None), at()) for _ in range(300)] + [(None, "m0", False, "", at()), (1, None, False, "", at())]
    for i, (d, x) in enumerate(((docs[:4], rows[:200]), (docs[4:8], rows[200:250]), (docs[8:], rows[250:]))):
        spark.createDataFrame(d, DOCS).write.mode("append").parquet(str(tmp_path / "docs"))
        spark.createDataFrame(x, DECISIONS).write.mode("append").parquet(str(tmp_path / "decisions"))
        streams = [read_stream(spark, str(tmp_path / n), s) for n, s in (("docs", DOCS), ("decisions", DECISIONS))]
        stateful.start_review(*streams, str(tmp_path / "out"), str(tmp_path / "state"), availableNow=True).awaitTermination()
    batch = review.with_decisions(spark.createDataFrame(docs, DOCS), spark.createDataFrame(rows, DECISIONS)).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.match_id", "m.selected", "m.placeholder")
    got = stateful.reviewed_matches(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
