"""Tables of terms, both outcomes of admission, dated decisions, run ids and dense documents."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veilspark.functions import spans
from veilspark.operators import history, redact, review, terms
from veilspark.streaming import jobs


def literal_hits(rows, text):
    """Each term's hits by itself, in order of the terms' numbers."""
    return [(m.start(), m.end(), t, f"【敏感信息{no}】") for no, t in sorted(rows) for m in re.finditer(re.escape(t), text)]


def hits(df):
    return {r.doc_id: [(c.start, c.end, c.value, c.placeholder) for c in r.term_candidates] for r in df.collect()}


@pytest.mark.parametrize("part", [4_000_000, 60])
def test_term_table_equals_the_literal_scan(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(terms, "PART_CHARS", part)
    rows = [(1, "aa"), (2, "aba"), (3, "𝒳y"), (4, "秘密"), (5, "aa"), (6, "a.b*"), (7, "missing"), (8, "b")] + [(100 + i, f"term{i}") for i in range(30)]
    texts = ["aaaaa aba ababa", "𝒳y秘密𝒳𝒳y a.b* axbb", "", None, "term1 term11 term111 秘密秘密", "aaaaa aba ababa"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame([*rows, (9, "  "), (10, None)], "term_no long, term string").withColumn("term", F.concat(F.lit(" "), "term", F.lit("\t")))
    got = hits(terms.with_terms(docs, table, folder=str(tmp_path)))
    assert got == {i: literal_hits(rows, t or "") for i, t in enumerate(texts)}


def test_many_terms_are_one_expression(spark):
    """The plan of a redaction does not grow with the table of terms, and the scan finds them all."""
    text = "，".join(f"名称{i}号" for i in range(0, 10_000, 97))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    size = []
    for n in (10, 10_000):
        table = spark.createDataFrame([(i + 1, f"名称{i}号") for i in range(n)], "term_no long, term string")
        found = terms.with_terms(docs, table)
        size.append(len(found._jdf.queryExecution().analyzed().toString()))
    assert abs(size[0] - size[1]) < 20
    assert len(found.first().term_candidates) == len(range(0, 10_000, 97))
    done = redact.redact(docs, term_table=table, fields=None, persons=False, parties=False, rules=[]).first()
    assert done.redacted == "，".join(f"【敏感信息{i + 1}】" for i in range(0, 10_000, 97))


def test_no_terms(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert hits(terms.with_terms(docs, spark.createDataFrame([], "term_no long, term string"))) == {1: []}


TEXTS = [(1, "邮箱：a@example.com"), (2, None), (3, " \n "), (4, "a﷐b"), (5, "邮箱：b@example.com\r\n"), (6, "x" * 200_001)]
WANT = [(1, "accepted", None, "邮箱：a@example.com", "邮箱：【邮箱已删除】"), (2, "rejected", "no text", None, None), (3, "rejected", "no text", " \n ", None), (4, "rejected", "reserved characters", "a﷐b", None), (5, "accepted", None, "邮箱：b@example.com", "邮箱：【邮箱已删除】"), (6, "rejected", "too many characters", "x" * 200_001, None)]
FEW = {"fields": None, "persons": False, "parties": False}


def outcomes(spark, path):
    return sorted((r.doc_id, r.outcome, r.reject_reason, r.text, r.redacted) for r in spark.read.parquet(path).collect())


def test_every_document_has_one_outcome(spark, tmp_path):
    redact.write_outcomes(spark.createDataFrame(TEXTS, "doc_id long, text string"), str(tmp_path / "out"), **FEW)
    assert outcomes(spark, str(tmp_path / "out")) == WANT
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["outcome=accepted", "outcome=rejected"]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    """The last batch's commit is lost, as after a failure: the batch runs again under its id."""
    out, state = str(tmp_path / "out"), tmp_path / "state"
    for i, rows in enumerate((TEXTS[:3], TEXTS[3:])):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
        run = lambda: jobs.outcome_stream(jobs.read_stream(spark, str(tmp_path / "in"), "doc_id long, text string"), out, str(state), **FEW).trigger(availableNow=True).start().awaitTermination()
        run()
        for f in (state / "commits").iterdir():
            if f.name.strip(".").startswith(str(i)):
                f.unlink()
        run()
    assert outcomes(spark, out) == WANT


def test_the_last_decision_holds(spark):
    match = "array<struct<match_id:string,start:int,`end`:int,value:string,category:string,placeholder:string,selected:boolean>>"
    docs = spark.createDataFrame([(1, [(f"m{i}", i, i + 1, "v", "amount", "P", True) for i in range(4)])], f"doc_id long, matches {match}")
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [(1, "m0", True, "R", at(1)), (1, "m0", False, None, at(2)), (1, "m1", False, "", at(3)), (1, "m1", True, None, at(4)), (1, "m1", None, "S", at(2)), (1, "m2", False, None, at(1)), (1, "m2", False, None, at(1))]
    decisions = spark.createDataFrame(rows, "doc_id long, match_id string, selected boolean, placeholder string, decided_at timestamp")
    for d in (decisions, decisions.orderBy(F.desc("decided_at"))):
        got = review.with_decisions(docs, d).first().matches
        assert [(m.selected, m.placeholder) for m in got] == [(False, "R"), (True, "【已删除】"), (False, "P"), (True, "P")]


def test_run_ids_stay_when_a_task_runs_again(spark, tmp_path):
    """A first attempt fails after its ids were made; the second one makes the same."""
    from veilspark.functions import fixed

    runs = spark.range(40).select("id", history.new_run_id(F.col("id")).alias("run_id"))
    seen = str(tmp_path)

    def failing(frames):
        import os

        for frame in frames:
            for i, run in zip(frame["id"], frame["run_id"], strict=True):
                with open(f"{seen}/{i}", "a") as f:
                    f.write(run + "\n")
            yield frame
            if not os.path.exists(f"{seen}/failed"):
                open(f"{seen}/failed", "w").close()
                raise RuntimeError("first attempt")

    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        runs.coalesce(1).mapInPandas(failing, "id long, run_id string").collect()
    again = {r.id: r.run_id for r in runs.repartition(7).mapInPandas(failing, "id long, run_id string").collect()}
    assert len(set(again.values())) == 40 and all(re.fullmatch(fixed.RUN_ID, x) for x in again.values())
    for i, run in again.items():
        assert set((tmp_path / str(i)).read_text().split()) == {run}
    other = spark.range(1).select(history.new_run_id(F.col("id")).alias("r")).first().r
    assert other != again[0]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 300])
def test_runs_of_a_sweep_join_without_gaps(spark, n):
    text = "".join(f"[{i}]-" for i in range(n))
    df = spark.createDataFrame([(text,)], "text string").withColumn("hits", spans.scan(F.col("text"), "[0-9]+"))
    cuts = F.transform("hits", lambda h: spans.candidate(h["start"], h["value"], "amount", "X"))
    row = df.select("text", "hits", spans.applied(F.col("text"), spans.resolved(cuts, None)).alias("done")).first()
    assert [(h.start, h.value) for h in row.hits] == [(m.start(), m.group()) for m in re.finditer("[0-9]+", text)]
    assert row.done == re.sub("[0-9]+", "X", text)
