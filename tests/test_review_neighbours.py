"""Documents that share a state value: each keeps its own count and expires by its own last event."""

import json
from types import SimpleNamespace

from pyspark.sql import functions as F

from veilspark.streaming import review


class _Value:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def _processor(ttl_ms=None):
    p = review.DocumentReview(ttl_ms)
    p.init(SimpleNamespace(getValueState=lambda *a: _Value()))
    return p


def _rows(out):
    return [tuple(x) for r in out for x in zip(r.docs, r.ids, r.seqs, r.selected, r.shown)]


def _match(doc, *names):
    return (0, doc, list(names), [True] * len(names), ["P"] * len(names), None, None, None, None)


def _decision(doc, name, selected, shown, at):
    return (0, doc, None, None, None, name, selected, shown, at)


def test_outcomes_are_numbered_for_each_document():
    p = _processor()
    assert _rows(p.handleInputRows((0,), iter([_decision(2, "b", False, "", 5), _match(1, "b", "a"), _match(2, "b")]), None)) == [(2, "b", 1, False, "【已删除】"), (1, "a", 1, True, "P"), (1, "b", 2, True, "P")]
    assert _rows(p.handleInputRows((0,), iter([_decision(1, "a", False, "R", 1), _decision(3, "x", False, "R", 1)]), None)) == [(1, "a", 3, False, "R")]
    assert sorted(json.loads(p.state.value[0])) == ["1", "2", "3"]


def test_a_document_expires_by_its_own_last_event():
    p, at = _processor(100), lambda ms: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)
    list(p.handleInputRows((0,), iter([_match(1, "a"), _match(2, "a")]), at(0)))
    list(p.handleInputRows((0,), iter([_decision(2, "a", False, None, 1)]), at(60)))
    assert _rows(p.handleInputRows((0,), iter([_decision(1, "a", False, None, 1), _decision(2, "a", None, "R", 2)]), at(120))) == [(2, "a", 3, False, "R")]


def test_neighbours_go_by_id(spark):
    docs = spark.createDataFrame([(d, [("m", True, "P")]) for d in (-33, -32, -1, 0, 31, 32)], "doc_id long, matches array<struct<match_id:string,selected:boolean,placeholder:string>>")
    events = review.review_events(docs, spark.createDataFrame([], "doc_id long, match_id string, selected boolean, placeholder string, decided_at timestamp"))
    assert {r.doc_id: r.neighbours for r in events.select("doc_id", F.col("neighbours")).collect()} == {-33: -2, -32: -1, -1: -1, 0: 0, 31: 0, 32: 1}
