"""Review decisions as events: matches and decisions meet in keyed state, the last decision of a match holds.

Both streams are keyed by document. Decisions may come before their match, late, or repeatedly: each match keeps the time and value of its last
selection and of its last placeholder (a null decides nothing; of one time the greater value, as in ``operators.review``), so the
outcome does not depend on the order of events. Outcomes are appended and numbered for each document; what holds is the last of each match.
State is kept for ``ttl_ms`` after a document's last event, for ever if none is given.

Defined cases: rows without a document or match id are ignored; a decision whose match never comes has no outcome; an empty placeholder
becomes the deleted token; a match that comes again replaces the earlier one and keeps its decisions.

Up to NEIGHBOURS documents whose ids follow each other are one state value, read and written once a batch, and give one output row; the matches of
a document are one input row. Calls to the state store and rows between the JVM and Python are what a batch takes its time for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import fixed
from .history import with_rocksdb

OUTCOME = "doc_id long, match_id string, seq long, selected boolean, placeholder string"
OUTCOMES = "docs array<long>, ids array<string>, seqs array<long>, selected array<boolean>, shown array<string>"
NEIGHBOURS = 32


def _later(old: tuple, at: int | None, value) -> tuple:
    """The later of two decisions (time, value)."""
    new = (-1 if at is None else at, value)
    return old if value is None or (old[1] is not None and old >= new) else new


class DocumentReview(StatefulProcessor):
    """The matches of neighbouring documents and what was decided on them."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        more = () if self.ttl_ms is None else (self.ttl_ms,)
        # JSON, for each document: how many outcomes it had, the time of its last event (if they expire) and for each match whether
        # it is known, its selection and placeholder, and time and value of the last decision on each.
        self.state = handle.getValueState("documents", "documents string", *more)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        had = self.state.get()
        held = {} if had is None else json.loads(had[0])
        now = None
        if self.ttl_ms is not None:  # the value expires with its last document
            now = timerValues.getCurrentProcessingTimeInMs()
            held = {doc: x for doc, x in held.items() if now - x[1] < self.ttl_ms}
        changed: dict[str, set] = {}
        for _, doc_id, ids, flags, texts, match_id, selected, placeholder, at_us in rows:
            doc = str(doc_id)
            known = held.setdefault(doc, [0, now, {}])
            known[1], matches, mine = now, known[2], changed.setdefault(doc, set())
            if ids is not None:
                for name, flag, text in zip(ids, flags, texts):
                    matches.setdefault(name, [False, None, None, -1, None, -1, None])[:3] = True, flag, text
                mine.update(ids)
            else:
                s = matches.setdefault(match_id, [False, None, None, -1, None, -1, None])
                s[3:5] = _later((s[3], s[4]), at_us, selected)
                s[5:7] = _later((s[5], s[6]), at_us, placeholder)
                mine.add(match_id)
        docs, ids, seqs, flags, shown = [], [], [], [], []
        for doc, names in changed.items():
            known = held[doc]
            for name in sorted(names):
                s = known[2][name]
                if s[0]:
                    known[0] += 1
                    docs.append(int(doc))
                    ids.append(name)
                    seqs.append(known[0])
                    flags.append(s[1] if s[4] is None else s[4])
                    shown.append(s[2] if s[6] is None else s[6] or fixed.DELETED)
        self.state.update((json.dumps(held, separators=(",", ":")),))
        if docs:
            yield Row(docs=docs, ids=ids, seqs=seqs, selected=flags, shown=shown)

    def close(self) -> None:
        pass


def review_events(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """One stream of documents' matches (doc_id, matches) and decisions (doc_id, match_id, selected, placeholder, decided_at)."""
    named = F.filter("matches", lambda m: m["match_id"].isNotNull())
    none = lambda kind: F.lit(None).cast(kind)
    matches = docs.withColumn("m", named).filter(F.size("m") > 0).select(
        "doc_id", F.col("m.match_id").alias("ids"), F.col("m.selected").alias("flags"), F.col("m.placeholder").alias("texts"), none("string").alias("match_id"), none("boolean").alias("selected"), none("string").alias("placeholder"), none("long").alias("at_us")
    )
    decided = decisions.filter("match_id IS NOT NULL").select("doc_id", none("array<string>").alias("ids"), none("array<boolean>").alias("flags"), none("array<string>").alias("texts"), "match_id", "selected", "placeholder", F.unix_micros("decided_at").alias("at_us"))
    return matches.unionByName(decided).filter("doc_id IS NOT NULL").select(F.expr(f"(doc_id - pmod(doc_id, {NEIGHBOURS})) div {NEIGHBOURS}").alias("neighbours"), "*")


def start_review(docs: DataFrame, decisions: DataFrame, path: str, checkpoint: str, ttl_ms: int | None = None, **trigger) -> StreamingQuery:
    """Starts the query that appends outcomes to ``path``."""
    keyed = review_events(docs, decisions).groupBy("neighbours").transformWithState(DocumentReview(ttl_ms), OUTCOMES, "append", "none" if ttl_ms is None else "processingTime")
    each = keyed.select(F.explode(F.arrays_zip("docs", "ids", "seqs", "selected", "shown")).alias("m"))
    outcomes = each.select(F.col("m.docs").alias("doc_id"), F.col("m.ids").alias("match_id"), F.col("m.seqs").alias("seq"), F.col("m.selected").alias("selected"), F.col("m.shown").alias("placeholder"))
    writer = outcomes.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    with with_rocksdb(docs.sparkSession):
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def reviewed_matches(spark: SparkSession, path: str) -> DataFrame:
    """What holds: doc_id, match_id, selected, placeholder."""
    rows = spark.read.schema(OUTCOME).parquet(path)
    last = rows.groupBy("doc_id", "match_id").agg(F.max_by(F.struct("selected", "placeholder"), "seq").alias("x"))
    return last.select("doc_id", "match_id", "x.*")
