"""Run history as keyed streaming state: newest record of an id, newest ``most`` of a client, expiry by timers.

A stream of events (op, client_id, id, created_at, version, pos, counts) becomes a stream of changes. A client's state is its
valid records, 100 at most, the times of its deletions, and one timer at the time its oldest record expires, so records
leave without any input. ``created_at`` is a record's time, or the time at which a run was deleted, a client cleared or opted out;
what is deleted are records up to that time, whichever order events come in. Changes are appended (``put`` with the record,
``gone`` with the reason, ``opt_out`` and ``opt_in``) and numbered for each client; the file sink commits them once, and what is in force is the last change of each id.
A restart goes on from its checkpoint; a query with a new checkpoint takes over what is in force as its initial state (past deletions are not
taken over, so a record that was deleted and comes again afterwards is stored).

Defined cases: rows without a client are ignored; a record that is not valid when it comes (pattern of id or version, no counts, older than the
retention or later than now) is ignored; records of equal times are ordered by ``pos``; a null op is a record.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import fixed
from ..operators import history

COUNTS = "array<struct<category:string,replaced:long,kept:long>>"
KEPT = f"created_us long, pos long, version string, counts {COUNTS}"
CHANGES = f"client_id long, seq long, change string, reason string, id string, created_us long, pos long, version string, counts {COUNTS}"
DAY_MS = 24 * 60 * 60 * 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _counts(counts) -> list[tuple]:
    """Counts as plain tuples: input rows bring them as dictionaries, the state as rows."""
    return [(c["category"], c["replaced"], c["kept"]) if isinstance(c, dict) else tuple(c) for c in counts]


def _change(client: int, seq: int, change: str, reason: str | None, run: str, record: tuple) -> Row:
    created_us, pos, version, counts = record
    named = None if counts is None else [Row(category=c[0], replaced=c[1], kept=c[2]) for c in counts]
    return Row(client_id=client, seq=seq, change=change, reason=reason, id=run, created_us=created_us, pos=pos, version=version, counts=named)


class ClientHistory(StatefulProcessor):
    """The history of one client."""

    def __init__(self, now_us: int | None = None, days: int = fixed.HISTORY_DAYS, most: int = fixed.HISTORY_MOST):
        self.now_us, self.span_us, self.most = now_us, days * DAY_MS * 1000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "id string", KEPT)
        self.deletions = handle.getMapState("deletions", "id string", "at_us long")
        self.marks = handle.getValueState("marks", "cleared_us long, opted_out boolean, seq long, timer_ms long")

    def _now(self, timers) -> int:
        return timers.getCurrentProcessingTimeInMs() * 1000 if self.now_us is None else self.now_us

    def _load(self) -> None:
        self.records = {k[0]: (v[0], v[1], v[2], _counts(v[3])) for k, v in self.runs.iterator()}
        self.cleared, self.opted_out, self.seq, self.timer = self.marks.get() if self.marks.exists() else (None, False, 0, None)
        self.before = dict(self.records)

    def _expire(self, now: int) -> set[str]:
        gone = {i for i, r in self.records.items() if r[0] <= now - self.span_us}
        for i in gone:
            del self.records[i]
        for key, at in list(self.deletions.iterator()):
            if at[0] <= now - self.span_us:  # whatever it deletes has expired
                self.deletions.removeKey(key)
        return gone

    def _save(self, client: int, reasons: dict[str, str]) -> Iterator[Row]:
        """Stores what differs from the state, sets the timer and yields the changes."""
        changed = [(i, r) for i, r in self.records.items() if self.before.get(i) != r]
        for i in sorted(self.before.keys() - self.records.keys()):
            self.runs.removeKey((i,))
            self.seq += 1
            yield _change(client, self.seq, "gone", reasons.get(i, "cap"), i, (None, None, None, None))
        for i, r in sorted(changed, key=lambda x: (x[1][0], x[0])):
            self.runs.updateValue((i,), r)
            self.seq += 1
            yield _change(client, self.seq, "put", None, i, r)
        timer = None
        if self.now_us is None:
            ends = [r[0] for r in self.records.values()] + [at[0] for _, at in self.deletions.iterator()]
            timer = -(-(min(ends) + self.span_us) // 1000) if ends else None
            if timer != self.timer:
                if self.timer in set(self.handle.listTimers()):
                    self.handle.deleteTimer(self.timer)
                if timer is not None:
                    self.handle.registerTimer(timer)
        self.marks.update((self.cleared, self.opted_out, self.seq, timer))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        cleared, opted_out, seq, timer = self.marks.get() if self.marks.exists() else (None, False, 0, None)
        row = initialState
        if row.id is not None:
            self.runs.updateValue((row.id,), (row.created_us, row.pos, row.version, _counts(row.counts)))
            end = -(-(row.created_us + self.span_us) // 1000)
            if self.now_us is None and (timer is None or end < timer):
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timer := end)
        self.marks.update((cleared, opted_out or row.change == "opt_out", max(seq, row.seq), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        now, reasons, deleted = self._now(timerValues), {}, {}
        flags = []
        for row in rows:
            at = row.created_us
            if row.op == "delete":
                deleted[row.id] = max(at, deleted.get(row.id, at))
            elif row.op in ("clear", "opt_out", "opt_in"):
                flags.append((at, row.op))
                if row.op != "opt_in":
                    self.cleared = at if self.cleared is None else max(self.cleared, at)
            elif now - self.span_us < at <= now and (row.id not in self.records or (-at, row.pos) < (-self.records[row.id][0], self.records[row.id][1])):
                self.records[row.id] = (at, row.pos, row.version, _counts(row.counts))
                if len(self.records) > 2 * self.most and not deleted:
                    self._cap()
        was = self.opted_out
        for at, op in sorted(flags):
            if op != "clear":
                self.opted_out = op == "opt_out"
        if self.opted_out != was:
            self.seq += 1
            yield _change(key[0], self.seq, "opt_out" if self.opted_out else "opt_in", None, None, (None, None, None, None))
        for i, at in deleted.items():
            known = self.deletions.getValue((i,)) if self.deletions.containsKey((i,)) else None
            if known is None or known[0] < at:
                self.deletions.updateValue((i,), (at,))
        for i in self._expire(now):
            reasons[i] = "expired"
        for i, r in list(self.records.items()):
            known = self.deletions.getValue((i,)) if self.deletions.containsKey((i,)) else None
            if self.opted_out or (self.cleared is not None and r[0] <= self.cleared) or (known is not None and r[0] <= known[0]):
                reasons[i] = "deleted"
                del self.records[i]
        self._cap()
        yield from self._save(key[0], reasons)

    def _cap(self) -> None:
        first = sorted(self.records.items(), key=lambda x: (-x[1][0], x[1][1]))[: self.most]
        self.records = dict(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        self.timer = None  # it has fired
        yield from self._save(key[0], dict.fromkeys(self._expire(self._now(timerValues)), "expired"))

    def close(self) -> None:
        pass


def history_changes(events: DataFrame, now_us: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The changes that events make; ``now_us`` stops the clock (no timers), for replays of the past; ``initial`` are changes to start from."""
    op = F.coalesce("op", F.lit("record")) if "op" in events.columns else F.lit("record")
    counts = F.transform(history.clean_counts(F.col("counts")), lambda c: F.struct(c["category"].alias("category"), c["replaced"].alias("replaced"), c["kept"].alias("kept")))
    rows = events.select("client_id", op.alias("op"), "id", F.unix_micros("created_at").alias("created_us"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), "version", counts.alias("counts"))
    record = history.well_formed() & F.col("counts").isNotNull()
    known = F.when(F.col("op") == "record", record).when(F.col("op") == "delete", F.col("id").isNotNull()).otherwise(F.col("op").isin("clear", "opt_out", "opt_in"))
    good = rows.filter(F.col("client_id").isNotNull() & F.col("created_us").isNotNull() & known)
    return good.groupBy("client_id").transformWithState(ClientHistory(now_us), CHANGES, "append", "processingTime" if now_us is None else "none", None if initial is None else initial.groupBy("client_id"))


@contextmanager
def with_rocksdb(spark: SparkSession):
    """Queries that start meanwhile keep their state in RocksDB."""
    had = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # read when a query starts
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, had) if had else spark.conf.unset(PROVIDER)


def start_history(events: DataFrame, path: str, checkpoint: str, now_us: int | None = None, initial: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Starts the query that appends changes to ``path``; its state is in RocksDB under ``checkpoint``."""
    spark = events.sparkSession
    if now_us is None:  # a source that always has news: a restarted query otherwise waits for the first event before its timers count
        beat = spark.readStream.format("rate").load().filter(F.lit(False))
        events = events.unionByName(beat.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]))
    writer = history_changes(events, now_us, initial).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    with with_rocksdb(spark):
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def last_changes(spark: SparkSession, path: str) -> DataFrame:
    """Of each client and id the last change; of a client without an id the last opting in or out."""
    changes = spark.read.schema(CHANGES).parquet(path)
    rest = [c for c in changes.columns if c not in ("client_id", "id")]
    return changes.groupBy("client_id", "id").agg(F.max_by(F.struct(*rest), "seq").alias("x")).select("client_id", "id", "x.*").select(*changes.columns)


def taken_over(spark: SparkSession, path: str) -> DataFrame:
    """What a query with a new checkpoint starts from: the records in force, and each client's number of changes and choice."""
    last = last_changes(spark, path)
    choice = F.coalesce(F.max_by("change", F.when(F.col("id").isNull(), F.col("seq"))), F.lit("opt_in"))
    clients = last.groupBy("client_id").agg(F.max("seq").alias("seq"), choice.alias("change"))
    return last.filter("change = 'put'").unionByName(clients, allowMissingColumns=True)


def stored_history(spark: SparkSession, path: str) -> DataFrame:
    """The records in force."""
    last = last_changes(spark, path).filter("change = 'put'")
    return last.select("client_id", "id", F.timestamp_micros("created_us").alias("created_at"), "version", "pos", "counts")
