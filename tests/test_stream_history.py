"""Run history as keyed state: expiry by timers, restarts, deletions in any order, a new checkpoint."""

import time
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from veilspark.operators import history
from veilspark.streaming import history as stateful
from veilspark.streaming.jobs import read_stream

EVENT = "op string, " + history.RECORD + ", pos long"
OK = "2024.01.02.3+0123456789"


def run_id(n):
    return f"JQ-{n:08x}-0000-0000-0000-000000000000"


def event(client, n, at, op="record", pos=0):
    return (op, client, run_id(n) if n is not None else None, at, OK, [("amount", 1.0, 2.0)], pos)


def feed(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def held(spark, path):
    return sorted((r.client_id, r.id) for r in stateful.stored_history(spark, path).collect())


def replay(spark, tmp_path, batches, now, tag="x"):
    """Each batch in a run of its own on one checkpoint."""
    for rows in batches:
        feed(spark, str(tmp_path / f"in{tag}"), rows)
        stream = read_stream(spark, str(tmp_path / f"in{tag}"), spark.createDataFrame([], EVENT).schema)
        stateful.start_history(stream, str(tmp_path / f"out{tag}"), str(tmp_path / f"state{tag}"), int(now.timestamp() * 1_000_000), availableNow=True).awaitTermination()
    return str(tmp_path / f"out{tag}")


def test_records_expire_without_input_and_survive_a_restart(spark, tmp_path):
    old, now = timedelta(days=30), datetime.now()
    feed(spark, str(tmp_path / "in"), [event(1, 1, now - old + timedelta(seconds=60)), event(1, 2, now - timedelta(days=1)), event(2, 3, now - old + timedelta(seconds=60))])
    start = lambda: stateful.start_history(read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENT).schema), str(tmp_path / "out"), str(tmp_path / "state"))
    changes = lambda kind: spark.read.schema(stateful.CHANGES).parquet(str(tmp_path / "out")).filter(f"change = '{kind}'").count()

    def wait(kind, n):  # batches go on without input, so there is no end to wait for
        until = time.time() + 120
        while time.time() < until and query.isActive:
            try:
                if changes(kind) == n:
                    break
            except AnalysisException:  # no file yet
                pass
            time.sleep(1)
        query.stop()

    query = start()
    wait("put", 3)
    query = start()  # no event comes any more
    wait("gone", 2)
    assert changes("put") == 3
    assert held(spark, str(tmp_path / "out")) == [(1, run_id(2))]
    gone = spark.read.schema(stateful.CHANGES).parquet(str(tmp_path / "out")).filter("change = 'gone'").collect()
    assert sorted((r.client_id, r.id, r.reason) for r in gone) == [(1, run_id(1), "expired"), (2, run_id(3), "expired")]


def test_stream_equals_the_batch_over_many_micro_batches(spark, tmp_path):
    """Newest of an id, the cap and ties, whatever batch a record comes in."""
    now = datetime(2024, 2, 1)
    rows = [event(i % 2, (i * 37) % 170, now - timedelta(minutes=(i * 53) % 400), pos=i) for i in range(400)]
    rows += [event(1, 900, now + timedelta(seconds=1)), event(1, 901, now - timedelta(days=30)), event(None, 902, now)]
    path = replay(spark, tmp_path, [rows[:150], rows[150:160], rows[160:]], now)
    batch = history.cleaned(spark.createDataFrame([r[1:] for r in rows if r[1] is not None], EVENT.removeprefix("op string, ")), F.lit(now))
    shown = lambda d: sorted((r.client_id, r.id, r.pos, r.created_at, [tuple(c) for c in r.counts]) for r in d.collect())
    assert shown(stateful.stored_history(spark, path)) == shown(batch)


def test_deletions_hold_in_any_order(spark, tmp_path):
    now = datetime(2024, 2, 1)
    at = lambda n: now - timedelta(hours=n)
    events = [event(1, 1, at(5)), event(1, 1, at(4), "delete"), event(1, 2, at(5)), event(2, 3, at(5)), event(2, None, at(4), "clear"), event(2, 4, at(3)), event(3, 5, at(5)), event(3, None, at(2), "opt_out"), event(3, 6, at(1))]
    want = [(1, run_id(2)), (2, run_id(4))]
    for tag, batches in {"a": [events[:4], events[4:]], "b": [events[4:][::-1], events[:4][::-1]]}.items():
        assert held(spark, replay(spark, tmp_path, batches, now, tag)) == want, tag


def test_a_new_checkpoint_takes_over_what_is_in_force(spark, tmp_path):
    now = datetime(2024, 2, 1)
    at = lambda n: now - timedelta(hours=n)
    path = replay(spark, tmp_path, [[event(1, 1, at(5)), event(1, 2, at(4)), event(2, 3, at(5)), event(2, None, at(3), "opt_out")], [event(1, 2, at(3), "delete")]], now)
    feed(spark, str(tmp_path / "more"), [event(1, 7, at(2)), event(1, 1, at(1), "delete"), event(2, 8, at(1)), event(1, 2, at(1))])
    stream = read_stream(spark, str(tmp_path / "more"), spark.createDataFrame([], EVENT).schema)
    stateful.start_history(stream, path + "2", str(tmp_path / "new"), int(now.timestamp() * 1_000_000), stateful.taken_over(spark, path), availableNow=True).awaitTermination()
    both = spark.read.schema(stateful.CHANGES).parquet(path, path + "2")
    both.write.parquet(str(tmp_path / "all"))
    assert held(spark, str(tmp_path / "all")) == [(1, run_id(2)), (1, run_id(7))]
