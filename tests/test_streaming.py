"""Streams give what the batch operators give."""

from __future__ import annotations

import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gristmill.plans import stored
from gristmill.operators.queue import replay
from gristmill.operators.store import last_write
from gristmill.sources.buckets import Buckets
from gristmill.streaming import state


def test_feedback_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 3, f"v{k}") for k in range(30)], "id long, offer_id long, verdict string")
    for part in range(3):
        rows.where(F.col("id") % 3 == (part + 1) % 3).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    found = state.run_to_table(state.feedback_state(stream), str(tmp_path / "out"), "offer_id")
    want = sorted(tuple(r) for r in replay(rows).select("offer_id", "id", "verdict", "n_events").collect())
    assert sorted(tuple(r) for r in found.select("offer_id", "id", "verdict", "n_events").collect()) == want


RUNS = "key long, title string, day date, run int, at int"
SEEN = "key long, title string, first_seen date, last_seen date, days_seen int, first_run int, last_run int"


def days(*rows):
    return [(k, t, date(2024, 1, d), d, n) for n, (k, t, d) in enumerate(rows)]


def landed(spark, folder, schema, *files):
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/f{n}")
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/f*")


def test_several_days_in_a_batch_and_over_restarts(spark, tmp_path):
    first = days((1, "z first", 1), (1, "a last", 3), (2, "x", 1))
    second = days((1, "later", 5), (3, "new", 4), (1, "b late day", 2), (2, "same day", 1))
    into = Buckets(spark, str(tmp_path / "table"), ("key",), SEEN, 4)
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, RUNS).coalesce(1).write.parquet(str(tmp_path / f"in/f{n}"))
        stream = spark.readStream.schema(RUNS).parquet(str(tmp_path / "in/f*"))
        state.run_to_buckets(state.seen_state(stream, "key", ("title",), order="at"), into, str(tmp_path / "progress"))
        if not n:
            d = lambda k: date(2024, 1, k)
            assert sorted(map(tuple, into.read().collect())) == [(1, "a last", d(1), d(3), 2, 1, 3), (2, "x", d(1), d(1), 1, 1, 1)]
    assert sorted(map(tuple, into.read().collect())) == [(1, "later", d(1), d(5), 4, 1, 5), (2, "same day", d(1), d(1), 1, 1, 1), (3, "new", d(4), d(4), 1, 4, 4)]


def test_earliest_sight_is_told_once(spark, tmp_path):
    h = lambda d, hour: datetime(2024, 1, d, hour, 0, 0, 123456)
    stream = landed(
        spark, str(tmp_path / "in"), "link string, at timestamp",
        [("a", h(1, 9)), ("a", h(1, 8)), ("b", h(1, 10))],
        [("a", h(1, 7)), ("c", h(1, 20))],  # earlier than the first batch's, within the watermark
        [("d", h(3, 0))],
        [("d", h(3, 0))],  # rows are late by the watermark of the batch before
        [("a", h(1, 1)), ("e", h(3, 1))],  # beyond the watermark: dropped
        [("a", h(4, 0)), ("f", h(6, 0))],  # seen again: not told again
    )
    found = state.earliest_sight(stream, ("link",), "at", 86400, 30 * 86400)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    told = sorted(tuple(r) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())
    assert told == [("a", h(1, 7)), ("b", h(1, 10)), ("c", h(1, 20)), ("d", h(3, 0)), ("e", h(3, 1))]


def numbers(into):
    return sorted(tuple(r) for r in into.read().collect())


def test_a_run_rewrites_only_its_buckets(spark, tmp_path):
    into = Buckets(spark, str(tmp_path), ("k",), "k long, v string", 64)
    assert numbers(into) == []
    put = lambda old, new: last_write(old, new, "k")
    into.merge(spark.createDataFrame([(k, "old") for k in range(1000)], "k long, v string"), put, 1)
    few = [(k, "new") for k in range(0, 1000, 100)]
    touched = into.merge(spark.createDataFrame(few, "k long, v string"), put, 2)
    assert len(touched) <= 10
    assert {p.name for p in (tmp_path / "data/gm_version=000000000002").glob("gm_bucket=*")} == {f"gm_bucket={b}" for b in touched}
    want = sorted((k, "new" if k % 100 == 0 else "old") for k in range(1000))
    assert numbers(into) == want
    assert into.merge(spark.createDataFrame([], "k long, v string"), put, 3) == [] and into.versions() == [1, 2]
    into.vacuum()
    assert numbers(into) == want and into.versions() == [2]
    with pytest.raises(ValueError, match="64 buckets"):
        Buckets(spark, str(tmp_path), ("k",), "k long, v string", 32).read()


def test_a_crash_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    into = Buckets(spark, str(tmp_path), ("k",), "k long, v string", 8, files=2)
    put = lambda old, new: last_write(old, new, "k")
    one, two = (spark.createDataFrame([(k, v) for k in range(50)], "k long, v string") for v in ("old", "new"))
    into.merge(one, put, 1)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Buckets, "_commit", crash)
        with pytest.raises(RuntimeError, match="lost"):
            into.merge(two, put, 2)
    assert numbers(into) == [(k, "old") for k in range(50)]
    into.merge(two, put, 2)
    into.merge(two, put, 2)  # the same run again
    assert numbers(into) == [(k, "new") for k in range(50)]


def test_files_arrive_in_order_of_time(spark, tmp_path, monkeypatch):
    """A stream takes files as they were last written, so none of an earlier time may be written later."""
    rows = spark.range(4000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.hash("id") % 100000).alias("ts"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(stored, "folder", lambda *_: str(tmp_path / "arriving"))
    stored._arriving(spark, str(tmp_path), files=24)
    files = sorted((tmp_path / "arriving").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    spans = [spark.read.parquet(str(f)).agg(F.min("ts"), F.max("ts")).first() for f in files]
    assert len(spans) == 24 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
