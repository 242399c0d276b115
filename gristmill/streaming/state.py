"""Structured Streaming twins of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from gristmill.operators.store import last_write
from gristmill.sources.buckets import Buckets


def feedback_state(events: DataFrame, by: str = "offer_id", order: str = "id") -> DataFrame:
    """Running replay: the event with the greatest id of each offer, and how many there were (update mode)."""
    rest = [c for c in events.columns if c not in (by, order)]
    found = events.groupBy(by).agg(F.max(F.struct(order, *rest)).alias("_b"), F.count("*").alias("n_events"))
    return found.select(by, "_b.*", "n_events")


def first_seen(links: DataFrame, at: str, delay: str, *keys: str) -> DataFrame:
    """Links not seen within the watermark: state is bounded by ``delay``."""
    return links.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def pace_windows(events: DataFrame, by: str, at: str, size: str, delay: str) -> DataFrame:
    """Counts of tumbling windows; late rows count up to ``delay``."""
    return events.withWatermark(at, delay).groupBy(F.window(at, size), by).agg(F.count("*").alias("n")).select(by, F.col("window.start").alias("start"), "n")


def run_to_table(stream: DataFrame, folder: str, *keys: str) -> DataFrame:
    """Runs a stream in update mode over all that is there, and returns the last
    row of each key. Each micro-batch is written by the tasks under its number, so
    one that comes again writes the same folder again; state and progress lie in
    the same shared folder. Nothing is collected."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/gm_batch={number}")

    running = stream.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    running.awaitTermination()
    schema = StructType([*stream.schema, StructField("gm_batch", IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{folder}/batches")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "gm_batch").alias("_last")).select(*keys, "_last.*")


def seen_state(runs: DataFrame, key: str, fields: tuple[str, ...], day: str = "day", run: str = "run", order: str | None = None) -> DataFrame:
    """(key, fields, first_seen, last_seen, days_seen, first_run, last_run) of every
    key that a micro-batch brings (update mode), as the runs merged one after another
    would leave them: ``fields`` of the last run (of its last row by ``order``), and
    as many days as there were, however they are spread over micro-batches and in
    whatever order they come. The state of a key is its days and one row."""
    last = F.max(F.struct(F.col(run), F.col(order) if order else F.lit(0), *(F.col(f) for f in fields))).alias("_last")
    found = runs.groupBy(key).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.size(F.collect_set(day)).alias("days_seen"), F.min(run).alias("first_run"), F.max(run).alias("last_run"), last)
    return found.select(key, *(F.col(f"_last.{f}").alias(f) for f in fields), "first_seen", "last_seen", "days_seen", "first_run", "last_run")


def run_to_buckets(stream: DataFrame, into: Buckets, progress: str) -> None:
    """Runs a stream in update mode over all that is there; the rows of each
    micro-batch replace those of equal key in a bucketed table. A batch that comes
    again after a failure writes its version again."""

    def step(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            into.merge(held, lambda old, new: last_write(old, new, *into.key), number + 1)
        finally:
            held.unpersist()

    stream.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def earliest_sight(links: DataFrame, keys: tuple[str, ...], at: str, delay_s: int, ttl_s: int) -> DataFrame:
    """(keys, first): of every link the earliest time that it was seen, told once
    (append mode), as soon as no earlier row can come.

    A link waits until the watermark is ``delay_s`` seconds behind its first sight;
    rows that come out of order until then set it back, those beyond the watermark
    are dropped. Afterwards it is remembered, and not told again, until it
    wasn't seen for ``ttl_s`` seconds."""
    late = links.select(*keys, F.col(at).cast("timestamp").alias("at")).withWatermark("at", f"{delay_s} seconds")
    kinds = ", ".join(f"`{k}` {late.schema[k].dataType.simpleString()}" for k in keys)

    def step(link: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, told = state.get if state.exists else (None, None, False)
        if state.hasTimedOut:
            if told:
                state.remove()
                return
            due = True
        else:
            for b in batches:
                micros = b["at"].astype("datetime64[us]").astype("int64")
                first = int(micros.min()) if first is None else min(first, int(micros.min()))
                last = int(micros.max()) if last is None else max(last, int(micros.max()))
            due = not told and first // 1000 + 1000 * delay_s < state.getCurrentWatermarkMs()  # as a timeout is
        if due:
            told = True
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, link)}, "first": [pd.Timestamp(first, unit="us", tz="UTC")]})
        state.update((first, last, told))
        state.setTimeoutTimestamp(max(last // 1000 + 1000 * ttl_s if told else first // 1000 + 1000 * delay_s, state.getCurrentWatermarkMs() + 1))

    return late.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, first timestamp", "first long, last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
