"""Queries over state that is kept between runs: bucketed tables and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import store
from gristmill.plans.registry import query
from gristmill.session import cut, shared_dir
from gristmill.sources.adapters import table
from gristmill.sources.buckets import Buckets
from gristmill.streaming import state


def folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/gristmill-{tag}-{uuid.uuid4().hex}"


def _arriving(spark: SparkSession, sf_dir: str, files: int = 6, at_once: int = 2) -> DataFrame:
    """The events as a stream of files in order of time, two to a micro-batch."""
    path = folder(spark, "arriving")
    rows = table(spark, sf_dir, "events")
    ranges = cut(rows.repartitionByRange(files, "ts", "event_id").sortWithinPartitions("ts", "event_id").withColumn("_range", F.spark_partition_id()))
    for k in range(files):
        # A stream takes files as they were last written: in one job that is the order in which its tasks end.
        ranges.where(F.col("_range") == k).drop("_range").coalesce(1).sortWithinPartitions("ts", "event_id").write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(path)


SEEN = "key bigint, title string, first_seen date, last_seen date, days_seen int, first_run int, last_run int"


@query("""WITH r AS (SELECT user_id AS key, event_type AS title, event_id, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS run FROM events)
    SELECT key, arg_max(title, (run, event_id)) AS title, min(day) AS first_seen, max(day) AS last_seen, count(DISTINCT day) AS days_seen, min(run) AS first_run, max(run) AS last_run
        FROM r GROUP BY key""")
def upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a stream, several days to a micro-batch, merged key by key; every column comes from the stream's state."""
    day = F.to_date("ts")
    rows = _arriving(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_type").alias("title"), "event_id", day.alias("day"), F.unix_date(day).alias("run"))
    path = folder(spark, "runs")
    into = Buckets(spark, f"{path}/table", ("key",), SEEN, 16)
    state.run_to_buckets(state.seen_state(rows, "key", ("title",), order="event_id"), into, f"{path}/progress")
    return into.read()


@query("""WITH l AS (SELECT event_type AS source, 'l' || (event_id % 700) AS link, min(ts) AS first FROM events GROUP BY ALL)
    SELECT source, link, first FROM l WHERE first + INTERVAL 2 DAY < (SELECT max(ts) - INTERVAL 2 DAY FROM events)""")
def links_seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest sight of every link, told once by a stream when nothing earlier can come; links of the last days wait yet."""
    links = _arriving(spark, sf_dir).select(F.col("event_type").alias("source"), F.concat(F.lit("l"), (F.col("event_id") % 700).cast("string")).alias("link"), F.col("ts").cast("timestamp").alias("ts"))
    path, two_days = folder(spark, "sights"), 2 * 86400
    found = state.earliest_sight(links, ("source", "link"), "ts", two_days, 3650 * 86400)
    found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out").withColumn("first", F.col("first").cast("timestamp_ntz"))


@query("""WITH r AS (SELECT o_custkey AS key, o_orderkey, o_orderpriority AS title, CAST(o_orderkey % 4 AS INTEGER) AS run FROM orders WHERE o_orderkey % 4 < 2 OR o_custkey % 8 = 0)
    SELECT key, arg_max(title, (run, o_orderkey)) AS title, DATE '2024-01-01' + min(run) AS first_seen, DATE '2024-01-01' + max(run) AS last_seen, count(DISTINCT run) AS days_seen, min(run) AS first_run, max(run) AS last_run
        FROM r GROUP BY key""")
def bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs, a day each, merged into a bucketed table; the later ones bring few keys and rewrite only their buckets."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("title"), "o_orderkey", (F.col("o_orderkey") % 4).alias("run"))
    rows = rows.where("run < 2 OR key % 8 = 0")
    into = Buckets(spark, folder(spark, "upsert"), ("key",), SEEN, 32)
    for run in range(4):
        day = f"2024-01-{run + 1:02d}"
        batch = rows.where(F.col("run") == run).groupBy("key").agg(F.max_by("title", "o_orderkey").alias("title"))
        into.merge(batch, lambda old, new: store.upsert_seen(old, new, day, run, "key", ("title",)), run)
    return into.read()


@query("""WITH l AS (SELECT event_type AS source, 'l' || (event_id % 300) AS link, CAST(user_id AS VARCHAR) AS key, CAST(ts AS DATE) AS day, event_id FROM events), d AS (SELECT DISTINCT day FROM l ORDER BY day LIMIT 3)
    SELECT source, link, arg_max(key, (day, key)) AS key, min(day) AS first_seen, max(day) AS last_seen FROM l WHERE day IN (SELECT day FROM d) GROUP BY source, link""")
def bucketed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the first three days, merged day by day: one row for each source and link, with its first sight and the key that has it now."""
    day = F.to_date("ts")
    links = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.concat(F.lit("l"), (F.col("event_id") % 300).cast("string")).alias("link"), F.col("user_id").cast("string").alias("key"), day.alias("day"))
    days = [r[0] for r in links.select("day").distinct().orderBy("day").limit(3).collect()]
    into = Buckets(spark, folder(spark, "links"), ("source", "link"), "source string, link string, key string, first_seen date, last_seen date", 16)
    for n, d in enumerate(days):
        into.merge(links.where(F.col("day") == d), lambda old, new: store.upsert_links(old, new, str(d)), n)
    return into.read()


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN source || '+' ELSE source END AS text, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS at FROM documents""")
def bucketed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run brings texts for some keys and empty ones for others; an empty text overwrites nothing."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("text"), F.lit(1).alias("at"))
    second = rows.where("key % 5 < 2").select("key", F.when(F.col("key") % 5 == 0, F.concat("text", F.lit("+"))).otherwise(" ").alias("text"), F.lit(2).alias("at"))
    into = Buckets(spark, folder(spark, "texts"), ("key",), "key bigint, text string, at int", 16)
    for n, batch in enumerate((rows, second)):
        into.merge(batch, lambda old, new: store.keep_filled(old, new, "key", "text", "at"), n)
    return into.read()
