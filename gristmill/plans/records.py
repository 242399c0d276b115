"""Queries over runs, queues, journals, places and markets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.columns import json_or_null
from gristmill.functions.geo import haversine
from gristmill.operators import filters, geo, market, observe, queue, report, store
from gristmill.plans.registry import query
from gristmill.session import shared_dir
from gristmill.sources.adapters import jobs, journal, label_rows, places, run_links, table
from gristmill.streaming import state

JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS offer_id, sha256(o_custkey || '|' || o_orderpriority) AS offer_hash,
    CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END AS status, o_orderdate AS created_at, o_orderkey % 5 AS attempts FROM orders)"""
JOURNAL = """journal AS (SELECT event_id AS id, user_id AS offer_id, ts AS at, event_type AS kind, CASE event_type WHEN 'purchase' THEN 'good' WHEN 'error' THEN 'bad' ELSE 'none' END AS verdict, value, props
        FROM events)"""
LINKS = """links AS (SELECT CAST(ts AS DATE) AS day, event_type AS source, 'l' || (event_id % 700) AS link, user_id AS key FROM events)"""
PLACES = "places AS (SELECT c_custkey AS place, c_nationkey AS nation, 2.0 + (c_custkey % 97) / 100.0 AS lon, 48.4 + (c_custkey % 89) / 100.0 AS lat FROM customer)"
HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1, pow(sin((radians({3}) - radians({1})) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin((radians({2}) - radians({0})) / 2), 2))))"


def _origins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("centre", 2.35, 48.85), ("west", 2.1, 48.8), ("east", 2.8, 48.9)], "origin string, lon double, lat double")


ORIGINS = "origins AS (SELECT * FROM (VALUES ('centre', 2.35, 48.85), ('west', 2.1, 48.8), ('east', 2.8, 48.9)) o(origin, olon, olat))"
TRAVEL = f"""{PLACES}, {ORIGINS}, timed AS (SELECT place, origin, round({HAVERSINE.format('CAST(olon AS DOUBLE)', 'CAST(olat AS DOUBLE)', 'CAST(lon AS DOUBLE)', 'CAST(lat AS DOUBLE)')} * 1.3 / 50 * 60 * 1.3, 1) AS minutes
        FROM places, origins)"""


@query(f"WITH {JOBS} SELECT offer_id, id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY created_at DESC, id DESC) = 1")
def latest_job_per_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.latest(jobs(spark, sf_dir)).select("offer_id", "id", "status")


@query(f"WITH {JOBS} SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM jobs WHERE status = 'pending'")
def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.positions(jobs(spark, sf_dir)).select("id", "position")


@query(f"WITH {JOBS} SELECT id, offer_id FROM jobs WHERE status = 'pending' ORDER BY created_at, id LIMIT 1")
def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.head(jobs(spark, sf_dir)).select("id", "offer_id")


@query(f"WITH {JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY status")
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {JOBS} SELECT id, CASE WHEN status = 'running' AND attempts >= 3 THEN 'failed' WHEN status = 'running' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'running' AND attempts < 3 THEN attempts + 1 ELSE attempts END AS attempts
        FROM jobs""")
def recover_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.recover(jobs(spark, sf_dir)).select("id", "status", "attempts")


@query(f"""WITH {JOBS}, r AS (SELECT DISTINCT sha256(c_custkey || '|' || '1-URGENT') AS offer_hash, c_custkey AS offer_id FROM customer)
    SELECT offer_id FROM r WHERE offer_hash NOT IN (SELECT offer_hash FROM jobs)""")
def enqueue_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "customer").select(F.sha2(F.concat_ws("|", "c_custkey", F.lit("1-URGENT")), 256).alias("offer_hash"), F.col("c_custkey").alias("offer_id"))
    return queue.enqueue(jobs(spark, sf_dir), requests).select("offer_id")


@query("""SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL THEN 'OFFER_NOT_FOUND' WHEN c_acctbal < 0 THEN 'TEXT_MISSING' WHEN o_orderkey % 5 = 0 THEN 'MASTER_INVALID' ELSE 'ACCEPTED' END AS outcome
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) ON c_custkey = o_custkey""")
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").withColumnRenamed("c_custkey", "offer_id")
    return queue.validate(jobs(spark, sf_dir).select("id", "offer_id"), known, known.where("c_acctbal >= 0"), F.col("id") % 5 != 0).select("id", "outcome")


@query("SELECT c_custkey AS offer_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def offers_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("offer_id")).join(jobs(spark, sf_dir), "offer_id", "left_anti")


@query(f"WITH {JOBS} SELECT id FROM jobs WHERE offer_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def orphan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("offer_id"))
    return jobs(spark, sf_dir).join(known, "offer_id", "left_anti").select("id")


@query(f"WITH {JOURNAL} SELECT offer_id, arg_max(verdict, id) AS verdict, max(id) AS id, count(*) AS n_events FROM journal GROUP BY offer_id")
def feedback_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.replay(journal(spark, sf_dir)).select("offer_id", "verdict", "id", "n_events")


@query(f"WITH {JOURNAL}, s AS (SELECT offer_id, arg_max(verdict, id) AS verdict FROM journal GROUP BY offer_id) SELECT * FROM s WHERE verdict <> 'none'")
def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.opinions(queue.replay(journal(spark, sf_dir))).select("offer_id", "verdict")


@query(f"""WITH {JOURNAL} SELECT id, offer_id, arg_max(verdict, id) OVER (PARTITION BY offer_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS state,
    count(*) OVER (PARTITION BY offer_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS n_so_far FROM journal""")
def feedback_running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.running_state(journal(spark, sf_dir), "verdict").select("id", "offer_id", "state", "n_so_far")


@query(f"WITH {JOURNAL} SELECT id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM journal")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal(spark, sf_dir).select("id", json_or_null("props", "k bigint")["k"].alias("k"))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """Links of all runs before the last day, those of the last day, and that day."""
    links = run_links(spark, sf_dir)
    last = str(links.agg(F.max("day")).first()[0])
    return links.where(F.col("day") < last), links.where(F.col("day") == last), last


LAST = "(SELECT max(day) FROM links)"


@query(f"""WITH {LINKS}, old AS (SELECT * FROM links WHERE day < {LAST}), known AS (SELECT source, link, min(day) AS seen FROM old
        GROUP BY source, link), keys AS (SELECT key, min(day) AS seen FROM old WHERE key % 2 = 0 GROUP BY key),
    n AS (SELECT b.key, min(k.seen) AS link_seen FROM links b LEFT JOIN known k USING (source, link) WHERE b.day = {LAST} GROUP BY b.key)
    SELECT n.key, link_seen IS NULL AND seen IS NULL AS is_new, least(coalesce(link_seen, {LAST}), coalesce(seen, {LAST})) AS first_seen FROM n LEFT
        JOIN keys USING (key)""")
def link_novelty_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run against all before it; of the keys seen there, half are known as keys."""
    old, new, day = _runs(spark, sf_dir)
    known = old.groupBy("source", "link").agg(F.min("day").alias("first_seen"))
    return store.novelty(new, known, old.where(F.col("key") % 2 == 0).groupBy("key").agg(F.min("day").alias("first_seen")), day)


@query(f"""WITH {LINKS}, o AS (SELECT source, link, max(key) AS key, min(day) AS first_seen, max(day) AS last_seen FROM links WHERE day < {LAST}
        GROUP BY source, link), b AS (SELECT source, link, max(key) AS k FROM links WHERE day = {LAST} GROUP BY source, link)
    SELECT source, link, coalesce(k, key) AS key, coalesce(first_seen, {LAST}) AS first_seen, CASE WHEN k IS NOT NULL THEN {LAST} ELSE last_seen END AS last_seen
        FROM o FULL JOIN b USING (source, link)""")
def link_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, day = _runs(spark, sf_dir)
    return store.upsert_links(old.groupBy("source", "link").agg(F.max("key").alias("key"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen")), new, day)


@query(f"""WITH {LINKS} SELECT key, min(day) AS first_seen, max(day) AS last_seen, count(DISTINCT day) AS days_seen, CAST(max(day) = {LAST} AS INTEGER) AS in_last
        FROM links GROUP BY key""")
def offers_seen_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs: those before the last as the stored table, the last one as an upsert into it."""
    old, new, day = _runs(spark, sf_dir)
    stored = store.seen_from_runs(old.select("key", "day"))
    return store.upsert_seen(stored, new.select("key").distinct(), day, 1 << 30).select("key", "first_seen", "last_seen", "days_seen", (F.col("last_run") == 1 << 30).cast("int").alias("in_last"))


@query("""WITH l AS (SELECT l_orderkey AS key, l_suppkey AS source, l_partkey AS link
        FROM lineitem), o AS (SELECT o_orderkey AS key, o_orderkey % 3 AS last_run FROM orders)
    SELECT o.key, count(*) AS n_links, count(DISTINCT source) AS n_sources FROM o JOIN l USING (key) WHERE last_run = 2 GROUP BY o.key""")
def displayable_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers seen in run 2 that have a link."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("link"), F.col("l_shipdate").alias("first_seen"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 3).alias("last_run"), F.to_date("o_orderdate").alias("last_seen"))
    found = store.displayable(rows, links, 2, "2000-01-01")
    return found.select("key", F.size("links").cast("long").alias("n_links"), F.size(F.array_distinct(F.transform("links", lambda x: x["source"]))).cast("long").alias("n_sources"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS key FROM lineitem), d AS (SELECT max(CAST(o_orderdate AS DATE)) AS day
        FROM orders) SELECT o_orderkey AS key FROM orders, d WHERE CAST(o_orderdate AS DATE) = day AND o_orderkey IN (SELECT key FROM l)""")
def displayable_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a run from before runs were noted: the offers last seen on its day."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("link"), F.col("l_shipdate").alias("first_seen"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(None).cast("long").alias("last_run"), F.to_date("o_orderdate").alias("last_seen"))
    return store.displayable(rows, links, 2, str(rows.agg(F.max("last_seen")).first()[0])).select("key")


@query("SELECT l_suppkey AS source, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey")
def report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("source"))).alias("links"))
    return observe.source_counts(links, "links")


@query("SELECT c_name AS name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name")
def seeded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every customer, 0 where there is none."""
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return observe.seeded_counts(table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")), people, "name")


@query("""WITH a AS (SELECT p_partkey AS k, p_name AS v FROM part
        WHERE p_size <> 1), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) || '?' WHEN p_partkey % 4 = 1 THEN NULL ELSE p_name END AS v
        FROM part WHERE p_size <> 2)
    SELECT k, change FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS DISTINCT
        FROM b.v THEN 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k) WHERE change IS NOT NULL""")
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table of settings: each lacks some keys of the other."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"), "p_size")
    new = rows.where("p_size <> 2").withColumn("v", F.when(F.col("k") % 4 == 0, F.concat(F.upper("v"), F.lit("?"))).when(F.col("k") % 4 != 1, F.col("v")))
    return store.table_diff(rows.where("p_size <> 1"), new, "k", "v")


CELL = "coalesce(length({0}) || ':' || {0}, '-')"
PRINTED = {"o_custkey": "CAST(nullif(o_custkey, 7) AS VARCHAR)", "o_orderdate": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_orderpriority": "o_orderpriority", "o_orderstatus": "o_orderstatus"}


@query(f"""WITH d AS (SELECT greatest(0, CAST(ceil(log(greatest(1, count(*)) / 4096.0) / log(16)) AS INTEGER)) AS digits FROM orders),
    h AS (SELECT sha256({" || ".join(CELL.format(c) for c in PRINTED.values())}) AS h FROM orders),
    g AS (SELECT part || sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT h, substr(h, 1, digits) AS part FROM h, d WHERE digits > 0)
        GROUP BY part UNION ALL SELECT h FROM h, d WHERE digits = 0),
    w AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM g)
    SELECT sha256('{"".join(f"{len(c)}:{c}" for c in sorted(PRINTED))}|' || h) AS fingerprint FROM w""")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("o_custkey"), "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("o_orderdate"))
    return store.fingerprint(rows)


@query(f"""WITH {PLACES}, {ORIGINS} SELECT place, origin, round({HAVERSINE.format('CAST(olon AS DOUBLE)', 'CAST(olat AS DOUBLE)', 'CAST(lon AS DOUBLE)', 'CAST(lat AS DOUBLE)')}, 4) AS km
        FROM places, origins""")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = places(spark, sf_dir).join(F.broadcast(_origins(spark).withColumnsRenamed({"lon": "olon", "lat": "olat"})))
    return both.select("place", "origin", F.round(haversine("olon", "olat", "lon", "lat"), 4).alias("km"))


@query(f"WITH {TRAVEL} SELECT place, min(minutes) AS best, arg_min(origin, (minutes, origin)) AS nearest FROM timed GROUP BY place")
def nearest_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.travel(places(spark, sf_dir), _origins(spark)).select("place", "best", "nearest")


@query(f"WITH {TRAVEL} SELECT place FROM timed GROUP BY place HAVING min(minutes) < 45")
def travel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geo.travel(places(spark, sf_dir), _origins(spark))
    return found.where(filters.near_enough("travel", 45.0)).select("place")


@query("""WITH c AS (SELECT s_suppkey AS code, 'town' || (s_suppkey % 20) AS name, printf('%02d', CAST(s_nationkey AS INTEGER)) AS department
        FROM supplier), p AS (SELECT c_custkey AS ord, 'town' || (c_custkey % 25) AS name, printf('%02d', CAST(c_nationkey AS INTEGER)) AS cited
        FROM customer)
    SELECT ord, (SELECT arg_min(code, (CASE WHEN department = cited THEN 0 ELSE 1 END, code)) FROM c WHERE c.name = p.name) AS code FROM p""")
def homonym_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    town = lambda key, n: F.concat(F.lit("town"), F.pmod(key, F.lit(n)).cast("string"))
    communes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), town("s_suppkey", 20).alias("name"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("department"))
    where = F.concat(F.lit("Nowhere, "), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(" - "), F.upper(town("c_custkey", 25)), F.lit(" CEDEX 2"))
    return geo.resolve_commune(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), where.alias("location")), communes)


PACE = """w AS (SELECT event_type, count(*) FILTER (age BETWEEN 0 AND 6) AS short, count(*) FILTER (age BETWEEN 0 AND 30) AS long
        FROM (SELECT event_type, (SELECT max(CAST(ts AS DATE)) FROM events) - CAST(ts AS DATE) AS age FROM events) GROUP BY event_type),
    q AS (SELECT *, round(short / (long * 7 / 31.0), 2) AS pace FROM w)"""


@query(f"""WITH {PACE} SELECT event_type, short, long, pace, CASE WHEN pace >= 1.15 THEN 'accelerating' WHEN pace <= 0.85 THEN 'slowing' WHEN pace IS NULL THEN 'unknown' ELSE 'stable' END AS season
        FROM q""")
def pace_7_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.windows(table(spark, sf_dir, "events"), "event_type", "ts").select("event_type", "short", "long", "pace", "season")


@query("""WITH n AS (SELECT c_nationkey AS niche, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 4 END AS flow, c_custkey % 10 AS stock, CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE round(c_acctbal, 0) / 50000 END AS tension
        FROM customer), g AS (SELECT niche, sum(flow) AS flow, sum(stock) AS stock, round(avg(tension), 3) AS tension FROM n GROUP BY niche)
    SELECT niche, flow, stock, CASE WHEN flow >= 15 THEN 'comfortable' WHEN flow >= 5 THEN 'correct' WHEN flow IS NOT NULL THEN 'narrow' ELSE 'unknown' END AS flow_reading, CASE WHEN tension >= 0.05 THEN 'favourable' WHEN tension <= -0.05 THEN 'competitive' WHEN tension IS NOT NULL THEN 'balanced' ELSE 'unknown' END AS tension_reading
        FROM g""")
def market_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("niche"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 4).alias("flow"), (F.col("c_custkey") % 10).alias("stock"), F.when(F.col("c_nationkey") % 6 != 0, F.round("c_acctbal", 0) / 50000).alias("tension")
    )
    return market.reading(rows, "niche", "flow", "stock", "tension").drop("tension")


@query(f"""WITH {LINKS}, f AS (SELECT key, min(day) AS first FROM links
        GROUP BY key), r AS (SELECT l.day AS run, count(DISTINCT l.key) AS n, count(DISTINCT l.key) FILTER (first = l.day) AS n_new FROM links l
        JOIN f USING (key) GROUP BY l.day ORDER BY run DESC LIMIT 10)
    SELECT run, n, n_new, round(100.0 * n_new / n, 1) AS new_share FROM r""")
def renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = run_links(spark, sf_dir)
    first = links.groupBy("key").agg(F.min("day").alias("first"))
    runs = links.select("day", "key").distinct().join(first, "key").groupBy(F.col("day").alias("run")).agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("day")).alias("n_new"))
    return market.renewal(runs, 10)


@query("SELECT source AS company, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, company LIMIT 8")
def top_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("company")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(8)


@query("""WITH t AS (SELECT user_id AS key, CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS text, event_id AS seq FROM events), k AS (SELECT *
        FROM t WHERE text <> '' OR seq <= 2000)
    SELECT key, arg_max(text, seq) AS text, max(seq) AS seq FROM k GROUP BY key""")
def text_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("text"), F.col("event_id").alias("seq"))
    return store.keep_filled(rows.where("seq <= 2000"), rows.where("seq > 2000"), "key", "text", "seq")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its file or files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir, name))


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The table's own folder, or for a single file a pattern that is that file alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    store_ = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{sf_dir}/{name}.parquet" if store_.getFileStatus(path).isDirectory() else f"{sf_dir}/{name}.parquet*"


def _run_to_end(stream: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key of a stream over all that is there now, through the shared folder."""
    return state.run_to_table(stream, f"{shared_dir(stream.sparkSession)}/gristmill-stream-{uuid.uuid4().hex}", *keys)


@query(f"WITH {JOURNAL} SELECT offer_id, max(id) AS id, arg_max(verdict, id) AS verdict, count(*) AS n_events FROM journal GROUP BY offer_id")
def feedback_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "error", "bad").otherwise("none")
    rows = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("offer_id"), verdict.alias("verdict"))
    return _run_to_end(state.feedback_state(rows), "offer_id")


def _pace(spark: SparkSession, sf_dir: str, size: str) -> DataFrame:
    return _run_to_end(state.pace_windows(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", size, "40 days"), "event_type", "start")


@query("SELECT event_type, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY ALL")
def pace_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pace(spark, sf_dir, "7 days")


@query("SELECT event_type, time_bucket(INTERVAL '31 days', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY ALL")
def pace_stream_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pace(spark, sf_dir, "31 days")


@query("""WITH t AS (SELECT event_type AS code, date_trunc('month', ts - INTERVAL (event_id % 3) MONTH) AS period, 'K' || (event_id % 4) AS kind, round(value, 2) AS v
        FROM events),
    g AS (SELECT code, CAST(CAST(period AS DATE) AS VARCHAR) AS period, kind, CASE WHEN kind = 'K3' THEN NULL ELSE max(v) END AS v FROM t GROUP BY code, period, kind),
    n AS (SELECT * FROM g QUALIFY period = max(period) OVER (PARTITION BY code))
    SELECT code, period, max(CASE WHEN kind = 'K0' THEN v END) AS main, string_agg(kind, ','
        ORDER BY v IS NULL, v DESC, kind) FILTER (kind <> 'K0') AS details FROM n GROUP BY code, period""")
def tension_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tension of every code at its latest period: the main measure, and the others, unknown ones last."""
    events = table(spark, sf_dir, "events")
    period = F.trunc(F.add_months(F.to_date("ts"), -(F.col("event_id") % 3).cast("int")), "month").cast("string")
    rows = events.select(F.col("event_type").alias("code"), period.alias("period"), F.concat(F.lit("K"), (F.col("event_id") % 4).cast("string")).alias("kind"), F.round("value", 2).alias("v"))
    rows = rows.groupBy("code", "period", "kind").agg(F.max("v").alias("v")).withColumn("v", F.when(F.col("kind") != "K3", F.col("v")))
    found = market.latest_tension(rows, "code", "period", "kind", "v", "K0")
    return found.select("code", "period", "main", F.array_join(F.transform("details", lambda d: d["kind"]), ",").alias("details"))


@query("""SELECT c_custkey, s_suppkey AS code FROM customer LEFT
        JOIN supplier ON upper(CASE WHEN c_custkey % 2 = 0 THEN lower(s_name) ELSE s_name END) = upper('Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'))""")
def region_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of territories by their label, without regard to case."""
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("label"))
    asked = F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return market.territory_codes(table(spark, sf_dir, "customer").select("c_custkey", asked.alias("label")), places).select("c_custkey", "code")


@query("""SELECT doc_id AS key, quality AS relevant, CASE WHEN doc_id % 3 = 0 THEN 'corpus_aveugle' ELSE 'revue' END AS provenance, '' AS title FROM labels""")
def label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as landed JSON; those from before provenance was noted take the default."""
    labels = table(spark, sf_dir, "labels")
    said = F.to_json(F.struct(F.col("doc_id").cast("string").alias("cle"), F.col("quality").alias("pertinent"), F.when(F.col("doc_id") % 3 != 0, "revue").alias("provenance")))
    return label_rows(labels.select(said.alias("json"))).select(F.col("key").cast("long").alias("key"), "relevant", "provenance", "title")


@query("""WITH t AS (SELECT source, doc_id % 7 <> 0 AS ok, CASE WHEN doc_id % 5 = 0 THEN 'too_old' WHEN doc_id % 5 = 1 THEN 'off_topic' END AS reason, doc_id % 9 = 0 AS merged
        FROM documents),
    f AS (SELECT source AS nom, count(*) AS brut, count(*) FILTER (ok) AS normalisees, count(*) FILTER (ok AND reason IS NULL) AS survivantes, count(*) FILTER (ok AND reason IS NULL AND merged) AS fusions, count(*) FILTER (ok AND reason IS NULL AND NOT merged) AS retenues,
        count(*) FILTER (ok AND reason = 'off_topic') AS a, count(*) FILTER (ok AND reason = 'too_old') AS b FROM t GROUP BY source)
    SELECT '{"perimetre":"tous","sources":[' || string_agg('{"nom":"' || nom || '","brut":' || brut || ',"normalisees":' || normalisees || ',"survivantes":' || survivantes || ',"fusions":' || fusions || ',"retenues":' || retenues
        || ',"rejets":{' || concat_ws(',', CASE WHEN a > 0 THEN '"off_topic":' || a END, CASE WHEN b > 0 THEN '"too_old":' || b END) || '},"incidents":[' || CASE WHEN nom LIKE '%1' THEN '{"categorie":"http","detail":"HTTP 500"}' ELSE '' END || ']}', ','
        ORDER BY nom)
        || '],"familles":[{"nom":"x","brut":' || (SELECT count(*) FROM documents) || ',"survivantes":' || (SELECT count(*) FROM t
        WHERE ok AND reason IS NULL) || '}]}' AS json FROM f""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's whole report as one JSON text."""
    docs = table(spark, sf_dir, "documents")
    reason = F.when(F.col("doc_id") % 5 == 0, "too_old").when(F.col("doc_id") % 5 == 1, "off_topic")
    tagged = docs.select("source", (F.col("doc_id") % 7 != 0).alias("normalised"), reason.alias("reason"), (F.col("doc_id") % 9 == 0).alias("merged"))
    incidents = docs.select("source").distinct().where(F.col("source").endswith("1")).select("source", F.lit("http").alias("category"), F.lit("HTTP 500").alias("detail"))
    families = tagged.select(F.array(F.lit("x")).alias("families"), (F.col("normalised") & F.col("reason").isNull()).alias("survivor"))
    return observe.run_report(observe.funnel(tagged), observe.family_counts(families, "families", "survivor"), incidents, "tous")


@query(f"""WITH {JOBS}, l AS (SELECT offer_id, id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY offer_id
        ORDER BY created_at DESC, id DESC) = 1), p AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM jobs
        WHERE status = 'pending')
    SELECT c_custkey AS offer_id, coalesce(status, 'none') AS status, position, c_acctbal < 0 AS text_missing FROM customer LEFT
        JOIN l ON offer_id = c_custkey LEFT JOIN p USING (id)""")
def job_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("offer_id"), "c_acctbal")
    return report.job_board(people, jobs(spark, sf_dir), people.where("c_acctbal >= 0"))


@query("""WITH o AS (SELECT user_id AS key, max(CAST(ts AS DATE)) AS seen FROM events GROUP BY user_id), t AS (SELECT * FROM o WHERE key % 3 <> 0)
    SELECT seen, count(*) AS n, count(*) FILTER (key % 3 = 0) AS without_text, count(*) FILTER (key % 3 = 0 AND seen = (SELECT max(seen)
        FROM o)) AS recoverable FROM o GROUP BY seen""")
def last_seen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max(F.to_date("ts")).alias("seen"))
    return report.last_seen_counts(seen, seen.where("key % 3 <> 0"), "key", "seen")


@query("""WITH c AS (SELECT event_type, event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS s
        FROM events), f AS (SELECT event_type, min(event_id) AS first_id FROM c GROUP BY event_type)
    SELECT event_type, round(max(CASE WHEN event_id = first_id THEN s END), 6) AS first, round(round(avg(CASE WHEN event_id <> first_id THEN s END), 2), 1) AS mean_rest, count(*) FILTER (s IS NULL) AS failures
        FROM c JOIN f USING (event_type) GROUP BY event_type""")
def call_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("s"))
    return report.timings(calls, "event_type", "event_id", "s").select("event_type", F.round("first", 6).alias("first"), F.round("mean_rest", 1).alias("mean_rest"), "failures")


@query(f"WITH {PLACES} SELECT round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM places")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.centroid(places(spark, sf_dir)).select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("SELECT c_custkey, 1000 + c_custkey AS total, c_name AS words, CASE WHEN c_mktsegment = 'X' THEN c_name ELSE c_mktsegment || ' OR \"a b\"' END AS expression FROM customer".replace("c_name AS words", "array_to_string(regexp_extract_all(c_name, '[a-zA-Z0-9]{2,}'), ',') AS words"))
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = report.header_total(F.concat(F.lit("offers 0-149/"), (F.col("c_custkey") + 1000).cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", total.alias("total"), report.keywords("c_name").alias("words"), report.or_expression(F.array("c_mktsegment", F.lit("a b"))).alias("expression"))
