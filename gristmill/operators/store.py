"""Longitudinal state: pure functions from the stored table and a batch to the
new table. Parquet has no MERGE, so an upsert is one full outer join and a
rewrite into a new version."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_seen(old: DataFrame, batch: DataFrame, today: str, run: int, key: str = "key", fields: tuple[str, ...] = ()) -> DataFrame:
    """(key, fields, first_seen, last_seen, days_seen, first_run, last_run).

    A new key starts today; a known one takes the batch's fields, keeps its
    first sight, and counts a day more unless it was seen today already. Keys
    that aren't in the batch stay as they are. A key must be unique in either."""
    new = batch.select(key, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_in"))
    day, seen = F.lit(today).cast("date"), F.coalesce("_in", F.lit(False))
    both = old.join(new, key, "full_outer")
    return both.select(
        key,
        *(F.when(seen, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields),
        F.coalesce("first_seen", day).alias("first_seen"),
        F.when(seen, day).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(F.col("days_seen").isNull(), 1).when(seen & (F.col("last_seen") != day), F.col("days_seen") + 1).otherwise(F.col("days_seen")).cast("int").alias("days_seen"),
        F.when(F.col("days_seen").isNull(), F.lit(run)).otherwise(F.col("first_run")).alias("first_run"),
        F.when(seen, F.lit(run)).otherwise(F.col("last_run")).alias("last_run"),
    )


def upsert_links(old: DataFrame, batch: DataFrame, today: str) -> DataFrame:
    """(source, link, key, first_seen, last_seen): a link keeps its first sight and takes the batch's key and date."""
    new = batch.select("source", "link", F.col("key").alias("_key")).groupBy("source", "link").agg(F.max("_key").alias("_key"))
    day = F.lit(today).cast("date")
    return old.join(new, ["source", "link"], "full_outer").select(
        "source", "link", F.coalesce("_key", "key").alias("key"), F.coalesce("first_seen", day).alias("first_seen"),
        F.when(F.col("_key").isNotNull(), day).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def novelty(batch_links: DataFrame, known_links: DataFrame, known_keys: DataFrame, today: str) -> DataFrame:
    """(key, is_new, first_seen) of each key of the batch: new if neither the key
    nor any of its links is known; first seen at the earliest of their dates."""
    linked = batch_links.join(known_links.select("source", "link", F.col("first_seen").alias("_link_seen")), ["source", "link"], "left")
    by_key = linked.groupBy("key").agg(F.min("_link_seen").alias("_link_seen"))
    found = by_key.join(known_keys.select("key", F.col("first_seen").alias("_key_seen")), "key", "left")
    return found.select("key", (F.col("_link_seen").isNull() & F.col("_key_seen").isNull()).alias("is_new"), F.least(F.coalesce("_link_seen", F.lit(today).cast("date")), F.coalesce("_key_seen", F.lit(today).cast("date"))).alias("first_seen"))


def keep_filled(old: DataFrame, batch: DataFrame, key: str, text: str, at: str) -> DataFrame:
    """Last write wins (of equal times the greater text), but an empty text never overwrites one."""
    both = old.select(key, text, at).unionByName(batch.where(F.coalesce(F.trim(text), F.lit("")) != "").select(key, text, at))
    return both.groupBy(key).agg(F.max(F.struct(at, text)).alias("_last")).select(key, F.col(f"_last.{text}").alias(text), F.col(f"_last.{at}").alias(at))


def last_write(old: DataFrame, batch: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``old`` replaced by those of ``batch`` with equal keys."""
    return old.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch, allowMissingColumns=True)


def append_missing(old: DataFrame, batch: DataFrame, *keys: str) -> DataFrame:
    """``old`` and the rows of ``batch`` whose keys it lacks."""
    return old.unionByName(batch.dropDuplicates(list(keys)).join(old.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def with_links(offers: DataFrame, links: DataFrame) -> DataFrame:
    """Offers that have a link, with their links in order of first sight."""
    nested = links.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "source", "link"))), lambda x: F.struct(x["source"].alias("source"), x["link"].alias("link"))).alias("links"))
    return offers.join(nested, "key")


def displayable(offers: DataFrame, links: DataFrame, run: int, day: str) -> DataFrame:
    """Offers seen in a run that have a link, with their links. If no offer notes
    this run at all, it is older than these notes: then those last seen on its day."""
    noted = offers.agg(F.coalesce(F.bool_or(F.col("last_run") == run), F.lit(False)).alias("_noted"))
    both = offers.join(F.broadcast(noted))
    seen = F.when(F.col("_noted"), F.col("last_run") == run).otherwise(F.col("last_seen") == F.lit(day).cast("date"))
    return with_links(both.where(seen).drop("_noted"), links)


def seen_from_runs(runs: DataFrame, key: str = "key", day: str = "day") -> DataFrame:
    """What ``upsert_seen`` gives after all runs of (key, day), one a day, in one
    pass; a run's number is its day's, counted from 1970."""
    number = lambda c: F.unix_date(c).cast("int")
    found = runs.select(key, day).distinct().groupBy(key).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.count("*").cast("int").alias("days_seen"))
    return found.withColumns({"first_run": number("first_seen"), "last_run": number("last_seen")})


def backfill(offers: DataFrame, texts: DataFrame, fetched: DataFrame, key: str = "key") -> DataFrame:
    """(outcome, n) of filling in missing texts: present, filled, empty or failed."""
    joined = offers.select(key).join(texts.select(key, F.lit(True).alias("_has")), key, "left").join(fetched.select(key, F.col("text").alias("_text"), F.lit(True).alias("_got")), key, "left")
    outcome = F.when(F.col("_has"), "present").when(F.coalesce(F.trim("_text"), F.lit("")) != "", "filled").when(F.col("_got"), "empty").otherwise("failed")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def table_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed; null-safe."""
    both = old.select(key, F.col(value).alias("_a"), F.lit(True).alias("_old")).join(new.select(key, F.col(value).alias("_b"), F.lit(True).alias("_new")), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


#: A fingerprint's lists of hashes: about so many a group.
GROUP = 4096


def fingerprint(rows: DataFrame) -> DataFrame:
    """(fingerprint): one SHA-256 of a table, of its column names and its rows,
    whatever their order and partitions.

    A row is hashed where it is: each cell as its length, a colon and its text,
    a null as a hyphen, so no two rows read alike. Equal keys are ordered by their
    hash. Rows meet in groups by the hash, of which there are as many as keep a group at
    about GROUP hashes, and groups meet in turn until one is left."""
    cells = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in sorted(rows.columns)]
    names = "".join(f"{len(c)}:{c}" for c in sorted(rows.columns))
    level = rows.select(F.sha2(F.concat(*cells), 256).alias("h"))
    digits = max(0, math.ceil(math.log(max(1, rows.count()) / GROUP, 16)))
    while True:
        groups = level.groupBy(F.substr("h", F.lit(1), F.lit(digits)).alias("part")) if digits else level.groupBy(F.lit("").alias("part"))
        level = groups.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("_h")).select(F.concat("part", "_h").alias("h"))
        if not digits:
            break
        digits = max(0, digits - 3)
    told = level.agg(F.coalesce(F.max("h"), F.sha2(F.lit("").cast("binary"), 256)).alias("h"))
    return told.select(F.sha2(F.concat(F.lit(names), F.lit("|"), "h"), 256).alias("fingerprint"))
