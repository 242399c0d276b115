"""Views of ranked offers, queues and runs for people: listings, counters, snapshots."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.columns import col
from gristmill.functions.text import EDGE, duration_months, start_month
from gristmill.operators.queue import latest, positions
from gristmill.operators.rank import blend, ranked


def annotate(offers: DataFrame) -> DataFrame:
    """Adds ``months`` and ``start`` from title and description."""
    text = F.concat_ws(". ", "title", "description")
    return offers.withColumns({"months": duration_months(text), "start": start_month(text)})


def verify_shortlist(rows: DataFrame, n: int, verdict: str = "verdict_score", weight: float = 0.5, order: str = "ord") -> DataFrame:
    """Of a ranking, the first n take their verdict's score, the rest keep
    theirs, and all are ranked again (``final``, ``new_rank``)."""
    first = F.col("rank") <= n
    mixed = blend(rows.withColumn("_verdict", F.when(first, F.col(verdict))), "_verdict", weight).drop("_verdict")
    return ranked(mixed, F.desc("final"), F.asc(order), to="new_rank")


def listing(rows: DataFrame, most: int = 140, flags: int = 3) -> DataFrame:
    """(rank, head, place, verdict, reason, url): the lines that a terminal shows
    of each offer. The head has rank, score, tags, a mark for a new one, title, duration
    and start; the verdict its score and what speaks against the offer, with the
    first flags; its reason is cut to ``most`` characters. Without a verdict these are null.
    ``rows``: rank, score, tags, new, title, months, start, company, location,
    source and a struct ``verdict`` (score, apprenticeship, level, flags, reason); ``url`` is optional."""
    part = lambda when, text: F.when(F.coalesce(when, F.lit(False)), text).otherwise("")
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    details = F.concat_ws(", ", F.when(F.col("months") > 0, F.concat(F.col("months").cast("string"), F.lit(" mois"))), F.when(F.col("start") != "", F.concat(F.lit("début "), "start")))
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    head = F.concat(
        F.format_string("#%-3d [%.3f]", F.col("rank").cast("int"), "score"), part(tags != "", F.concat(F.lit("  "), tags)), F.lit("  "), part(F.col("new"), F.lit("🆕 ")), "title", part(details != "", F.concat(F.lit("  ("), details, F.lit(")"))),
    )
    v = F.col("verdict")
    told = F.concat_ws(
        "  ", F.format_string("LLM %.2f", v["score"]), F.when(v["apprenticeship"], "⚠ alternance"), F.when(~v["level"].isin("", "stage", "inconnu"), F.concat(F.lit("niveau="), v["level"])),
        F.when(F.size(v["flags"]) > 0, F.concat(F.lit("🚩 "), F.array_join(F.slice(v["flags"], 1, flags), " ; "))),
    )
    reason = F.replace(F.regexp_replace(v["reason"], EDGE, ""), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(reason) > most, F.concat(F.substr(reason, F.lit(1), F.lit(most - 3)), F.lit("…"))).otherwise(reason)
    return rows.select(
        "rank", head.alias("head"), F.concat_ws("  |  ", named("company"), named("location"), named("source")).alias("place"), F.when(v.isNotNull(), told).alias("verdict"), F.when(reason != "", F.concat(F.lit("« "), short, F.lit(" »"))).alias("reason"),
        *(["url"] if "url" in rows.columns else []),
    )


def counters(rows: DataFrame, verified: Column, new: Column, combo: Column) -> DataFrame:
    """One row: how many there are, are verified, are new, and have both groups."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.agg(F.count("*").alias("total"), n(verified).alias("verified"), n(new).alias("new"), n(combo).alias("combo"))


def snapshot(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows as JSON text, numbers to three decimals, nulls kept."""
    types = dict(rows.dtypes)
    cells = [F.round(f, 3).alias(f) if types[f] in ("double", "float") else F.col(f) for f in fields]
    return rows.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("json"))


def last_seen_counts(offers: DataFrame, texts: DataFrame, key: str, seen: str) -> DataFrame:
    """By day of last sight: rows, and rows without a text that could still be fetched (seen on the last day)."""
    last = offers.agg(F.max(seen).alias("_last"))
    missing = offers.join(texts.select(key, F.lit(True).alias("_has")).distinct(), key, "left").join(F.broadcast(last))
    return missing.groupBy(seen).agg(F.count("*").alias("n"), F.count_if(F.col("_has").isNull()).alias("without_text"), F.count_if(F.col("_has").isNull() & (F.col(seen) == F.col("_last"))).alias("recoverable"))


def timings(calls: DataFrame, by: str, order: str, seconds: str) -> DataFrame:
    """First call apart, mean of the others to two decimals, and failures (null seconds)."""
    found = calls.groupBy(by).agg(F.min(F.struct(order, seconds))[seconds].alias("first"), F.sum(seconds).alias("_sum"), F.count(seconds).alias("_n"), F.count_if(F.col(seconds).isNull()).alias("failures"))
    rest = F.col("_n") - F.col("first").isNotNull().cast("int")
    mean = F.try_divide(F.col("_sum") - F.coalesce("first", F.lit(0.0)), F.nullif(rest, F.lit(0)))
    return found.select(by, "first", F.round(mean, 2).alias("mean_rest"), "failures")


def centroid(origins: DataFrame) -> DataFrame:
    return origins.agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def job_board(offers: DataFrame, jobs: DataFrame, texts: DataFrame) -> DataFrame:
    """Each offer with its last job's status, its place if that is pending, and whether its text is missing."""
    place = positions(jobs).select("id", "position")
    last = latest(jobs).select("offer_id", "id", "status").join(place, "id", "left")
    has = texts.select("offer_id", F.lit(True).alias("_has")).distinct()
    board = offers.select("offer_id").join(last, "offer_id", "left").join(has, "offer_id", "left")
    return board.select("offer_id", F.coalesce("status", F.lit("none")).alias("status"), "position", F.col("_has").isNull().alias("text_missing"))


def in_family(family: str, wide: bool = False) -> Column:
    """Whether an offer is of a family: by its title, or in the wide sense by the search that found it."""
    narrow = F.array_contains("title_families", family)
    return narrow | F.array_contains("families", family) if wide else narrow


def or_expression(terms: Column | str) -> Column:
    """A boolean query of an array of terms; terms of several words are quoted."""
    return F.array_join(F.transform(col(terms), lambda t: F.when(t.contains(" "), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)), " OR ")


def keywords(text: Column | str) -> Column:
    """Words of two letters or more, comma-joined, as a search interface wants them."""
    return F.array_join(F.filter(F.regexp_extract_all(col(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.length(w) >= 2), ",")


def header_total(header: Column | str) -> Column:
    """The total in a Content-Range header such as ``offers 0-149/1195``; null without one."""
    return F.nullif(F.regexp_extract(col(header), r"/(\d+)\s*$", 1), F.lit("")).cast("long")


def config_fingerprint(config: dict) -> str:
    """SHA-256 of a configuration's canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()
