"""Work queue with a state machine, and an append-only event journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.filters import require
from gristmill.operators.rank import ranked

MAX_ATTEMPTS = 3
ACTIVE = ("pending", "running", "done")
NEXT = {"pending": ("running",), "running": ("done", "failed", "pending")}


def latest(jobs: DataFrame, by: str = "offer_id") -> DataFrame:
    """The last job of each offer: a maximum of structs, combined before the shuffle."""
    best = F.max(F.struct("created_at", "id", F.struct(*[c for c in jobs.columns if c not in (by, "created_at", "id")]).alias("_rest"))).alias("_b")
    return jobs.groupBy(by).agg(best).select(by, "_b.created_at", "_b.id", "_b._rest.*")


def positions(jobs: DataFrame) -> DataFrame:
    """Place of every pending job in the order of creation."""
    return ranked(jobs.where("status = 'pending'"), F.asc("created_at"), F.asc("id"), to="position")


def head(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'pending'").orderBy("created_at", "id").limit(1)


def recover(jobs: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Running jobs without a worker: back to pending, or failed after too many attempts."""
    orphan = F.col("status") == "running"
    spent = F.col("attempts") >= attempts
    return jobs.withColumns({"status": F.when(orphan & spent, "failed").when(orphan, "pending").otherwise(F.col("status")), "attempts": F.when(orphan & ~spent, F.col("attempts") + 1).otherwise(F.col("attempts"))})


def enqueue(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests whose content has no active job, once each (the least by its other columns); failed ones may come again."""
    rest = [c for c in requests.columns if c != "offer_hash"]
    once = requests.groupBy("offer_hash").agg(F.min(F.struct(*rest)).alias("_r")).select(*(F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in requests.columns)) if rest else requests.distinct()
    active = jobs.where(F.col("status").isin(*ACTIVE)).select("offer_hash").distinct()
    return once.join(active, "offer_hash", "left_anti")


def validate(requests: DataFrame, offers: DataFrame, texts: DataFrame, master: bool | Column = True) -> DataFrame:
    """``requests`` with ``outcome``: unknown offer, missing text, invalid master
    document (``master`` says whether it is valid, for all or by row), or accepted."""
    known = offers.select("offer_id", F.lit(True).alias("_known")).distinct()
    texted = texts.select("offer_id", F.lit(True).alias("_text")).distinct()
    outcome = F.when(F.col("_known").isNull(), "OFFER_NOT_FOUND").when(F.col("_text").isNull(), "TEXT_MISSING").when(~(master if isinstance(master, Column) else F.lit(master)), "MASTER_INVALID").otherwise("ACCEPTED")
    return requests.join(known, "offer_id", "left").join(texted, "offer_id", "left").withColumn("outcome", outcome).drop("_known", "_text")


def illegal_moves(events: DataFrame) -> DataFrame:
    """Events of (id, at, status) that don't follow from the job's state before."""
    before = F.lag("status", 1, None).over(Window.partitionBy("id").orderBy("at"))
    allowed = F.when(F.col("_from").isNull(), F.col("status") == "pending")
    for state, then in NEXT.items():
        allowed = allowed.when(F.col("_from") == state, F.col("status").isin(*then))
    return events.withColumn("_from", before).where(~allowed.otherwise(False)).withColumnRenamed("_from", "previous")


def moved(jobs: DataFrame, moves: DataFrame) -> DataFrame:
    """``jobs`` after ``moves`` (id, to), one a job; an error that names them if a move isn't allowed from the job's state."""
    both = jobs.join(moves.select("id", "to"), "id", "left")
    allowed = F.lit(False)
    for state, then in NEXT.items():
        allowed = allowed | ((F.col("status") == state) & F.col("to").isin(*then))
    checked = require(both, F.col("to").isNull() | allowed, "id", "illegal transition of job")
    return checked.withColumn("status", F.coalesce("to", "status")).select(*jobs.columns)


def repoint(children: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Children of keys that have moved, under their new key."""
    return children.join(moves.select(F.col("old").alias(key), "new"), key, "left").withColumn(key, F.coalesce("new", key)).drop("new")


def replay(events: DataFrame, by: str = "offer_id", order: str = "id") -> DataFrame:
    """State of each offer: its event with the greatest id, not the latest time, and the number of events."""
    rest = [c for c in events.columns if c not in (by, order)]
    found = events.groupBy(by).agg(F.max(F.struct(order, F.struct(*rest).alias("_rest"))).alias("_b"), F.count("*").alias("n_events"))
    return found.select(by, f"_b.{order}", "_b._rest.*", "n_events")


def running_state(events: DataFrame, value: str, by: str = "offer_id", order: str = "id", stretch: int = 1 << 16) -> DataFrame:
    """After each event, the state that a replay up to it would give, and the
    number of events so far. The event is the state: one that takes an opinion
    back leaves none. ``order`` is a unique integer.

    Events of one offer are taken in stretches of ``stretch`` ids, each a
    window of its own; the number of events before comes from one row for
    each, so an offer with very many events is spread over tasks."""
    part = events.withColumn("_part", F.floor(F.col(order) / stretch))
    inner = Window.partitionBy(by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = part.groupBy(by, "_part").agg(F.count("*").alias("_n")).select(by, "_part", F.sum("_n").over(before).alias("_n"))
    rows = part.withColumn("_so_far", F.count("*").over(inner))
    return rows.join(carried, [by, "_part"]).select(*events.columns, F.col(value).alias("state"), (F.col("_so_far") + F.coalesce("_n", F.lit(0))).alias("n_so_far"))


def opinions(state: DataFrame, verdict: str = "verdict") -> DataFrame:
    return state.where(F.col(verdict) != "none")
