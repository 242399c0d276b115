"""Market dashboard: pace, flow, tension, renewal. Unknown is never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.columns import col, share

SHORT_DAYS, LONG_DAYS = 7, 31


def pace(short: Column | str, long: Column | str) -> Column:
    """Rows of the short window over those that the long one makes one expect; null if that can't be told."""
    expected = col(long) * SHORT_DAYS / F.lit(float(LONG_DAYS))
    return F.round(F.try_divide(col(short).cast("double"), F.nullif(expected, F.lit(0.0))), 2)


def windows(events: DataFrame, by: str, at: str, end: Column | None = None) -> DataFrame:
    """Counts of the last 7 and 31 days before ``end`` (the last event), their pace and its reading."""
    last = events.agg(F.max(at).alias("_end"))
    rows = events.join(F.broadcast(last)) if end is None else events.withColumn("_end", end)
    age = F.datediff("_end", at)
    found = rows.groupBy(by).agg(F.count_if(age.between(0, SHORT_DAYS - 1)).alias("short"), F.count_if(age.between(0, LONG_DAYS - 1)).alias("long"))
    return found.withColumn("pace", pace("short", "long")).withColumn("season", season("pace"))


def season(value: Column | str) -> Column:
    return F.when(col(value) >= 1.15, "accelerating").when(col(value) <= 0.85, "slowing").when(col(value).isNotNull(), "stable").otherwise("unknown")


def flow(n: Column | str) -> Column:
    return F.when(col(n) >= 15, "comfortable").when(col(n) >= 5, "correct").when(col(n).isNotNull(), "narrow").otherwise("unknown")


def tension(value: Column | str) -> Column:
    return F.when(col(value) >= 0.05, "favourable").when(col(value) <= -0.05, "competitive").when(col(value).isNotNull(), "balanced").otherwise("unknown")


def reading(niches: DataFrame, by: str, flow_col: str, stock_col: str, tension_col: str) -> DataFrame:
    """Flow, stock and mean tension of each group; nulls are left out, and a group without a measure is unknown."""
    found = niches.groupBy(by).agg(F.sum(flow_col).alias("flow"), F.sum(stock_col).alias("stock"), F.round(F.avg(tension_col), 3).alias("tension"))
    return found.withColumn("flow_reading", flow("flow")).withColumn("tension_reading", tension("tension"))


def renewal(runs: DataFrame, last: int) -> DataFrame:
    """The last runs in order, with the share of new rows."""
    return runs.orderBy(F.desc("run")).limit(last).withColumn("new_share", share("n_new", "n")).orderBy("run")


def latest_tension(rows: DataFrame, code: str, period: str, kind: str, value: str, main: str) -> DataFrame:
    """(code, period, main, details) of every code at its latest period alone, so
    that years don't mix: the value of the main kind (null if it wasn't measured)
    and the other kinds with their values, greatest first, unknown ones last."""
    last = rows.groupBy(code).agg(F.max(period).alias(period))
    other = F.struct(F.col(value).isNull().alias("unknown"), (-F.coalesce(F.col(value), F.lit(0.0))).alias("order"), F.col(kind).alias("kind"), F.col(value).alias("value"))
    found = rows.join(last, [code, period]).groupBy(code, period).agg(F.max(F.when(F.col(kind) == main, F.col(value))).alias("main"), F.array_sort(F.collect_list(F.when(F.col(kind) != main, other))).alias("_d"))
    return found.select(code, period, "main", F.transform("_d", lambda d: F.struct(d["kind"].alias("kind"), d["value"].alias("value"))).alias("details"))


def territory_codes(asked: DataFrame, territories: DataFrame, label: str = "label") -> DataFrame:
    """``asked`` with the code of the territory whose label is the same but for case and a circumflex on the I."""
    same = lambda c: F.translate(F.upper(c), "Î", "I")
    known = territories.groupBy(same(label).alias("_label")).agg(F.min("code").alias("code"))
    return asked.withColumn("_label", same(label)).join(known, "_label", "left").drop("_label")


def best_occupations(said: DataFrame, title: str = "title", code: str = "code", score: str = "score") -> DataFrame:
    """(title, occupations): each occupation code that was said of a title once, with its best score, best first."""
    best = said.groupBy(title, code).agg(F.max(score).alias(score))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("o"), F.col(code).alias("code"), F.col(score).alias("score"))))
    return best.groupBy(title).agg(ordered.alias("_o")).select(title, F.transform("_o", lambda x: F.struct(x["code"].alias("code"), x["score"].alias("score"))).alias("occupations"))
