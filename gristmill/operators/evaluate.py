"""Ranking quality and corpus control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.rank import ranked


def metrics(ranking: DataFrame, k: int, rank: str = "rank", relevant: str = "relevant") -> DataFrame:
    """One row: precision_at_k, dcg, ndcg_at_k, median_rank of the relevant and
    negatives_in_top of a ranking from 1. Nothing relevant: nDCG 0, median
    null; k of 0 or an empty ranking: precision 0. The median is picked by its
    place among the relevant, so no task holds all ranks."""
    r, hit = F.col(rank), (F.col(relevant) > 0).cast("int")
    gain = F.lit(1.0) / F.log2(r + 1)
    found = ranking.agg(
        F.sum(F.when(r <= k, hit)).alias("hits"), F.count("*").alias("n"), F.sum(F.when((r <= k) & (hit > 0), gain)).alias("dcg"), F.sum(hit).alias("positives"),
        F.count_if((r <= k) & (hit == 0)).alias("negatives_in_top"),
    )
    found = found.join(F.broadcast(middle(ranking.where(hit > 0), rank, "median_rank")))
    ideal = F.aggregate(F.when(F.coalesce("positives", F.lit(0)) > 0, F.sequence(F.lit(1), F.least(F.lit(k).cast("long"), "positives").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1.0))
    return found.select(
        F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)), F.least(F.lit(k).cast("long"), "n")), F.lit(0.0)).alias("precision_at_k"),
        F.coalesce("dcg", F.lit(0.0)).alias("dcg"),
        F.coalesce(F.try_divide(F.coalesce("dcg", F.lit(0.0)), ideal), F.lit(0.0)).alias("ndcg_at_k"), "median_rank", "negatives_in_top",
    )


def middle(rows: DataFrame, value: str, to: str) -> DataFrame:
    """One row: the median of a column, as the mean of the one or two values in the middle of a global order."""
    placed = ranked(rows.where(F.col(value).isNotNull()).select(value), F.asc(value), to="_at")
    half = placed.agg(F.count("*").alias("_n")).select(((F.col("_n") + 1) / 2).cast("long").alias("_a"), (F.col("_n") / 2).cast("long").alias("_b"))
    return placed.join(F.broadcast(half), (F.col("_at") == F.col("_a")) | (F.col("_at") == F.col("_b") + 1)).agg(F.avg(value).alias(to))


def breakdown(corpus: DataFrame, limit: int = 600) -> DataFrame:
    """Labels by source and by length of text, and in all. Medians (the floor of
    the middle) are found by counting: rows become a count for each different
    length, these are added up in order, and the length at the middle is taken, so no
    task holds the lengths of all rows."""
    corpus = corpus.withColumn("bucket", F.when(F.length("text") > limit, "long").otherwise("short")).withColumn("_n", F.length("text"))
    lengths = corpus.groupBy("source", "bucket", "_n").agg(F.count_if(F.col("relevant") == 1).alias("yes"), F.count_if(F.col("relevant") == 0).alias("no"), F.count("*").alias("rows"))
    sums = [F.sum(c).alias(c) for c in ("yes", "no", "rows")]
    sets = lengths.groupingSets([[F.col("source"), F.col("_n")], [F.col("bucket"), F.col("_n")], [F.col("_n")]], F.col("source"), F.col("bucket"), F.col("_n")).agg(*sums, F.grouping_id().alias("_set"))
    same = ("_set", "source", "bucket")
    upto = sets.where("_n IS NOT NULL").withColumn("_upto", F.sum("rows").over(Window.partitionBy(*same).orderBy("_n"))).withColumn("_all", F.sum("rows").over(Window.partitionBy(*same)))
    half = lambda k: F.min(F.when(F.col("_upto") >= k, F.col("_n")))
    middle = upto.groupBy(*same).agg((half(F.ceil(F.col("_all") / 2)) + half(F.floor(F.col("_all") / 2) + 1)).alias("_two"))
    counts = sets.groupBy(*same).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    both = counts.join(middle.select(*(F.col(c).alias(f"_m{c}") for c in same), "_two"), F.expr(" AND ".join(f"{c} <=> _m{c}" for c in same)), "left")
    return both.select("source", "bucket", "yes", "no", F.floor(F.col("_two") / 2).cast("int").alias("median_length"))


def usable(corpus: DataFrame, least: int = 30, minority: int = 8) -> DataFrame:
    """(n, minority, usable) of a labelled corpus."""
    return corpus.agg(F.count("*").alias("n"), F.least(F.count_if(F.col("relevant") == 1), F.count_if(F.col("relevant") == 0)).alias("minority")).withColumn("usable", (F.col("n") >= least) & (F.col("minority") >= minority))


def match_labels(labels: DataFrame, offers: DataFrame) -> DataFrame:
    """``labels`` with ``status``: ok, missing (no such offer) or incoherent
    (the offer's key, derived again, differs)."""
    joined = labels.join(offers.select("key", F.col("derived").alias("_derived")), "key", "left")
    return joined.withColumn("status", F.when(F.col("_derived").isNull(), "missing").when(F.col("_derived") != F.col("key"), "incoherent").otherwise("ok")).drop("_derived")


def rank_delta(rows: DataFrame, first: str, second: str, order: str = "ord") -> DataFrame:
    """Ranks by two scores, and how far the second moves a row up."""
    one = ranked(rows, F.desc(first), F.asc(order), to="rank_first")
    two = ranked(one, F.desc(second), F.asc(order), to="rank_second")
    delta = F.col("rank_first") - F.col("rank_second")
    return two.withColumn("delta", delta).withColumn("move", F.when(delta > 0, "up").when(delta < 0, "down").otherwise("equal"))
