"""Semantic ranking: similarity to profiles, boosts, composition, top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.columns import col
from gristmill.functions.text import form_has, word_form
from gristmill.functions.vector import dot
from gristmill.session import cut

#: Boosts of a group's word, of both together, and the part that a description alone counts.
GROUP_BOOST, COMBO_BOOST, DESCRIPTION_PART = 0.05, 0.15, 0.4
TINY = 1e-9


def profile_similarity(offers: DataFrame, profiles: DataFrame, how: str = "max", vector: str = "embedding") -> DataFrame:
    """``offers`` with ``sims``: of its dot products with the profiles (vector,
    weight), the greatest times its weight, or the weighted mean. Profiles are a
    handful of reference texts: they become one array, checked to be at most
    1000, and no row is multiplied."""
    rows = profiles.select(F.col("vector").cast("array<double>").alias("vector"), F.col("weight").cast("double").alias("weight"), "profile").limit(1001)
    found = rows.agg(F.array_sort(F.collect_list(F.struct("profile", "weight", "vector"))).alias("_p"))
    if found.select(F.size("_p")).first()[0] > 1000:
        raise ValueError("more than 1000 profiles")
    both = offers.join(F.broadcast(found))
    each = lambda p: dot(F.col(vector), p["vector"])
    if how == "max":
        sims = F.array_max(F.transform("_p", lambda p: each(p) * p["weight"]))
    else:
        sims = F.aggregate("_p", F.lit(0.0), lambda s, p: s + each(p) * p["weight"]) / F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["weight"])
    return both.withColumn("sims", sims).drop("_p")


def normalised(rows: DataFrame, column: str = "sims", how: str = "minmax", to: str = "norm") -> DataFrame:
    """The column over its global range or spread (0 where that is tiny); one
    aggregate row is broadcast. ``rows`` are read twice, so they should be
    computed before (``cut``) where that is dear."""
    v = F.col(column)
    low, span = (F.min(v), F.max(v) - F.min(v)) if how == "minmax" else (F.avg(v), F.stddev_pop(v))
    stats = rows.agg(low.alias("_low"), span.alias("_span"))
    return rows.join(F.broadcast(stats)).withColumn(to, F.when(F.col("_span") > TINY, (v - F.col("_low")) / F.col("_span")).when(v.isNotNull(), 0.0)).drop("_low", "_span")


def boosts(offers: DataFrame, first: list[str], second: list[str], tags: tuple[str, str, str] = ("A", "B", "A+B")) -> DataFrame:
    """``boost`` and ``tags`` from two groups of words: full in the title, a part
    in the description; the combination needs both, one of them in the title.
    The forms of both texts are made once, as columns that are tested and dropped."""
    forms = offers.withColumns({"_title_form": word_form("title"), "_text_form": word_form("description")})
    found = {f"_{c}{k}": form_has(f"_{c}_form", words) for c in ("title", "text") for k, words in enumerate((first, second))}
    rows = forms.withColumns(found).drop("_title_form", "_text_form")
    in_title, in_text = ([F.col(f"_{c}{k}") for k in (0, 1)] for c in ("title", "text"))
    part = [F.when(t, GROUP_BOOST).when(d, GROUP_BOOST * DESCRIPTION_PART).otherwise(0.0) for t, d in zip(in_title, in_text)]
    has = [t | d for t, d in zip(in_title, in_text)]
    combo = has[0] & has[1] & (in_title[0] | in_title[1])
    named = F.array_compact(F.array(F.when(has[0], tags[0]), F.when(has[1], tags[1]), F.when(combo, tags[2])))
    made = {"boost": part[0] + part[1] + F.when(combo, COMBO_BOOST).otherwise(0.0), "tags": named, "combo": combo}
    return rows.withColumns(made).drop(*found)


def soft_signals(months: Column | str, start: Column | str, target: str) -> Column:
    """Small boosts for a long duration and a fitting start, a small malus for a short one."""
    m, s = col(months), col(start)
    length = F.when(m >= 6, 0.03).when(m < 4, -0.03).otherwise(0.0)
    return length + F.when(s == target, 0.02).when(F.substr(s, F.lit(1), F.lit(4)) == target[:4], 0.01).otherwise(0.0)


def compose(offers: DataFrame, mode: str, soft: Column | None = None) -> DataFrame:
    """``score`` from ``sims`` (and ``norm``), ``boost`` and a soft signal; in
    lexicographic mode the tier (``tier``) orders before the score. An offer
    whose similarity isn't known has no score, and comes last of its tier."""
    extra = F.col("boost") + (soft if soft is not None else F.lit(0.0))
    score = {
        "additive": F.when(F.col("sims").isNotNull(), F.least(F.lit(1.0), F.col("sims") + extra)) if "sims" in offers.columns else None,
        "additive_norm": F.col("norm") + extra if "norm" in offers.columns else None,
        "multiplicative": F.col("sims") * (1 + extra),
        "lexicographic": F.col("sims"),
    }[mode]
    tier = F.when(F.col("combo"), 2).when(F.col("boost") > 0, 1).otherwise(0) if mode == "lexicographic" else F.lit(0)
    return offers.withColumn("score", score).withColumn("tier", tier)


def top(offers: DataFrame, k: int, order: str = "ord") -> DataFrame:
    """The first k by tier, score and order, with ``rank`` from 1."""
    best = offers.orderBy(F.desc("tier"), F.desc("score"), order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tier"), F.desc("score"), order)))


def blend(offers: DataFrame, verdict: str = "verdict_score", weight: float = 0.5) -> DataFrame:
    """The score mixed with a verdict's; without a verdict it stays."""
    return offers.withColumn("final", F.coalesce((1 - weight) * F.col("score") + weight * F.col(verdict), F.col("score")))


#: Fixed value: the flag of a support occupation whose domain is only its company's.
SUPPORT_FLAG = "métier support (juridique/RH/marketing…) : le domaine IA/cyber vient de l'entreprise, pas du poste"


def support_rule(offers: DataFrame, support: Column, domain: str = "domain_match", flags: str = "flags") -> DataFrame:
    """A support occupation is off the domain, whatever the verdict says; the flag is added where that changes it."""
    changes = support & ~F.coalesce(~F.col(domain), F.lit(False))
    return offers.withColumns({flags: F.when(changes, F.concat(F.coalesce(flags, F.array().cast("array<string>")), F.array(F.lit(SUPPORT_FLAG)))).otherwise(F.col(flags)), domain: F.when(support, False).otherwise(F.col(domain))})


def capped(score: Column | str, apprenticeship: Column, off_domain: Column) -> Column:
    """The score, at most 0.2 for an apprenticeship and 0.3 off the domain."""
    most = lambda x: F.when(col(score) > x, x).otherwise(col(score))
    return F.when(apprenticeship, most(0.2)).when(off_domain, most(0.3)).otherwise(col(score))


def score_level(score: Column | str) -> Column:
    return F.when(col(score) >= 0.7, "high").when(col(score) >= 0.4, "middle").otherwise("low")


def ranked(rows: DataFrame, *order: Column, to: str = "rank", within: tuple[str, ...] = ()) -> DataFrame:
    """Position from 1. Without ``within`` the order is global: ranges of the
    sort key get offsets from their counts, so no task sees all rows. The sorted
    rows are computed once (``cut``): counts and rows must see the same ranges."""
    if within:
        return rows.withColumn(to, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    part = cut(rows.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = part.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_least"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    return part.join(F.broadcast(before.select("_p", "_least", F.coalesce("_before", F.lit(0)).alias("_before"))), "_p").withColumn(to, (F.col("_before") + F.col("_i") - F.col("_least") + 1).cast("int")).drop("_p", "_i", "_before", "_least")


def spread_sample(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """k rows at even distances of the order, first and last included; all if there are no more than k."""
    placed = ranked(rows, *order, to="_r")
    n = F.col("_n")
    chosen = rows.agg(F.count("*").alias("_n")).select(F.explode(F.when(n <= k, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(max(1, k - 1))).cast("long") + 1))).alias("_r"))
    return placed.join(F.broadcast(chosen.distinct()), "_r", "left_semi").drop("_r")


def seeded_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A fixed order that doesn't follow the key: that of the SHA-256 of key and seed."""
    return rows.withColumn("shuffle_key", F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256)).orderBy("shuffle_key", key)


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", most: int = 20_000) -> DataFrame:
    """(query, key, similarity, rank): the k nearest rows of each query by dot
    product. Queries go to every task in blocks of ``most``; a task keeps k
    rows of each query, and these meet in the shuffle by query."""
    spark, out = rows.sparkSession, None
    blocks = max(1, -(-queries.count() // most))
    for part in range(blocks):
        some = queries.where(F.col(vector).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(blocks)) == part)).select(key, vector).toArrow()
        if not some.num_rows:
            continue
        sent = spark.sparkContext.broadcast((some[key].to_numpy(), np.array(some[vector].to_pylist(), float)))

        def near(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, wanted = sent.value
            best_s, best_id = np.full((len(names), 0), 0.0), np.zeros((len(names), 0), np.int64)
            for b in batches:
                if b.empty:
                    continue
                ids, matrix = b[key].to_numpy(), np.stack(b[vector]).astype(float).T
                now_s, now_id = [], []
                for at in range(0, len(names), 256):
                    s = np.hstack([best_s[at : at + 256], (wanted[at : at + 256] @ matrix).round(9)])
                    every = np.hstack([best_id[at : at + 256], np.broadcast_to(ids, (len(s), len(ids)))])
                    order = np.lexsort((every, -s), axis=1)[:, :k]
                    now_s.append(np.take_along_axis(s, order, 1))
                    now_id.append(np.take_along_axis(every, order, 1))
                best_s, best_id = np.vstack(now_s), np.vstack(now_id)
            yield pd.DataFrame({"query": np.repeat(names, best_s.shape[1]), key: best_id.ravel(), "similarity": best_s.ravel()})

        found = rows.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(near, f"query long, {key} long, similarity double")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return rows.limit(0).select(F.col(key).alias("query"), key, F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
    return ranked(out, F.desc("similarity"), F.col(key), within=("query",)).where(F.col("rank") <= k)
