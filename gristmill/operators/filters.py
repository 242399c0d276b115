"""Filters with recorded reasons. The reference date is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.columns import col
from gristmill.functions.text import form_has, has_word, word_form


def age_days(posted: Column | str, today: Column | str) -> Column:
    return F.datediff(col(today), col(posted))


def fresh(posted: Column | str, today: Column | str, days: int, unknown: bool = False) -> Column:
    """Not older than ``days`` and at most a day ahead; an unknown date gives ``unknown``."""
    return F.coalesce(age_days(posted, today).between(-1, days), F.lit(unknown))


def first_reason(**rules: Column) -> Column:
    """The name of the first rule that a row breaks, in the given order; null if it keeps all."""
    out = F.lit(None).cast("string")
    for name, keeps in reversed(rules.items()):
        out = F.when(~F.coalesce(keeps, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def reject_reasons(offers: DataFrame, wanted: list[str], unwanted: list[str], regions: list[str], today: str, days: int, exempt: list[str] = ()) -> DataFrame:
    """``offers`` with ``reason``: title without a wanted word, with an unwanted
    one, outside the regions, or too old (but for exempt companies); null if
    kept. One pass: kept and rejected rows are both in it."""
    current = fresh("posted_at", F.lit(today).cast("date"), days)
    if exempt:
        current = current | F.col("company").isin(*exempt)
    form = F.col("_form")
    rules = {"off_topic": form_has(form, wanted), "excluded": ~form_has(form, unwanted), "off_region": F.col("location").isin(*regions), "too_old": current}
    return offers.withColumn("_form", word_form("title")).withColumn("reason", first_reason(**rules)).drop("_form")


def soft_flag(offers: DataFrame, name: str, when: Column) -> DataFrame:
    """Adds a flag once to ``flags`` where a condition holds."""
    return offers.withColumn("flags", F.when(when, F.array_union("flags", F.array(F.lit(name)))).otherwise(F.col("flags")))


def near_enough(travel: Column | str, most: float) -> Column:
    """For a map of origin to minutes: under ``most`` for one origin at least, or nothing known."""
    values = F.map_values(col(travel))
    return (F.size(values) == 0) | F.exists(values, lambda m: m < most)


def over_threshold(offers: DataFrame, least: float, override: str | None = None) -> DataFrame:
    keep = F.col("score") >= least
    return offers.where(keep | F.array_contains("tags", override) if override else keep)


def support_only(title: Column | str, support: list[str], core: list[str]) -> Column:
    """A support occupation without a sign of the core domains."""
    return has_word(title, support) & ~has_word(title, core)


def only_new(offers: DataFrame, new_keys: DataFrame, key: str = "key") -> DataFrame:
    return offers.join(new_keys.select(key).distinct(), key, "left_semi")


def by_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """The row whose key starts with ``prefix``; an error if several do."""
    found = rows.where(F.col(key).startswith(prefix))
    if len(found.select(key).distinct().take(2)) > 1:
        raise ValueError(f"{prefix!r} starts more than one key")
    return found


def require(rows: DataFrame, holds: Column, naming: str, message: str) -> DataFrame:
    """``rows`` if all hold; else an error that names the first offenders."""
    if bad := [r[0] for r in rows.where(~F.coalesce(holds, F.lit(False))).select(F.col(naming).cast("string")).take(5)]:
        raise ValueError(f"{message}: {', '.join(map(str, bad))}")
    return rows


def search(rows: DataFrame, words: str, *fields: str) -> DataFrame:
    """Substring search over several fields, without regard to case."""
    return rows.where(F.lower(F.concat_ws(" ", *fields)).contains(words.lower()))
