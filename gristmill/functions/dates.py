"""Dates in the formats that sources use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.columns import col

#: Formats tried after ISO, in this order; of numbers the month comes first where it can.
FORMATS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "M/d/yyyy", "d/M/yyyy", "M.d.yyyy", "d.M.yyyy", "yyyy/M/d"]
#: What reads like a date inside other text.
INSIDE = r"\d{4}-\d{2}-\d{2}|\d{1,2} [A-Za-z]{3,9} \d{4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}|\d{1,2}[/.]\d{1,2}[/.]\d{4}|\d{4}/\d{1,2}/\d{1,2}"


def parse_date(text: Column | str) -> Column:
    """The day of a date in ISO form, RFC 1123 (with or without its weekday), or
    one of FORMATS, alone or inside other text; null if there is none."""
    s = F.trim(col(text))
    bare = F.regexp_replace(s, r"^[A-Za-z]{3,9},\s*", "")
    found = F.regexp_extract(s, INSIDE, 0)
    whole = [F.try_to_timestamp(s), *(F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS)]
    return F.coalesce(*whole, F.try_to_timestamp(found), *(F.try_to_timestamp(found, F.lit(f)) for f in FORMATS[2:])).cast("date")


#: Beginnings of the months' and weekdays' names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
_NAMES = {m: f"{m}|{full}|{full[:4]}" for m, full in zip((*MONTHS, *WEEKDAYS), "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())}
#: Clock times with their zones, and what stands behind a day's number.
CLOCK, ORDINAL = r"t?\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*([ap]m\b)?\s*(z\b|[+-]\d{2}:?\d{2}\b)?", r"^(\d{1,2})(st|nd|rd|th)$"


def fuzzy_date(text: Column | str, reference: Column) -> Column:
    """The day that a free text names, in any order of its parts: a whole date
    as ``parse_date`` reads it; else a month by name, a year of four digits, a day
    of one or two (also 3rd, 21st), whichever are there, the others from
    ``reference`` (a day that the month lacks becomes its last); else the first weekday named, on
    ``reference`` or after it; else, where there is a clock time, ``reference``. Null where nothing is named."""
    low = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), CLOCK, " ")
    tokens = F.regexp_extract_all(low, F.lit("[0-9]+[a-z]*|[a-z]+"), F.lit(0))

    def told(t: Column) -> Column:
        first = lambda f: F.get(F.array_compact(F.transform(t, f)), F.lit(0))
        named = lambda names: first(lambda w: F.coalesce(*(F.when(w.rlike(f"^({_NAMES[m]})$"), k + 1) for k, m in enumerate(names))))
        month, weekday = named(MONTHS), named(WEEKDAYS)
        year = first(lambda w: F.when(w.rlike("^[12][0-9]{3}$"), w.cast("int")))
        number = lambda w: F.when(w.rlike("^[0-9]{1,2}$"), w.cast("int")).when(w.rlike(ORDINAL), F.regexp_extract(w, ORDINAL, 1).cast("int"))
        day = first(lambda w: F.when(number(w).between(1, 31), number(w)))
        start = F.make_date(F.coalesce(year, F.year(reference)), F.coalesce(month, F.month(reference)), F.lit(1))
        filled = F.date_add(start, F.least(F.coalesce(day, F.dayofmonth(reference)), F.dayofmonth(F.last_day(start))) - 1)
        ahead = F.date_add(reference, F.pmod(weekday - 1 - F.weekday(reference), F.lit(7)))
        return F.when(F.coalesce(month, year, day).isNotNull(), filled).otherwise(ahead)

    whole = F.when(F.trim(low) != "", parse_date(text))
    return F.coalesce(whole, F.transform(F.array(tokens), told)[0], F.when(F.lower(col(text)).rlike(CLOCK), reference))


#: The ages in days that a source accepts.
WINDOWS = [1, 3, 7, 14, 31]


def allowed_window(days: Column | str) -> Column:
    """The least of WINDOWS that covers so many days, else the greatest."""
    wide = F.filter(F.array(*map(F.lit, WINDOWS)), lambda w: w >= col(days))
    return F.coalesce(F.array_min(wide), F.lit(WINDOWS[-1]))
