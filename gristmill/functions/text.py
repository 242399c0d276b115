"""Text functions, Column to Column; all but ``unescape`` stay in the JVM."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.columns import col

EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
#: Month names in two languages, without accents.
MONTHS = {"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12, "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12}


def clean(text: Column | str) -> Column:
    """Never null, escapes repaired, trimmed of all Unicode white space."""
    return F.regexp_replace(repair_escapes(F.coalesce(col(text), F.lit(""))), EDGE, "")


def repair_escapes(text: Column | str) -> Column:
    """``u00e9`` left over from a JSON escape becomes its Latin-1 letter."""
    text = col(text)
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit("u00([0-9a-fA-F]{2})"), F.lit(1)))
    return F.when(~text.contains("u00"), text).otherwise(
        F.aggregate(codes, text, lambda out, h: F.replace(out, F.concat(F.lit("u00"), h), F.char(F.conv(h, 16, 10).cast("int"))))
    )


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All HTML5 character references; the JVM has no function for them."""
    return text.map(html.unescape, na_action="ignore")


#: Fixed value: tags that end a line of text; any other tag leaves nothing.
LINE_END = r"(?i)<\s*(br|/p|/div|/li)\s*/?\s*>"


def bare_html(text: Column | str) -> Column:
    """Text without tags; those that end a line become spaces."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), LINE_END, " "), "<[^>]+>", "")


def squeeze(text: Column | str) -> Column:
    """Runs of spaces, tabs and no-break spaces as one space, trimmed; line ends stay."""
    return F.regexp_replace(F.regexp_replace(col(text), "[ \t\u00a0]+", " "), EDGE, "")


def strip_html(text: Column | str, entities: bool = True) -> Column:
    """Readable text of HTML: without tags, references decoded, blanks collapsed."""
    bare = bare_html(text)
    return squeeze(unescape(bare) if entities else bare)


def _bare(c: int) -> str:
    """A letter or sign as Unicode's compatibility decomposition spells it, without marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))


def _decomposed() -> dict[str, str]:
    """What decomposes to plain letters and signs: accented letters, ligatures, numbers and letters in circles, wide forms."""
    blocks = (range(0xA0, 0x250), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0x2100, 0x2190), range(0x2460, 0x2500), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))
    pairs = {chr(c): _bare(c) for block in blocks for c in block}
    return {a: b for a, b in pairs.items() if a != b and b.isascii()}


def _plain_letters() -> tuple[str, str]:
    """Accented letters and other forms of one character, and that character."""
    pairs = [(a, b) for a, b in _decomposed().items() if len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccent(text: Column | str) -> Column:
    """Letters and signs in their plain forms: without marks, ligatures spelt out, circled
    and raised ones as themselves. Only a text's different characters outside ASCII are
    looked up, each once; what none of them changes is passed on as it is."""
    accented, plain = _plain_letters()
    long = {a: b for a, b in _decomposed().items() if len(b) > 1}
    table = F.create_map(*(F.lit(x) for kv in long.items() for x in kv))
    foreign = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"[^\x00-\x7F]"), F.lit(0)))
    bare = lambda c: F.regexp_replace(F.coalesce(F.try_element_at(table, c), F.translate(c, accented, plain)), r"\p{M}+", "")
    changed = lambda t: F.filter(F.transform(foreign(t), lambda c: F.struct(c.alias("c"), bare(c).alias("b"))), lambda x: x["c"] != x["b"])
    spelt = lambda t: F.aggregate(changed(t), t, lambda out, x: F.replace(out, x["c"], x["b"]))
    # An element of a lambda is computed once, however often it is named.
    return F.transform(F.array(col(text).cast("string")), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(spelt(t)))[0]


#: Letters that stand for the sexes in pairs, in either order, and those that may stand before or after a pair.
SEXES, OTHERS = ("hf", "mf", "mw"), ("", "d", "n", "x")
MARKERS = sorted({a + p + b for pair in SEXES for p in (pair, pair[::-1]) for a in OTHERS for b in OTHERS})
#: Any single ones of these letters joined by slashes or hyphens, in brackets or not.
_LETTER = "[" + "".join(sorted({c for m in MARKERS for c in m + m.upper()})) + "]"
LETTERS = rf"[(\[]?\s*\b{_LETTER}(?:\s*[/-]\s*{_LETTER}){{1,3}}\b\s*[)\]]?"


def without_markers(text: Column | str) -> Column:
    """``text`` with a space for every run of single letters that is one of MARKERS."""
    letters = lambda run: F.regexp_replace(F.lower(run), "[^a-z]", "")
    runs = lambda t: F.filter(F.regexp_extract_all(t, F.lit(LETTERS), F.lit(0)), lambda run: letters(run).isin(MARKERS))
    unmarked = lambda t: F.aggregate(runs(t), t, lambda out, run: F.replace(out, run, F.lit(" ")))
    # Every run has a slash or a hyphen; an element of a lambda is computed once.
    return F.transform(F.array(col(text)), lambda t: F.when(t.contains("/") | t.contains("-"), unmarked(t)).otherwise(t))[0]


def normal_title(title: Column | str) -> Column:
    """Lower case without accents or gender markers, words joined by single spaces."""
    return F.trim(F.regexp_replace(without_markers(F.lower(unaccent(title))), "[^a-z0-9]+", " "))


def presentable_title(title: Column | str) -> Column:
    """Without gender marker and duration, separators tidied; never empty when the title isn't."""
    short = F.regexp_replace(without_markers(title), r"(?i)[-,(]?\s*\b\d{1,2}\s*(months?|mois|weeks?|semaines?)\b\)?", " ")
    short = F.regexp_replace(F.regexp_replace(short, r"\s+", " "), r"^[\s,;:|–-]+|[\s,;:|–-]+$", "")
    return F.coalesce(F.nullif(short, F.lit("")), F.trim(col(title)))


def city_key(location: Column | str) -> Column:
    """Words of the first comma segment, lower case without accents; from the word Paris on, all is Paris."""
    first = F.lower(unaccent(F.split_part(F.coalesce(col(location), F.lit("")), F.lit(","), F.lit(1))))
    return F.trim(F.regexp_replace(F.regexp_replace(first, "[^a-z0-9]+", " "), r"\bparis\b.*", "paris"))


def slug(text: Column | str) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(unaccent(text)), F.lit("([a-z0-9]+)"), F.lit(1)), "_")


def word_form(text: Column | str) -> Column:
    """Words without accents, each between single spaces, for whole-word containment."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(unaccent(F.coalesce(col(text), F.lit("")))), r"[^a-z0-9]+", " ")), F.lit(" "))


def form_has(form: Column | str, words: list[str]) -> Column:
    """Whole-word test for any of the words or phrases in a ``word_form`` that is at hand."""
    found = F.lit(False)
    for w in words:
        found = found | col(form).contains(f" {w} ")
    return found


def has_word(text: Column | str, words: list[str]) -> Column:
    """Whole-word test for any of the words or phrases, without regard to case or
    accents. The form is made once for all words: an expression that is named
    several times is computed several times, an element of a lambda isn't."""
    return F.exists(F.array(word_form(text)), lambda form: form_has(form, words))


def families(text: Column | str, terms: dict[str, list[str]]) -> Column:
    """Names of the families of which a term occurs, in the given order."""
    names = F.transform(F.array(word_form(text)), lambda form: F.array_compact(F.array(*(F.when(form_has(form, words), F.lit(name)) for name, words in terms.items()))))
    return F.flatten(names)


def families_or(text: Column | str, terms: dict[str, list[str]], fallback: str = "terme_non_retrouve") -> Column:
    """``families``, or the fallback label alone where no term occurs."""
    return F.transform(F.array(families(text, terms)), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(fallback))))[0]


def ordered_tags(tags: Column | str) -> Column:
    """Trimmed tags without blanks, each where it came first; none for null."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(col(tags), lambda t: F.regexp_replace(t, EDGE, "")), lambda t: t != "")), F.array().cast("array<string>"))


#: What opens the part of an advert that says what the work is, without accents.
OPENINGS = [
    "vos missions", "vos principales missions", "votre mission", "mission:", "mission :", "missions:", "missions :", "ce que vous ferez", "votre role", "responsabilites", "responsibilities",
    "what you'll do", "your role", "the role", "descriptif du poste", "activites principales", "au sein de l'equipe", "rattach",
]


def window_from(text: Column | str, phrases: list[str], size: int = 600) -> Column:
    """``size`` characters from the first place of any of the phrases, else from
    the start. Phrases are sought without regard to case and accents; any white space counts as a space."""
    accented, bare = _plain_letters()
    low = F.lower(F.translate(col(text), accented + "\t\n\r\u00a0\u2019", bare + "    '"))
    first = F.array_min(F.filter(F.transform(F.array(*map(F.lit, phrases)), lambda p: F.position(p, low)), lambda at: at > 0))
    return F.substr(col(text), F.coalesce(first, F.lit(1)), F.lit(size))


def mission_excerpt(text: Column | str, size: int = 600) -> Column:
    """The part of a description that begins at what the work is, else its beginning."""
    return window_from(text, OPENINGS, size)


#: How a month and a week begin or read after a number, and words between two numbers of a range.
MONTH_WORDS, WEEK_WORDS, BETWEEN = ("mois", "month", "months"), ("semaine", "semaines"), ("a", "to")
MONTH_YEAR = "(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\s+(20\d\d)"
NUMERIC = r"\b(20\d\d)[-/](0?[1-9]|1[0-2])\b|\b(0?[1-9]|1[0-2])[-/](20\d\d)\b"


def duration_months(text: Column | str) -> Column:
    """The longest duration of 1 to 24 months named; else the first one in weeks, at least a month; else null.

    Told by tokens: numbers of one or two digits before a word for months, both of a range."""
    tokens = F.regexp_extract_all(F.lower(unaccent(text)), F.lit("[0-9]+|[a-z]+"), F.lit(0))

    def told(t: Column) -> Column:
        at = lambda i: F.coalesce(F.get(t, i), F.lit(""))
        number = lambda i: F.when(at(i).rlike("^[0-9]{1,2}$"), at(i).cast("int"))
        before = lambda i: F.array(number(i - 1), F.when(number(i - 1).isNotNull(), F.coalesce(number(i - 2), F.when(at(i - 2).isin(*BETWEEN), number(i - 3)))))
        months = F.flatten(F.transform(t, lambda w, i: F.when(w.isin(*MONTH_WORDS), before(i)).otherwise(F.array().cast("array<int>"))))
        weeks = F.get(F.array_compact(F.transform(t, lambda w, i: F.when(w.isin(*WEEK_WORDS), number(i - 1)))), F.lit(0))
        longest = F.array_max(F.filter(months, lambda m: m.between(1, 24)))
        return F.coalesce(longest, F.when(weeks >= 1, F.greatest(F.lit(1), F.bround(weeks / F.lit(4.33)).cast("int"))))

    return F.transform(F.array(tokens), told)[0]


def start_month(text: Column | str) -> Column:
    """``YYYY-MM`` of the first month name with a year, else of the first numeric date (year first or last)."""
    month = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))

    def told(low: Column) -> Column:
        part = lambda pattern, g: F.nullif(F.regexp_extract(low, pattern, g), F.lit(""))
        number = F.coalesce(part(NUMERIC, 2), part(NUMERIC, 3))
        named = F.concat(part(MONTH_YEAR, 2), F.lit("-"), F.lpad(F.try_element_at(month, part(MONTH_YEAR, 1)).cast("string"), 2, "0"))
        return F.when(low.rlike(r"20\d\d"), F.coalesce(named, F.concat(F.coalesce(part(NUMERIC, 1), part(NUMERIC, 4)), F.lit("-"), F.lpad(number, 2, "0"))))

    return F.transform(F.array(F.lower(unaccent(text))), told)[0]


#: Levels, and what in a free text stands for each, in the order they are tried.
LEVELS = {"senior": ["senior", "confirme", "expert"], "junior": ["junior", "debutant", "jeune diplome"], "stage": ["stag", "etudiant", "intern", "student"]}
UNKNOWN_LEVEL = "inconnu"


def level(text: Column | str) -> Column:
    """A free level as one of LEVELS or UNKNOWN_LEVEL."""
    low = F.trim(F.lower(unaccent(F.coalesce(col(text), F.lit("")))))
    out = F.lit(UNKNOWN_LEVEL)
    for name, signs in reversed(LEVELS.items()):
        found = F.lit(False)
        for sign in signs:
            found = found | low.contains(sign)
        out = F.when(found, name).otherwise(out)
    return F.when(low.isin(*LEVELS, UNKNOWN_LEVEL), low).otherwise(out)


def mask_secrets(text: Column | str) -> Column:
    """Values of key-like parameters and bearer tokens become asterisks."""
    return F.regexp_replace(F.regexp_replace(col(text), r"(?i)\b((?:api[_-]?|app[_-]?|client[_-]?)?(?:key|secret|token|id)=)[^&\s]+", "$1***"), r"(?i)(bearer\s+)\S+", "$1***")


def escape_html(text: Column | str) -> Column:
    out = F.coalesce(col(text), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def comment(text: Column | str) -> Column:
    return F.nullif(F.regexp_replace(col(text), EDGE, ""), F.lit(""))


def content_hash(*fields: Column | str) -> Column:
    """SHA-256 of the fields, trimmed and lower-cased; nulls count as empty, so fields can't shift."""
    return F.sha2(F.concat_ws("|", *(F.lower(F.trim(F.coalesce(col(f).cast("string"), F.lit("")))) for f in fields)), 256)


def refusal(level_name: Column | str, message: Column | str) -> Column:
    """Log lines as struct<category, blocking>: null unless an error or a status code; 429 or 'blocked' blocks."""
    low = F.lower(F.coalesce(col(message), F.lit("")))
    refused = (F.upper(col(level_name)) == "ERROR") | low.contains("status code")
    blocking = low.contains("429") | low.contains("blocked")
    kind = F.when(blocking, "blocked").when(low.contains("timeout") | low.contains("timed out"), "timeout").otherwise("refused")
    return F.when(refused, F.struct(kind.alias("category"), blocking.alias("blocking")))
