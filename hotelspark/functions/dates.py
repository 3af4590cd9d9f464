"""Date and time normalisers.

The accepted shapes are told apart by one regular expression each and the value is built from its
numeric parts, so a bad value gives null and never raises under ANSI mode.
"""

from __future__ import annotations

import calendar
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hotelspark.functions.text import is_blank, is_blank_any_case
from hotelspark.session import HOTEL_ZONE

_DATE = r"(\d{1,4})[-/](\d{1,2})[-/](\d{1,4})"
# A date of three numbers, an optional time with : or . between its parts, and a zone only after a time.
_STAMP = (
    "^" + _DATE + r"(?:(?:\s+|[Tt])(\d{1,2})[:.](\d{1,2})(?:[:.](\d{1,2})(?:\.\d{1,9})?)?"
    r"\s*(Z|[+-](?:0\d|1[0-7])(?::?[0-5]\d)?)?)?$"
)
_DAY = "^" + _DATE.replace("-/", "-/.") + r"(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:?\d{2})?)?$"
_NAMED = r"(?i)^(?:(\d{1,2})[-\s]+)?([a-z]{3,9})(?:[-\s]+(\d{1,2}))?[-,\s]+(\d{4}|\d{2})$"
_MONTHS = tuple(name.lower() for name in calendar.month_name[1:])


def _with_parts(s: Column, pattern: str, groups: int, build: Callable[[Column], Column]) -> Column:
    """``build`` applied to the captured groups as an array; null when the pattern does not match.

    The pattern is run once per value: the lambda binds its result, where a plain expression would repeat it.
    """
    marks = "|".join(f"${i + 1}" for i in range(groups))
    parts = F.split(F.regexp_replace(s, pattern, marks), r"\|", -1)
    return F.transform(F.array(parts), lambda x: F.when(F.size(x) == groups, build(x)))[0]


def _long_year(two_digits: Column) -> Column:
    """69-99 are 19xx, others 20xx."""
    return F.concat(F.when(two_digits < "69", F.lit("20")).otherwise(F.lit("19")), two_digits)


def _read_date(x: Column, read: Callable[[Column], Column], month_first: bool, short_years: str = "") -> Column:
    """A date from three texts: a four-digit year in front or behind; month and day in the preferred order,
    then the other. ``short_years`` names the orders allowed with a two-digit year: "d" day first, "dm" both.

    ``read`` gets ISO text. Casting text is far cheaper than building dates from parsed numbers.
    """
    at = lambda y, m, d: read(F.concat(y, F.lit("-"), m, F.lit("-"), d))
    a, b, c = x[0], x[1], x[2]
    orders = ((a, b), (b, a)) if month_first else ((b, a), (a, b))
    out = F.when((F.length(a) == 4) & (F.length(c) <= 2), at(a, b, c)).when(
        (F.length(c) == 4) & (F.length(a) <= 2), F.coalesce(*[at(c, m, d) for m, d in orders])
    )
    if not short_years:
        return out
    readings = [at(_long_year(c), *({"d": (b, a), "m": (a, b)}[o])) for o in short_years]
    return out.when((F.length(c) == 2) & (F.length(a) <= 2), F.coalesce(*readings))


def _stamp(s: Column, short_years: str = "") -> Column:
    def build(x: Column) -> Column:
        or_zero = lambda c: F.when(c == "", F.lit("0")).otherwise(c)
        clock = F.concat(F.lit(" "), or_zero(x[3]), F.lit(":"), or_zero(x[4]), F.lit(":"), or_zero(x[5]))
        at = _read_date(x, lambda day: F.concat(day, clock).try_cast("timestamp_ntz"), True, short_years)
        zone = F.when(F.length(x[6]) == 5, F.concat(F.substring(x[6], 1, 3), F.lit(":"), F.substring(x[6], 4, 2))).otherwise(x[6])
        return F.when(x[6] == "", at).otherwise(F.convert_timezone(zone, F.lit(HOTEL_ZONE), at))
    return _with_parts(s, _STAMP, 7, build)


def parse_timestamp(c: Column) -> Column:
    """Timestamp (no zone) on the hotel's clock, whole seconds.

    Year-first, then month-first, then day-first; ``-`` or ``/`` between date parts; ``:`` or ``.``
    between time parts. ``Z`` and numeric offsets are honoured and only looked for after a time.
    """
    return _stamp(F.trim(c.cast("string")))


def normalise_timestamp(c: Column, any_case: bool = False) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text, null for blank or unreadable input."""
    blank = is_blank_any_case(c) if any_case else is_blank(c)
    return F.when(~blank, parse_timestamp(c).cast("string"))


def compact_day(c: Column) -> Column:
    """``yyyyMMdd`` of a normalised timestamp text."""
    return F.translate(F.substring(c, 1, 10), "-", "")


def parse_export_date(c: Column) -> Column:
    """Date of a report cell: ISO first, then day-first, then month-first; dots and slashes, month names, eight digits,
    and a time with a zone behind the date are allowed."""
    s = F.trim(c)
    numeric = _with_parts(s, _DAY, 3, lambda x: _read_date(x, lambda day: day.try_cast("date"), False, "dm"))
    compact = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("date")
    return F.when(s.rlike("(?i)[a-z]{3}"), _named_date(s)).when(s.rlike(r"^\d{8}$"), compact).otherwise(numeric)


def _named_date(s: Column) -> Column:
    """A date with the month's English name, whole or shortened to three letters, behind or before the day."""
    forms = {form: number for number, name in enumerate(_MONTHS, 1) for form in (name, name[:3])} | {"sept": 9}
    months = F.create_map(*[F.lit(x) for form, number in forms.items() for x in (form, str(number))])

    def build(x: Column) -> Column:
        year = F.when(F.length(x[3]) == 2, _long_year(x[3])).otherwise(x[3])
        one_day = (x[0] == "") != (x[2] == "")
        return F.when(one_day, F.concat_ws("-", year, F.try_element_at(months, F.lower(x[1])), F.concat(x[0], x[2])).try_cast("date"))

    return _with_parts(s, _NAMED, 4, build)


def parse_short_date(c: Column) -> Column:
    """Date written day/month/two-digit year, else null."""
    s = F.trim(c)
    return F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), _with_parts(
        s, _DAY, 3, lambda x: _read_date(x, lambda day: day.try_cast("date"), False, "d")
    ))


def export_date_text(c: Column) -> Column:
    return parse_export_date(c).cast("string")


def parse_chat_timestamp(c: Column) -> Column:
    """Month-first, then day-first, then day-first with a two-digit year, times written ``HH.mm.ss``."""
    return _stamp(F.trim(c), short_years="d")


def clock_hhmm(c: Column) -> Column:
    """``HH:mm`` from ``H:mm``, ``HH:mm`` or four digits, else null."""
    four = F.regexp_replace(c, r"[^0-9:]", "")
    text = F.when(c.rlike(r"^\d{1,2}:\d{2}$"), F.lpad(c, 5, "0")).when(
        four.rlike(r"^\d{4}$"), F.concat(F.substring(four, 1, 2), F.lit(":"), F.substring(four, 3, 2))
    )
    return F.when(text.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), text)


def sane_birth_date(c: Column, this_year: int | None = None) -> Column:
    """Date text, null before 1900 or after the current year."""
    day = parse_export_date(c)
    limit = F.lit(this_year) if this_year is not None else F.year(F.current_date())
    return F.when((F.year(day) >= 1900) & (F.year(day) <= limit), day.cast("string"))
