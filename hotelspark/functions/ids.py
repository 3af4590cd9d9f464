"""Guest identifiers for rows that arrive without one.

Each kind of row has a list of rules: the parts an id is made of, and what separators and marks turn into. The first
rule whose first parts are all given makes the id; the upload and row number always can.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hotelspark.functions.dates import compact_day
from hotelspark.functions.text import fill_empty, given, strip_dot_zero


@dataclass(frozen=True)
class Rule:
    """``parts`` joined by ``_``; the characters of ``marks`` become ``_``, those of ``dropped`` go. ``needs``: how many
    parts, from the first, must be given."""

    parts: tuple[Column, ...]
    needs: int
    marks: str
    dropped: str = ""
    upper: bool = False

    def made(self) -> Column:
        whole = F.concat_ws("_", *[F.regexp_replace(p, self.dropped, "") if self.dropped and i else p for i, p in enumerate(self.parts)])
        whole = F.regexp_replace(whole, self.marks, "_")
        whole = F.upper(F.trim(whole)) if self.upper else whole
        known = F.lit(True)
        for part in self.parts[: self.needs]:
            known = known & given(part).isNotNull()
        return F.when(known, whole)


def _first_made(given_id: Column, rules: list[Rule], upload: Column, row: Column) -> Column:
    rules = [*rules, Rule((F.lit("GUEST"), upload.cast("string"), row.cast("string")), 0, r"$^")]
    return F.coalesce(strip_dot_zero(given(given_id)), *[r.made() for r in rules])


def stay_guest_id(given_id: Column, name: Column, room: Column, arrival: Column, upload: Column, row: Column) -> Column:
    """The given id, else name+room+day, else name+day+row, else upload+row.

    ``arrival`` is normalised timestamp text. Ids are as long as their parts: a cut would merge guests.
    """
    day = compact_day(arrival)
    return _first_made(given_id, [
        Rule((name, given(room), day), 3, r"[^\w]+|_+", upper=True),
        Rule((name, day, row.cast("string")), 1, r"[^\w]+|_+", upper=True),
    ], upload, row)


def profile_guest_id(
    given_id: Column, name: Column, mobile: Column, phone: Column, email: Column, upload: Column, row: Column,
    phone_fallback: bool = False,
) -> Column:
    """The given id, else name+mobile, name+email, name+row, upload+row.

    A blank mobile does not fall back to ``phone`` unless asked to. Ids are as long as their parts.
    """
    number = F.coalesce(given(mobile), fill_empty(phone)) if phone_fallback else fill_empty(mobile)
    return _first_made(given_id, [
        Rule((name, number), 2, r"[ \-]+", dropped=r"\+"),
        Rule((name, fill_empty(email)), 2, "[ .@]+"),
        Rule((name, row.cast("string")), 1, " +"),
    ], upload, row)
