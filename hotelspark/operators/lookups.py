"""Filters, previews, histories, pages and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns shown by each preview.
PREVIEWS = {
    "profile_guest": ("id", "name", "email"),
    "reservation": ("id", "guest_name", "room_number"),
    "chat_whatsapp": ("id", "phone_number", "message"),
    "transaction_resto": ("id", "bill_number", "guest_name", "sales"),
}


def drop_summary_rows(df: DataFrame, column: str = "Number") -> DataFrame:
    """Keep rows whose sequence column is numeric; report footers are not."""
    return df.filter(F.trim(F.col(column).cast("string")).try_cast("double").isNotNull())


def preview(df: DataFrame, kind: str, limit: int, characters: int) -> DataFrame:
    """The first ``limit`` rows by id, cut to a few columns, and messages to ``characters``: a glance, not the data."""
    if kind not in PREVIEWS:
        raise ValueError(f"unknown data type: {kind}")
    if kind == "reservation" and "guest_name" not in df.columns:
        df = df.withColumn("guest_name", F.concat("first_name", F.lit(" "), "last_name"))
    if kind == "chat_whatsapp":
        df = df.withColumn("message", F.substring(F.coalesce("message", F.lit("")), 1, characters))
    return df.select(*PREVIEWS[kind]).orderBy("id").limit(limit)


def keyword_search(df: DataFrame, text: str, keyword: str, newest: list[Column], limit: int | None = None) -> DataFrame:
    """Rows whose text contains the keyword in any case, newest first; all of them or the first ``limit``."""
    found = df.filter(F.lower(F.col(text)).contains(keyword.lower())).orderBy(*newest)
    return found if limit is None else found.limit(limit)


def history_for(df: DataFrame, matches: dict[str, str], order: list[Column], n: int | None = None, any_case: tuple[str, ...] = ()) -> DataFrame:
    """All rows, or the newest n, where any of the named columns equals its value (``any_case`` columns compare in lower case)."""
    tests = [
        F.lower(F.col(c)) == v.lower() if c in any_case else F.col(c) == v for c, v in matches.items()
    ]
    found = df.filter(reduce(lambda a, b: a | b, tests)).orderBy(*order)
    return found if n is None else found.limit(n)


def profile_lookup(df: DataFrame, phone: str, email: str, n: int | None = None) -> DataFrame:
    """Profiles with this number as mobile or phone, or with this email."""
    return history_for(df, {"mobile_no": phone, "phone": phone, "email": email}, [F.col("id")], n, ("email",))


def page_after(df: DataFrame, after_id: int, n: int, id: str = "id") -> DataFrame:
    """Keyset page: the next n rows by id."""
    if n <= 0:
        raise ValueError("a page has at least one row")
    return df.filter(F.col(id) > after_id).orderBy(id).limit(n)


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("guest_count")).orderBy(F.col("guest_count").desc(), column)


def volume_per_day(df: DataFrame, ts: str, n: int | None = None) -> DataFrame:
    """Rows per calendar day, newest first; all days or n."""
    day = F.col(ts).cast("date").alias("chat_date")
    days = df.groupBy(day).agg(F.count(F.lit(1)).alias("message_count")).orderBy(F.col("chat_date").desc())
    return days if n is None else days.limit(n)


def recent_uploads(ledger: DataFrame, n: int | None = None, user: str | None = None) -> DataFrame:
    """Newest uploads first, optionally of one user and without a limit."""
    if user is not None:
        ledger = ledger.filter(F.col("uploaded_by") == user)
    ordered = ledger.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return ordered.limit(n) if n else ordered
