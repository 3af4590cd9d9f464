"""Bulk cleaning jobs for the four feeds: DataFrame -> DataFrame, batch or streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotelspark.functions import dates, ids, numbers, text
from hotelspark.operators.contacts import drop_group_chats
from hotelspark.operators.lookups import drop_summary_rows
from hotelspark.schemas import MONEY_COLUMNS

_STAMPS = ("created_at", "deleted_at")


def _apply(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Replace the columns that exist; all new values are computed from the old ones."""
    return df.withColumns({c: e for c, e in changes.items() if c in df.columns})


def standardise_reservations(df: DataFrame) -> DataFrame:
    """Clean reservation events and add ``guest_name``; every event stays one row."""
    c = F.col
    name = F.upper(F.trim(F.concat_ws(" ", text.fill_blank(c("first_name")), text.fill_blank(c("last_name")))))
    email = F.lower(F.trim(text.fill_blank(c("email"))))
    numeric = {n for n, t in df.dtypes if t.startswith(("decimal", "double", "float", "int", "bigint"))}
    amount = lambda m: numbers.money_number(c(m)) if m in numeric else numbers.money(c(m))
    out = _apply(df, {
        **{d: dates.normalise_timestamp(c(d)) for d in ("arrival_date", "depart_date", *_STAMPS)},
        **{t: dates.clock_hhmm(c(t)) for t in ("check_in_time", "check_out_time")},
        "room_number": F.trim("room_number"), "room_type": F.upper(F.trim("room_type")),
        "segment": F.upper(F.trim("segment")), "email": text.given(email),
        "mobile_phone": numbers.stay_phone(c("mobile_phone")),
        **{m: amount(m) for m in MONEY_COLUMNS if m in df.columns},
        **{i: text.strip_dot_zero(c(i)) for i in ("guest_id", "bill_number")},
        **{n: F.coalesce(numbers.whole_number(c(n)), F.lit(0)) for n in ("age", "adult_count", "child_count", "nights")},
        "remarks": text.remark_text(c("remarks")),
    }).withColumn("guest_name", text.given(name))
    return out.withColumn("guest_id", ids.stay_guest_id(
        c("guest_id"), c("guest_name"), c("room_number"), c("arrival_date"), c("csv_upload_id"), c("id")
    ))


def standardise_profiles(df: DataFrame, phone_fallback: bool = False) -> DataFrame:
    """Clean profile events; rows without a name are dropped."""
    c = F.col
    mobile, phone = F.trim("mobile_no"), F.trim("phone")
    out = _apply(df.withColumn("name", text.clean_profile_name(c("name"))).filter(~text.is_blank(c("name"))), {
        "guest_id": text.strip_dot_zero(c("guest_id")),
        "mobile_no": mobile, "phone": F.when(~text.is_blank(mobile), mobile).otherwise(phone),
        "email": text.null_if_noise(F.lower(F.trim("email"))),
        "occupation": text.occupation_label(c("occupation")),
        "city": text.null_if_noise(F.trim("city")), "address": text.null_if_noise(F.upper(F.trim("address"))),
        **{t: F.trim(t) for t in ("country", "type_id", "id_no", "zip_code", "local_region", "comments")},
        "segment": text.segment_label(c("segment")), "sex": text.sex_label(c("sex")),
        "telefax": F.regexp_replace("telefax", r"\D", ""),
        "credit_limit": text.fill_empty(F.trim("credit_limit"), "0"),
        **{s: dates.normalise_timestamp(c(s)) for s in _STAMPS},
    })
    return out.withColumn("guest_id", ids.profile_guest_id(
        c("guest_id"), c("name"), c("mobile_no"), c("phone"), c("email"), c("csv_upload_id"), c("id"), phone_fallback
    ))


def standardise_chats(df: DataFrame) -> DataFrame:
    """Clean chat events; rows without a type, a text or a usable number are dropped."""
    c = F.col
    cells = ("phone_number", "message_type", "message", "message_date", *_STAMPS)
    out = _apply(df, {x: F.trim(F.regexp_replace(c(x).cast("string"), "\t", "")) for x in cells})
    out = out.filter(~text.is_blank_any_case(c("message_type")) & ~text.is_blank_any_case(c("message")))
    return _apply(out, {
        "phone_number": numbers.chat_phone(c("phone_number")),
        **{d: dates.normalise_timestamp(c(d), any_case=True) for d in ("message_date", *_STAMPS)},
    }).filter(c("phone_number").isNotNull())


def standardise_resto(df: DataFrame) -> DataFrame:
    """Normalise the three timestamps of bill events."""
    return _apply(df, {d: dates.normalise_timestamp(F.col(d)) for d in ("transaction_date", *_STAMPS)})


CLEANERS = {
    "reservasi": standardise_reservations, "profile_guest": standardise_profiles,
    "chat_whatsapp": standardise_chats, "transaction_resto": standardise_resto,
}


def _text_cells(df: DataFrame, columns, skip=()) -> dict[str, Column]:
    return {x: F.nullif(F.trim(x), F.lit("")) for x in columns if x in df.columns and x not in skip}


def reservation_rows(df: DataFrame) -> DataFrame:
    """Export cells -> raw reservation rows: footer dropped, numbers, money, dates typed."""
    if "Number" in df.columns:
        df = drop_summary_rows(df, "Number").drop("Number")
    ints = ("reservation_id", "age", "adult_count", "child_count", "nights")
    days, texts = ("arrival_date", "depart_date"), ("in_house_date", "created_date", "birth_date")
    return _apply(df, {
        **_text_cells(df, [n for n, t in df.dtypes if t == "string"]),
        **{i: numbers.export_int(F.col(i)) for i in ints},
        **{m: numbers.export_amount(F.col(m)) for m in MONEY_COLUMNS},
        **{d: dates.parse_export_date(F.col(d)) for d in days},
        **{d: dates.export_date_text(F.col(d)) for d in texts},
    })


def profile_rows(df: DataFrame) -> DataFrame:
    """Export cells -> raw profile rows: cells scrubbed, both phone numbers put in +62 form."""
    strings = [n for n, t in df.dtypes if t == "string"]
    df = df.withColumns({s: text.scrub_cell(F.coalesce(F.col(s), F.lit(""))) for s in strings})
    df = _apply(df, {"phone": numbers.profile_phone(F.col("phone")), "mobile_no": numbers.profile_phone(F.col("mobile_no"))})
    return _apply(df, {**_text_cells(df, strings, ("birth_date",)), "birth_date": dates.export_date_text(F.col("birth_date"))})


def chat_rows(df: DataFrame, row_columns: list[str] | None = None) -> DataFrame:
    """Export cells -> raw chat rows: typed rows only, exact duplicates and group chats of an upload gone, dates parsed.

    ``row_columns`` are the cells that make two rows duplicates; by default all but the line bookkeeping.
    """
    df = df.dropna(subset=["message_type"])
    strings = [n for n, t in df.dtypes if t == "string" and n not in ("source_file",)]
    df = df.withColumns({s: F.nullif(F.regexp_replace(s, "\t", ""), F.lit("")) for s in strings})
    same = row_columns or [c for c in df.columns if c not in ("line_no",)]
    if "line_no" in df.columns and not row_columns:
        df = df.groupBy(*same).agg(F.min("line_no").alias("line_no")).select(*df.columns)
    else:
        df = df.dropDuplicates(same)
    df = drop_group_chats(df, "phone_number", "Name" if "Name" in df.columns else "name")
    df = df.withColumn("message_date", dates.parse_chat_timestamp(F.col("message_date"))).dropna(subset=["message_date"])
    return df.withColumns({c: F.trim(c) for c in ("phone_number", "message_type", "message")})


def resto_cells(df: DataFrame) -> DataFrame:
    """Bill cells before consolidation: dd/mm/yy dates, integers (0 where unreadable), amounts, guest names."""
    ints = ("table_number", "bill_number", "article_number", "posting_id", "reservation_number")
    # Through decimal, never double: long bill and reservation numbers keep every digit; fractions are cut as before.
    whole = lambda c: F.coalesce(F.trim(F.col(c).cast("string")).try_cast("decimal(38,6)").try_cast("bigint"), F.lit(0))
    money = lambda c: F.coalesce(
        F.regexp_replace(F.trim(F.col(c).cast("string")), ",", "").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")
    )
    parsed = dates.parse_short_date(F.col("transaction_date"))
    return _apply(df, {
        "transaction_date": parsed, **{i: whole(i) for i in ints}, **{m: money(m) for m in ("sales", "payment")},
        "quantity": whole("quantity"),
        "guest_name": text.clean_bill_name(F.col("guest_name")),
    })
