"""Linking guests across tables, group chats and duplicate candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Columns that tell one uploaded file from another.
UPLOAD = ("csv_upload_id", "source_file")


def upload_columns(df: DataFrame) -> list[str]:
    return [c for c in UPLOAD if c in df.columns]


def _present(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def link_contacts(resv: DataFrame, prof: DataFrame, keep: tuple[str, ...] = ("guest_id", "email", "mobile_no")) -> DataFrame:
    """Left join of stays to profiles on mobile = mobile, or mobile = phone, or equal email in any case.

    The disjunction is three equi-joins that exclude each other, so no pair appears twice and nothing has to
    be de-duplicated afterwards; stays without any match come once, with nulls. Blank contacts match nothing.
    """
    right = prof.select(
        _present(F.col("mobile_no")).alias("_mobile"), _present(F.col("phone")).alias("_phone"),
        _present(F.lower("email")).alias("_email"), *[F.col(c).alias(f"profile_{c}") for c in ("id", *keep)],
    )
    left = resv.withColumns({"_m": _present(F.col("mobile_phone")), "_e": _present(F.lower("email"))})
    no = lambda a, b: ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    by_mobile = left.join(right, F.col("_m") == F.col("_mobile"))
    by_phone = left.join(right, (F.col("_m") == F.col("_phone")) & no("_m", "_mobile"))
    by_email = left.join(right, (F.col("_e") == F.col("_email")) & no("_m", "_mobile") & no("_m", "_phone"))
    numbers = right.select(F.explode(F.array("_mobile", "_phone")).alias("_m")).dropna().distinct()
    emails = right.select(F.col("_email").alias("_e")).dropna().distinct()
    alone = left.join(numbers, "_m", "left_anti").join(emails, "_e", "left_anti")
    columns = [*resv.columns, *[f"profile_{c}" for c in ("id", *keep)]]
    types = dict(right.dtypes)
    lonely = alone.select(*resv.columns, *[F.lit(None).cast(types[c]).alias(c) for c in columns if c in types])
    found = by_mobile.select(*columns).unionByName(by_phone.select(*columns)).unionByName(by_email.select(*columns))
    return found.unionByName(lonely.select(*columns))


def best_contact(resv: DataFrame, prof: DataFrame) -> DataFrame:
    """One row per stay: the matching profile by mobile, else phone, else email, and the number of matches of each.

    Profiles are first reduced to one row per contact value (lowest id, count), so the result grows with the stays
    alone, also when very many guests share one number. Use this in bulk; :func:`link_contacts` lists every match.
    """
    def per_value(column: Column, name: str) -> DataFrame:
        return prof.select(_present(column).alias("_k"), "id").dropna(subset=["_k"]).groupBy("_k").agg(
            F.min("id").alias(f"_{name}"), F.count(F.lit(1)).alias(f"{name}_matches")
        )

    rules = {"mobile": (F.col("mobile_no"), "_m"), "phone": (F.col("phone"), "_m"), "email": (F.lower("email"), "_e")}
    out = resv.withColumns({"_m": _present(F.col("mobile_phone")), "_e": _present(F.lower("email"))})
    for name, (column, on) in rules.items():
        out = out.join(per_value(column, name).withColumnRenamed("_k", on), on, "left")
    return out.select(
        *resv.columns, F.coalesce("_mobile", "_phone", "_email").alias("profile_id"),
        *[F.coalesce(f"{n}_matches", F.lit(0)).alias(f"{n}_matches") for n in rules],
    )


def link_by_guest(resv: DataFrame, prof: DataFrame) -> DataFrame:
    """Fallback link: one profile per stay by guest_id, else by name; the lowest profile id counts."""
    by_id = prof.groupBy("guest_id").agg(F.min("id").alias("_by_id")).dropna(subset=["guest_id"])
    by_name = prof.groupBy(F.col("name").alias("guest_name")).agg(F.min("id").alias("_by_name")).dropna()
    return (
        resv.join(by_id, "guest_id", "left").join(by_name, "guest_name", "left")
        .withColumn("profile_id", F.coalesce("_by_id", "_by_name")).drop("_by_id", "_by_name")
        .select(*resv.columns, "profile_id")
    )


def drop_group_chats(df: DataFrame, title: str = "chats", name: str = "name", scope: tuple[str, ...] | None = None) -> DataFrame:
    """Drop messages of group chats and of everyone seen in one, upload by upload.

    A chat whose title does not start with ``+`` is a group; names seen there are staff. Rows whose sender or
    title is such a name go. A missing name matches a missing name. ``scope`` names the columns that tell uploads
    apart; by default those of ``UPLOAD`` that the frame has, and without any the frame is one upload.
    """
    scope = upload_columns(df) if scope is None else list(scope)
    group = ~F.coalesce(F.col(title).startswith("+"), F.lit(False))
    members = df.filter(group).select(F.col(name).alias("_member"), *[F.col(c).alias(f"_{c}") for c in scope]).distinct()

    def in_upload(column: str) -> Column:
        test = F.col(column).eqNullSafe(F.col("_member"))
        for c in scope:
            test = test & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return test

    return df.join(members, in_upload(name), "left_anti").join(members, in_upload(title), "left_anti")


def duplicate_guests(prof: DataFrame, name_fragment: str, birth_date: str, n: int | None = None) -> DataFrame:
    """Candidates with a birth date and a name containing the fragment, all or the first n by id."""
    found = prof.filter((F.col("birth_date") == birth_date) & F.col("name").contains(name_fragment)).orderBy("id")
    return found if n is None else found.limit(n)


def duplicate_groups(prof: DataFrame) -> DataFrame:
    """All (birth_date, name word) groups shared by at least two guests: their number, lowest and highest id.

    Groups are aggregates, not pairs, so a default birth date held by very many guests stays one row per word.
    """
    words = prof.filter(F.col("birth_date").isNotNull()).select(
        "id", "birth_date", F.explode(F.array_distinct(F.split(F.upper(F.trim("name")), r"[\s,]+"))).alias("name_word")
    ).filter("name_word <> ''")
    return words.groupBy("birth_date", "name_word").agg(
        F.count(F.lit(1)).alias("guests"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    ).filter("guests > 1")


def match_guest(batch: DataFrame, target: DataFrame) -> DataFrame:
    """Known guest id for each batch row: by name and phone, else name and email, else name; ties to the lowest id.

    Each side is reduced to one row per key before joining. ``matched_guest_id`` is null for new guests.
    """
    def best(*keys: str) -> DataFrame:
        alias = "_by_" + "_".join(keys)
        known = target.filter(_all_present(keys))
        return known.groupBy(*keys).agg(F.min_by("guest_id", "id").alias(alias))

    def _all_present(keys: tuple[str, ...]) -> Column:
        test = F.lit(True)
        for k in keys:
            test = test & F.col(k).isNotNull() & (F.col(k) != "")
        return test

    out = batch
    for keys in (("name", "phone"), ("name", "email"), ("name",)):
        out = out.join(best(*keys), list(keys), "left")
    return out.select(
        *batch.columns, F.coalesce("_by_name_phone", "_by_name_email", "_by_name").alias("matched_guest_id")
    )
