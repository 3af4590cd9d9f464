"""Current-state marts: one row per natural key out of re-uploaded and soft-deleted versions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotelspark.functions.hotel import room_type_desc
from hotelspark.functions.numbers import MONEY
from hotelspark.schemas import CHAT_KEYS, MONEY_COLUMNS, PROFILE_KEYS, RESTO_KEYS, STAY_KEYS


def _ranked(df: DataFrame, *before: Column, rank: list[Column]) -> DataFrame:
    """Add the two ranks a row can give a value: ``_known`` for non-null ones, ``_null`` below it."""
    return df.withColumns({
        "_known": F.struct(*before, F.lit(True), *rank), "_null": F.struct(*before, F.lit(False), *rank),
    })


def _last_known(column: str) -> Column:
    """Value at the highest rank, preferring non-null values.

    A mergeable aggregate, so it combines before the shuffle; the ranks are made once per row, not per column.
    """
    value = F.col(column)
    return F.max_by(value, F.when(value.isNotNull(), F.col("_known")).otherwise(F.col("_null"))).alias(column)


def mean_to_cents(total: Column, count: Column) -> Column:
    """total / count cut (not rounded) to two decimals, exact in decimal arithmetic."""
    units = F.call_function("div", (total * 100).cast("decimal(38,0)"), count)
    return (units.cast("decimal(20,0)") / 100).cast(MONEY)


def build_mart(
    df: DataFrame,
    keys: Iterable[str],
    values: Iterable[str],
    *,
    upload: str = "csv_upload_id",
    id: str = "id",
    version: str = "version",
    deleted: str = "deleted_at",
    averages: dict[str, Column] | None = None,
    null_keys: bool = False,
) -> DataFrame:
    """Resolve versions per key.

    Stage 1, per key and upload: every column takes its value at the highest version, skipping nulls.
    Stage 2, per key: every column takes its value from the highest (upload, id) among active uploads,
    skipping nulls; when no upload is active, among all of them, and ``is_deleted`` is 1.
    ``averages`` maps an output name to a stage-1 expression averaged over the active uploads; a name that
    is also in ``values`` shows the average instead of the resolved value.

    Rows with a null key fall out unless ``null_keys`` is set. Both stages are mergeable aggregates, so a
    key that holds a large share of the rows is reduced on the map side and never meets in one task.
    Input bucketed by ``keys`` needs no shuffle at all.
    """
    keys, averages = list(keys), averages or {}
    values = [v for v in values if v not in (upload, id, deleted)]
    if not null_keys:
        df = df.dropna(subset=keys)
    stage1 = _ranked(df, rank=[F.col(version), F.col(id)]).groupBy(*keys, upload).agg(
        *[_last_known(v) for v in [*values, deleted]], F.max_by(id, F.col("_known")).alias("_id"),
    )
    active = F.col(deleted).isNull()
    out = _ranked(stage1, active, rank=[F.col(upload), F.col("_id")]).groupBy(*keys).agg(
        F.max_by(upload, F.col("_known")).alias(upload),
        *[_last_known(v) for v in [*values, deleted] if v not in averages],
        F.when(F.max(active), F.lit(0)).otherwise(F.lit(1)).alias("is_deleted"),
        *[
            F.struct(
                F.sum(F.when(active, expr)).alias("s"), F.count(F.when(active, expr)).alias("n")
            ).alias(name)
            for name, expr in averages.items()
        ],
    )
    return out.withColumns({
        name: F.when(F.col(f"{name}.n") > 0, mean_to_cents(F.col(f"{name}.s"), F.col(f"{name}.n")))
        .otherwise(F.lit(0).cast(MONEY))
        for name in averages
    })


def _others(df: DataFrame, keys: Iterable[str]) -> list[str]:
    return [c for c in df.columns if c not in (*keys, "id", "csv_upload_id", "deleted_at")]


def mart_reservations(df: DataFrame) -> DataFrame:
    """Stays: average money over active uploads (0 where none is active) and a room type description."""
    averages = {c: F.col(c) for c in MONEY_COLUMNS if c in df.columns}
    if "room_rate" in averages:
        averages["total_amount"] = F.col("room_rate") * F.col("nights")
    values = [c for c in _others(df, STAY_KEYS) if c != "room_type_desc"]
    out = build_mart(df, STAY_KEYS, values, averages=averages)
    return out.withColumn("room_type_desc", room_type_desc(F.col("room_type")))


def mart_profiles(df: DataFrame) -> DataFrame:
    return build_mart(df, PROFILE_KEYS, _others(df, PROFILE_KEYS))


def mart_chats(df: DataFrame) -> DataFrame:
    return build_mart(df, CHAT_KEYS, _others(df, CHAT_KEYS))


def mart_resto(df: DataFrame) -> DataFrame:
    """Bill lines keyed by all 22 business columns; null key values are kept as values of their own."""
    return build_mart(df, RESTO_KEYS, _others(df, RESTO_KEYS), null_keys=True)


def latest_by_key(df: DataFrame, key: str | list[str] = "id", version: str = "version", *ties: str) -> DataFrame:
    """One whole row per key: the highest version, ties by ``ties`` and then by the row's own content."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(version, *ties, *[c for c in rest if c not in (version, *ties)])
    best = df.groupBy(*keys).agg(F.max(rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def enrich_with_rates(winners: DataFrame, rows: DataFrame, keys: Iterable[str], measures: Iterable[str],
                      deleted: str = "deleted_at") -> DataFrame:
    """Left-join the mean of each measure over active rows, cut to two decimals, 0 where there is none."""
    keys, measures = list(keys), list(measures)
    means = (
        rows.filter(F.col(deleted).isNull())
        .dropna(subset=keys)
        .groupBy(*keys)
        .agg(*[x for m in measures for x in (F.sum(m).alias(f"_s_{m}"), F.count(m).alias(f"_n_{m}"))])
        .select(*keys, *[
            F.when(F.col(f"_n_{m}") > 0, mean_to_cents(F.col(f"_s_{m}"), F.col(f"_n_{m}"))).alias(f"_m_{m}")
            for m in measures
        ])
    )
    joined = winners.drop(*measures).join(means, keys, "left")
    zero = F.lit(0).cast(MONEY)
    return joined.withColumns({m: F.coalesce(F.col(f"_m_{m}"), zero) for m in measures}).drop(
        *[f"_m_{m}" for m in measures]
    )
