"""Soft deletes, purges, merges and rollbacks of uploads.

Every function returns new frames; the caller writes them (for example with ``streaming.upsert``).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(parts: list[DataFrame]) -> DataFrame:
    """(table_name, affected) rows plus a 'total' row."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.rollup("table_name").agg(F.sum("affected").alias("affected"), F.grouping("table_name").alias("t")).select(
        F.when(F.col("t") == 1, F.lit("total")).otherwise(F.col("table_name")).alias("table_name"), "affected"
    )


def _hits(df: DataFrame, name: str, hit: Column) -> DataFrame:
    return df.agg(F.count(F.when(hit, 1)).alias("affected")).select(F.lit(name).alias("table_name"), "affected")


def soft_delete_upload(
    tables: Mapping[str, DataFrame], ledger: DataFrame, upload_id: int, now: Column, user: str | None = None,
    restamp: Iterable[str] = ("reservation",),
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Stamp deleted_at on all rows of an upload: (tables, ledger, counts).

    Rows deleted before keep their stamp, except in ``restamp`` tables. The ledger row becomes DELETED. An
    upload that is DELETED already changes nothing.
    """
    # One row by primary key: whether there is anything left to do.
    open_upload = ledger.filter((F.col("id") == upload_id) & (F.col("status") == "DELETED")).agg(
        (F.count(F.lit(1)) == 0).alias("x")
    ).scalar()
    out, counts = {}, []
    for name, df in tables.items():
        mine = F.col("csv_upload_id") == upload_id
        hit = mine if name in set(restamp) else mine & F.col("deleted_at").isNull()
        marked = df.withColumn("_open", open_upload)
        stamp = F.when(hit & F.col("_open"), now.cast(dict(df.dtypes)["deleted_at"])).otherwise(F.col("deleted_at"))
        out[name] = marked.withColumn("deleted_at", stamp).drop("_open")
        counts.append(_hits(marked, name, hit & F.col("_open")))
    is_it = F.col("id") == upload_id
    fresh = is_it & (F.col("status") != "DELETED")
    new_ledger = ledger.withColumns({
        "deleted_at": F.when(fresh, now.cast(dict(ledger.dtypes)["deleted_at"])).otherwise(F.col("deleted_at")),
        "status": F.when(fresh, F.lit("DELETED")).otherwise(F.col("status")),
        **({"deleted_by": F.when(fresh, F.lit(user)).otherwise(F.col("deleted_by"))} if user else {}),
    })
    return out, new_ledger, _counts(counts)


def purge_deleted(tables: Mapping[str, DataFrame], ledger: DataFrame | None = None):
    """Remove deleted rows and DELETED uploads for good: (tables, ledger, counts)."""
    gone = F.col("deleted_at").isNotNull()
    counts = [_hits(df, name, gone) for name, df in tables.items()]
    kept = {name: df.filter(~gone) for name, df in tables.items()}
    if ledger is None:
        return kept, None, _counts(counts)
    dead = F.col("status") == "DELETED"
    counts.append(_hits(ledger, "csv_uploads", dead))
    return kept, ledger.filter(~F.coalesce(dead, F.lit(False))), _counts(counts)


def purge_expired(df: DataFrame, now: Column, state: Column, ttls: Mapping[bool, tuple[str, int]]) -> tuple[DataFrame, DataFrame]:
    """Two-TTL purge: (kept, counts). ``ttls`` maps a state to (time column, minutes); a null time never
    expires, nor does a state without an entry."""
    expired = {
        flag: (state == F.lit(flag)) & F.coalesce(
            F.col(column) < now - F.make_dt_interval(mins=F.lit(minutes)), F.lit(False)
        )
        for flag, (column, minutes) in ttls.items()
    }
    any_expired = F.lit(False)
    for test in expired.values():
        any_expired = any_expired | F.coalesce(test, F.lit(False))
    counts = df.agg(
        F.count(F.when(expired.get(False, F.lit(False)), 1)).alias("deleted_unconsumed"),
        F.count(F.when(expired.get(True, F.lit(False)), 1)).alias("deleted_consumed"),
    ).withColumn("deleted_total", F.col("deleted_unconsumed") + F.col("deleted_consumed"))
    return df.filter(~any_expired), counts


def upsert_processed(target: DataFrame, batch: DataFrame, keys: Iterable[str], order: str = "id",
                     upload: str = "last_upload_id") -> DataFrame:
    """Update rows whose keys match and insert the rest; of several batch rows the last by ``order`` counts.

    Rows with a null key never match and are inserted as they are, one by one.
    """
    keys = list(keys)
    rest = [c for c in target.columns if c not in keys]
    keyed = lambda df: df.dropna(subset=keys)
    loose = lambda df: df.filter(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1)
    both = keyed(target).select("*", F.lit(0).alias("_new")).unionByName(
        keyed(batch).select(*target.columns, F.lit(1).alias("_new"))
    )
    rank = F.struct("_new", order, upload, *[c for c in rest if c not in (order, upload)])
    merged = both.groupBy(*keys).agg(F.max(rank).alias("_row")).select(*keys, "_row.*").select(*target.columns)
    return merged.unionByName(loose(target)).unionByName(loose(batch).select(*target.columns))


def rollback_upload(processed: DataFrame, raw: DataFrame, upload_id: int, keys: Iterable[str], id: str = "id",
                    upload: str = "last_upload_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Undo an upload: (processed, raw, counts).

    Rows last written by it go back to the raw row of the newest other upload, or leave when there is none.
    ``raw`` loses the upload's rows.
    """
    keys = list(keys)
    values = [c for c in processed.columns if c not in (*keys, upload)]
    touched = F.coalesce(F.col(upload) == upload_id, F.lit(False))
    others = raw.filter(F.col("csv_upload_id") != upload_id)
    # Only the raw rows of keys that the upload wrote last are needed.
    newest = others.join(processed.filter(touched).select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in values], F.col("csv_upload_id").alias(upload)),
                 F.struct("csv_upload_id", id)).alias("_prev")
    )
    affected = processed.filter(touched).select(*keys).join(newest, keys, "left")
    restored = affected.filter(F.col("_prev").isNotNull()).select(*keys, "_prev.*").select(*processed.columns)
    counts = affected.agg(
        F.count("_prev").alias("rolled_back"), F.count(F.when(F.col("_prev").isNull(), 1)).alias("deleted")
    )
    return processed.filter(~touched).unionByName(restored), others, counts
