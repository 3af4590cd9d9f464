"""Restaurant bills: transfers between tables, consolidation, discounts and article classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotelspark.functions.hotel import OUTLETS, article_category, article_subcategory
from hotelspark.functions.numbers import cents
from hotelspark.operators.components import component_max
from hotelspark.operators.contacts import upload_columns

# Fixed value: how a bill line names the bill it was moved to or from.
TRANSFER = r"(?:To|From)\s+Table\s+\d+\s*\*(\d+)"

DISCOUNT_PREFIX = "891"
COMPLIMENT_RANGE = (9801, 9899)


def bill_transfers(df: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct (scope..., src, dst) edges named in line descriptions."""
    return (
        df.filter(F.col("description").contains("Table"))
        .select(*scope, F.col("bill_number").alias("src"), F.explode(
            F.regexp_extract_all("description", F.lit(TRANSFER), F.lit(1))
        ).alias("dst"))
        .withColumn("dst", F.col("dst").try_cast("bigint"))
        .dropna(subset=["dst"])
        .distinct()
    )


def bill_scope(df: DataFrame) -> list[str]:
    """Where a bill number means one bill: an upload, since numbers restart, and an outlet."""
    return [*upload_columns(df), "outlet"]


def merge_transferred_bills(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Rename every bill to the highest number among the bills it was transferred with, per upload and outlet.

    The number before is kept as ``prev_bill_number``. Only bills with transfers take part in the component
    search; the rename is a left join that AQE may broadcast or split where one bill dominates.
    """
    return _renamed(_labelled(df, scope or bill_scope(df)))


def _labelled(df: DataFrame, scope: list[str]) -> DataFrame:
    """Lines with ``_merged``, the highest number of the bills theirs was transferred with, null without transfers."""
    df = df.withColumn("bill_number", F.coalesce("bill_number", F.lit(0)).cast("bigint"))
    labels = component_max(bill_transfers(df, scope), scope).withColumnsRenamed(
        {"node": "bill_number", "label": "_merged"}
    )
    return df.join(labels, [*scope, "bill_number"], "left")


def _renamed(labelled: DataFrame) -> DataFrame:
    return (
        labelled.withColumn("prev_bill_number", F.col("bill_number"))
        .withColumn("bill_number", F.coalesce("_merged", "bill_number"))
        .drop("_merged")
    )


def _in_file_order(column: str, line: str, first: bool) -> Column:
    """First or last non-null value by line number; the rank ends in the value, so it is shuffled once, inside it."""
    rank = F.struct((F.col(column).isNull() if first else F.col(column).isNotNull()).alias("known"),
                    F.col(line).alias("line"), F.col(column).alias("value"))
    return (F.min if first else F.max)(rank).getField("value").alias(column)


FIRST = ("description", "posting_id", "start_time", "guest_name", "travel_agent_name", "reservation_number",
         "prev_bill_number")
LAST = ("transaction_date", "table_number", "close_time")


def group_bill_lines(df: DataFrame, line: str = "line_no", scope: list[str] | None = None) -> DataFrame:
    """One row per upload, outlet, bill and article: sums of quantity, sales and payment, first/last details in file order."""
    have = set(df.columns)
    return df.groupBy(*(scope or bill_scope(df)), "bill_number", "article_number").agg(
        *[F.sum(c).alias(c) for c in ("quantity", "sales", "payment")],
        *[_in_file_order(c, line, True) for c in FIRST if c in have],
        *[_in_file_order(c, line, False) for c in LAST if c in have],
        *([F.max("time").alias("time")] if "time" in have else []),
    )


def is_discount(article: Column) -> Column:
    return article.cast("string").startswith(DISCOUNT_PREFIX)


def is_compliment(article: Column) -> Column:
    return article.between(*COMPLIMENT_RANGE)


def fold_deductions(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per bill: discount = sales of discount articles, compliment = payment of compliment articles, and their sum.

    Both are attached to every remaining line of the bill; the deduction lines themselves and lines without
    quantity, sales and payment are dropped.
    """
    article = F.col("article_number")
    deductions = df.filter(is_discount(article) | is_compliment(article))
    scope = scope or bill_scope(df)
    totals = deductions.groupBy(*scope, "bill_number").agg(
        F.sum(F.when(is_discount(article), F.col("sales"))).alias("bill_discount"),
        F.sum(F.when(is_compliment(article), F.col("payment"))).alias("bill_compliment"),
    )
    lines = df.filter(~(is_discount(article) | is_compliment(article)))
    zero = F.lit(0).cast("decimal(38,2)")
    empty = (F.col("quantity") == 0) & (F.col("sales") == 0) & (F.col("payment") == 0)
    return attach_bill_totals(lines, totals, scope).withColumns({
        "bill_discount": F.coalesce("bill_discount", zero), "bill_compliment": F.coalesce("bill_compliment", zero),
    }).withColumn("total_deduction", F.col("bill_discount") + F.col("bill_compliment")).filter(~empty)


def attach_bill_totals(lines: DataFrame, totals: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per-bill totals on each line of the bill, null where the bill has none."""
    return lines.join(totals, [*(scope or bill_scope(lines)), "bill_number"], "left")


def classify_articles(df: DataFrame) -> DataFrame:
    number, outlet = F.col("article_number"), F.col("outlet")
    return df.withColumns({
        "article_category": article_category(number, outlet), "article_subcategory": article_subcategory(number, outlet),
    })


def consolidate_bills(df: DataFrame, line: str = "line_no", scope: list[str] | None = None) -> DataFrame:
    """Lines of the three outlets -> merged bills, one row per article, with deductions and article classes.

    ``scope`` tells bills of one number apart and goes to every step: by default the upload columns of the frame and
    the outlet.

    Bills without transfers keep their number, so the shuffle of the rename join already holds each of them together:
    they are grouped and folded where they are, and only bills with transfers are shuffled again under their new
    number. Every bill of a component has a label, so no bill is in both parts. Where one bill dominates,
    ``spark.sql.adaptive.forceOptimizeSkewedJoin`` (on in ``build_session``) lets AQE split the join all the same.
    """
    scope = scope or bill_scope(df)
    lines = _labelled(df.filter(F.col("outlet").isin(*OUTLETS)), scope)
    alone = lines.filter(F.col("_merged").isNull()).withColumn("prev_bill_number", F.col("bill_number")).drop("_merged")
    moved = _renamed(lines.filter(F.col("_merged").isNotNull()))
    folded = [fold_deductions(group_bill_lines(part, line, scope), scope) for part in (alone, moved)]
    return classify_articles(folded[0].unionByName(folded[1]))


def bill_rows(df: DataFrame) -> DataFrame:
    """Raw table layout: sales in cents, payment equal to sales, numbers as text."""
    text = [c for c in ("bill_number", "article_number", "posting_id", "reservation_number", "prev_bill_number")
            if c in df.columns]
    return df.withColumn("sales", cents(F.col("sales"))).withColumn("payment", F.col("sales")).withColumns(
        {c: F.col(c).cast("string") for c in text}
    ).withColumnRenamed("description", "item_name")
