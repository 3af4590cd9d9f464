from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from hotelspark.operators import bills
from hotelspark.operators.components import component_max

LINES = ("line_no int, outlet string, bill_number bigint, article_number bigint, description string, quantity bigint, "
         "sales decimal(18,2), payment decimal(18,2), guest_name string, table_number int, time string")


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[min(ra, rb)] = max(ra, rb)
    return {x: root(x) for x in parent}


def labels_of(spark, edges):
    df = spark.createDataFrame([("o", a, b) for a, b in edges], "outlet string, src bigint, dst bigint")
    rows = component_max(df, ["outlet"]).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.label for r in rows}


def test_components_on_random_graphs(spark):
    rnd = random.Random(3)
    graphs = [
        [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)],
        [(i, i + 1) for i in range(60)],                        # a long chain
        [(0, i) for i in range(1, 150)] + [(7, 900), (900, 3)],  # one hub
        [(5, 5)],
    ]
    for edges in graphs:
        want = {k: v for k, v in union_find(edges).items()}
        lone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
        assert labels_of(spark, edges) == {k: v for k, v in want.items() if k not in lone}


def line(no, outlet, bill, article, text, qty=1, sales="10.00", pay="10.00", guest=None, table=1, time=None):
    return (no, outlet, bill, article, text, qty, Decimal(sales), Decimal(pay), guest, table, time)


def test_consolidation(spark):
    r, s = "Restaurant & Bar", "Room Service"
    df = spark.createDataFrame([
        line(1, r, 10, 5, "From Table 3 *12, To Table 4 *11", guest=None, table=1, time="10:00"),
        line(2, r, 11, 5, "Soup", 2, "20.00", guest="Ann", table=2, time="09:00"),
        line(3, r, 12, 8911, "Discount", 1, "-3.00"),
        line(4, r, 12, 9850, "House", 1, "0.00", "-2.00"),
        line(5, r, 12, 7, "Nothing", 0, "0.00", "0.00"),
        line(6, s, 10, 5, "Same number, other outlet"),
        line(7, "Spa", 10, 5, "Unknown outlet"),
        line(8, r, None, 5, "No number"),
    ], LINES)
    got = {(x.outlet, x.bill_number, x.article_number): x for x in bills.consolidate_bills(df).collect()}
    assert set(got) == {(r, 12, 5), (s, 10, 5), (r, 0, 5)}
    row = got[(r, 12, 5)]
    assert (row.quantity, row.sales, row.prev_bill_number, row.guest_name, row.table_number, row.time) == (3, Decimal("30.00"), 10, "Ann", 2, "10:00")
    assert (row.bill_discount, row.bill_compliment, row.total_deduction) == (Decimal("-3.00"), Decimal("-2.00"), Decimal("-5.00"))
    assert (row.article_category, row.article_subcategory) == ("Food", "Breakfast")
    assert got[(s, 10, 5)].total_deduction == 0


def test_raw_rows_hold_cents_and_payment_equals_sales(spark):
    df = spark.createDataFrame([line(1, "Banquet", 1, 2, "x", sales="10.25", pay="1.00")], LINES)
    row = bills.bill_rows(df).first()
    assert (row.sales, row.payment, row.bill_number, row.item_name) == (1025, 1025, "1", "x")


def test_uploads_are_not_added_up(spark):
    rows = [line(1, "Banquet", 10, 4, "Coffee", 1, "6.00"), line(1, "Banquet", 10, 4, "Coffee", 1, "6.00")]
    df = spark.createDataFrame(rows, LINES)
    both = df.limit(1).withColumn("source_file", F.lit("a")).unionByName(df.limit(1).withColumn("source_file", F.lit("b")))
    assert [(r.quantity, r.sales) for r in bills.consolidate_bills(both).collect()] == [(1, Decimal("6.00"))] * 2
    assert [(r.quantity, r.sales) for r in bills.consolidate_bills(both, scope=["outlet"]).collect()] == [(2, Decimal("12.00"))]


def test_bill_numbers_keep_every_digit(spark):
    from hotelspark.operators.clean import resto_cells
    cells = spark.createDataFrame(
        [(" 9007199254740993.0", "12.9", "x", "1e3", "9223372036854775807", "5", "10.00", "10.00", "01/02/24", "MR A")],
        "bill_number string, table_number string, article_number string, posting_id string, reservation_number string,"
        " quantity string, sales string, payment string, transaction_date string, guest_name string")
    r = resto_cells(cells).first()
    assert (r.bill_number, r.table_number, r.article_number, r.posting_id, r.reservation_number, r.quantity) == (
        9007199254740993, 12, 0, 1000, 9223372036854775807, 5)


def _final_groups_reach_a_join(df, key):
    """Of the final (not partial) aggregates by ``key``, whether each gets its rows from a join without a shuffle."""
    found = []

    def below(node):
        kids = node.children()
        return [kids.apply(i) for i in range(kids.size())]

    def walk(node):
        text = node.simpleString(100)
        if "Aggregate(key" in text and f"{key}#" in text.split("functions=")[0] and "partial_" not in text:
            down = node
            while "Exchange" not in down.nodeName() and "Join" not in down.nodeName() and below(down):
                down = below(down)[0]
            found.append("Join" in down.nodeName())
        for child in below(node):
            walk(child)

    walk(df._jdf.queryExecution().executedPlan().executedPlan())
    return found


def random_bills(spark, seed=11, rows=1500):
    """Lines of two uploads with transfers, repeated lines, null bills, nulls in details and one bill of a third of all."""
    rnd = random.Random(seed)
    out = []
    for i in range(rows):
        bill = rnd.choice([7, None, rnd.randrange(200), rnd.randrange(200), rnd.randrange(200), rnd.randrange(200)])
        text = rnd.choice([None, "Soup", f"Item {rnd.randrange(9)}", f"To Table 5 *{rnd.randrange(220)}"] if i % 12 == 0 else [None, "Soup", "Tea"])
        article = rnd.choice([8911, 9850, 9801, rnd.randrange(1, 12), rnd.randrange(1, 12), None])
        out.append((rnd.choice([1, 1, 2, None]), *line(
            rnd.choice([i, i, None]), rnd.choice(["Restaurant & Bar", "Room Service", "Spa", None]), bill, article, text,
            rnd.randrange(3), f"{rnd.randrange(3)}.50", f"{rnd.randrange(3)}.25", rnd.choice([None, "Ann", "Bob"]), rnd.choice([None, 1, 2]))))
    out += out[:50]
    return spark.createDataFrame(out, "csv_upload_id int, " + LINES)


def test_bills_without_transfers_are_grouped_where_the_rename_put_them(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = random_bills(spark)
        got = bills.consolidate_bills(lines)
        # Lines and deductions of such bills: grouped without another shuffle. Those of moved bills: after one.
        assert sorted(_final_groups_reach_a_join(got, "article_number")) == [False, False, True, True]
        # The steps one after the other over all bills give the same rows.
        scope = bills.bill_scope(lines)
        known = lines.filter(F.col("outlet").isin(*bills.OUTLETS))
        want = bills.classify_articles(bills.fold_deductions(bills.group_bill_lines(
            bills.merge_transferred_bills(known, scope), "line_no", scope), scope))
        assert got.columns == want.columns and got.dtypes == want.dtypes
        rows = sorted(map(repr, got.collect()))
        assert rows == sorted(map(repr, want.collect())) and len(rows) > 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
