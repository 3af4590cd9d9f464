"""Business labels: room types, age groups and restaurant article classes, driven by rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Room type code prefix -> description; the first match counts.
ROOM_TYPES = (
    ("FS", "Family Suite"), ("D", "Deluxe"), ("E", "Executive Suite"), ("J", "Executive Suite"), ("B", "Suite"),
)

# Age group lower bounds.
AGE_GROUPS = ((18, 24), (25, 34), (35, 44), (45, 54), (55, 64))

RESTAURANT, ROOM_SERVICE, BANQUET = "Restaurant & Bar", "Room Service", "Banquet"
OUTLETS = (RESTAURANT, ROOM_SERVICE, BANQUET)

# Fixed values: (outlet, first article, last article, category); anything else is "Others".
CATEGORY_RANGES = (
    (RESTAURANT, 1, 1000, "Food"), (RESTAURANT, 1001, 2299, "Beverages"),
    (ROOM_SERVICE, 1, 499, "Food"), (ROOM_SERVICE, 500, 2999, "Beverages"),
)
# Category ranges of outlets not listed by name.
OTHER_OUTLET_RANGES = ((1, 1000, "Food"), (1001, 2999, "Beverages"))

# Restaurant food, (first, last, subcategory); other numbers up to 1000 are main courses.
RESTAURANT_FOOD = (
    (1, 40, "Breakfast"), (41, 80, "Appetizer"), (81, 120, "Dessert"), (121, 160, "Pasta"),
    (161, 200, "Extra For Pasta"), (201, 240, "Pizza"), (241, 280, "Easy Bite"), (281, 1000, "Main Course"),
)
# Restaurant drinks 1001-2999, (number prefixes, subcategory); others are "Beverages".
RESTAURANT_DRINKS = (
    (("100",), "Coffee"), (("104",), "Tea"), (("108",), "Softdrink"), (("112",), "Mineral Water"),
    (("114",), "Juice"), (("118",), "Mocktail"), (("122",), "Mixer"), (("200",), "Beer"),
    (("204", "205", "206", "207", "208"), "Cocktail"),
    (("210", "211", "212", "213", "214", "215"), "Shoot"), (("22",), "Bottle"),
)
# Restaurant articles from 3000, (number prefix, subcategory); others are "Others".
RESTAURANT_REST = (
    ("23", "Promo"), ("30", "Cigarette"), ("31", "Miscellaneous"), ("35", "Merchandise"), ("40", "Soju"),
    ("69", "Compliment Cake"), ("891", "Discount"), ("98", "Compliment"), ("990", "Cash"),
    ("991", "Voucher"), ("993", "Credit Card"), ("995", "City Ledger"),
)
# Articles that do not count as merchandise although they start with 35.
NOT_MERCHANDISE = (3514, 3515, 3516)

# Room service, (first, last, subcategory); others are "Others".
ROOM_SERVICE_ITEMS = (
    (1, 10, "Dessert"), (40, 49, "Pasta"), (121, 129, "Pizza"), (160, 199, "Snack"), (200, 499, "Main Course"),
    (500, 599, "Beer"), (600, 699, "Cocktail"), (700, 799, "Canned"), (800, 899, "Water"), (900, 999, "Coffee"),
    (1000, 1099, "Mocktail"), (1100, 1199, "Tea"), (1200, 1299, "Juice"), (2000, 2999, "Bottle"),
    (3000, 3099, "Promo"),
)
# Banquet articles; others are "Other".
BANQUET_ITEMS = ((3, "Room Rental"), (4, "Coffee Break"), (5, "Lunch"), (6, "Dinner"))


def _first_match(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    if not rules:
        return otherwise
    chain = F.when(*rules[0])
    for condition, value in rules[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def room_type_desc(c: Column) -> Column:
    code = F.upper(F.coalesce(c, F.lit("")))
    return _first_match([(code.startswith(p), F.lit(d)) for p, d in ROOM_TYPES], F.lit(""))


def age_group(c: Column) -> Column:
    """Null ages fall into the open top group."""
    rules = [(c < AGE_GROUPS[0][0], F.lit("unidentified"))]
    rules += [(c.between(lo, hi), F.lit(f"{lo}-{hi}")) for lo, hi in AGE_GROUPS]
    return _first_match(rules, F.lit("65+"))


def article_category(number: Column, outlet: Column) -> Column:
    outlet = F.trim(F.coalesce(outlet, F.lit("")))
    rules = [((outlet == o) & number.between(lo, hi), F.lit(label)) for o, lo, hi, label in CATEGORY_RANGES]
    rules += [(~outlet.isin(*OUTLETS) & number.between(lo, hi), F.lit(label)) for lo, hi, label in OTHER_OUTLET_RANGES]
    return _first_match(rules, F.lit("Others"))


def _by_prefix(digits: Column, rules: tuple[tuple[tuple[str, ...], str], ...], otherwise: str) -> Column:
    """Label of the longest known prefix: one map lookup per prefix length, so the generated code stays small."""
    lengths = sorted({len(p) for prefixes, _ in rules for p in prefixes}, reverse=True)
    tables = [
        F.create_map(*[F.lit(x) for prefixes, label in rules for p in prefixes if len(p) == n for x in (p, label)])
        for n in lengths
    ]
    found = [F.try_element_at(t, F.substring(digits, 1, n)) for t, n in zip(tables, lengths)]
    return F.coalesce(*found, F.lit(otherwise))


def _by_range(number: Column, rules: tuple[tuple[int, int, str], ...], otherwise: str) -> Column:
    """Label of the range a number falls in: a lookup of how many ranges start at or below it."""
    starts = F.array(*[F.lit(lo) for lo, _, _ in rules])
    ends = F.array(*[F.lit(hi) for _, hi, _ in rules])
    labels = F.array(*[F.lit(label) for _, _, label in rules])
    place = F.size(F.filter(starts, lambda lo: lo <= number))
    inside = (place > 0) & (number <= F.get(ends, place - 1))
    return F.when(inside, F.get(labels, place - 1)).otherwise(F.lit(otherwise))


def article_subcategory(number: Column, outlet: Column) -> Column:
    outlet = F.trim(F.coalesce(outlet, F.lit("")))
    digits = number.cast("string")
    rest = tuple(((p,), label) for p, label in RESTAURANT_REST)
    from_3000 = F.when(number.isin(*NOT_MERCHANDISE), F.lit("Others")).otherwise(_by_prefix(digits, rest, "Others"))
    restaurant = (
        F.when(number < 1, F.lit("Unknown"))
        .when(number <= 1000, _by_range(number, RESTAURANT_FOOD, "Unknown"))
        .when(number <= 2999, _by_prefix(digits, RESTAURANT_DRINKS, "Beverages"))
        .otherwise(from_3000)
    )
    banquet = F.try_element_at(F.create_map(*[F.lit(x) for n, label in BANQUET_ITEMS for x in (n, label)]), number.cast("int"))
    return (
        F.when(outlet == RESTAURANT, restaurant)
        .when(outlet == ROOM_SERVICE, _by_range(number, ROOM_SERVICE_ITEMS, "Others"))
        .when(outlet == BANQUET, F.coalesce(banquet, F.lit("Other")))
        .otherwise(F.lit("Unknown"))
    )
