"""Bulk duplicate guests: a similarity join inside each birth date, collapsed to groups.

Two guests of one birth date are linked when their normalised names (upper case, every run of characters other than
A-Z and 0-9 one space, trimmed) are equal, when one name's words stand as a contiguous run in the other's
(``CUSTOMER 7`` in ``MR CUSTOMER 7``), or when the names are one edit apart (Levenshtein distance 1). Groups are the
connected components of these links; a group's id is its smallest guest id.

No pairs of a birth date are formed. Guests of one name are one node. Candidates come from keys that only near names
share, so even a default birth date held by a third of the guests is spread over its names:

- one edit, same length: names that agree once the character at one position is deleted differ only there, so all
  names of a (date, deleted position, rest) key are linked; the key becomes a star to its smallest node, and a key
  holds at most as many names as there are characters;
- one edit, lengths apart by one: the shorter name equals one deletion of the longer, an equi-join of deletions with
  whole names, one edge per deletion at most;
- containment: every contiguous run of a name's words joined with whole names, one edge per run at most.

The components are label-propagation stars over these edges, each aggregated before its shuffle.

Cases: guests without birth date or whose name normalises to nothing are in no group; repeated rows of one id count
once; only groups of two or more guests are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotelspark.operators.components import component_max


def normalised(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(name), "[^A-Z0-9]+", " "))


def _deletions(n: Column) -> Column:
    """(pos, rest) for every position of ``n``: the name with that character taken out."""
    return F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.struct(
        i.alias("pos"), F.concat(F.substring(n, F.lit(1), i - 1), F.substring(n, i + 1, F.length(n))).alias("rest")))


def _runs(n: Column) -> Column:
    """Every contiguous run of the words of ``n`` shorter than all of them, joined by spaces."""
    words = F.split(n, " ")
    size = F.size(words)
    starts = F.sequence(F.lit(1), size)
    return F.flatten(F.transform(starts, lambda s: F.transform(
        F.sequence(F.lit(1), size - s + 1), lambda k: F.array_join(F.slice(words, s, k), " "))))


def similar_guests(prof: DataFrame) -> DataFrame:
    """(id, birth_date, group_id, guests) of every guest in a group of two or more."""
    guests = prof.select("id", "birth_date", normalised(F.col("name")).alias("n")).filter(
        F.col("birth_date").isNotNull() & F.col("id").isNotNull() & (F.col("n") != "")).distinct()
    # A node per (date, name): its smallest id, negated so that the largest label is the smallest id.
    nodes = guests.groupBy("birth_date", "n").agg((-F.min("id")).alias("node"))
    deleted = nodes.select("birth_date", "node", F.explode(_deletions(F.col("n"))).alias("d")).select(
        "birth_date", "node", "d.pos", "d.rest")
    same_length = deleted.groupBy("birth_date", "pos", "rest").agg(F.max("node").alias("hub"), F.count(F.lit(1)).alias("k")).filter(
        "k > 1").join(deleted, ["birth_date", "pos", "rest"]).select("birth_date", F.col("node").alias("src"), F.col("hub").alias("dst"))
    whole = nodes.select("birth_date", F.col("n").alias("rest"), F.col("node").alias("dst"))
    shorter = deleted.join(whole, ["birth_date", "rest"]).select("birth_date", F.col("node").alias("src"), "dst")
    runs = nodes.select("birth_date", "node", F.explode(_runs(F.col("n"))).alias("rest")).join(whole, ["birth_date", "rest"]).select(
        "birth_date", F.col("node").alias("src"), "dst")
    edges = same_length.unionByName(shorter).unionByName(runs).filter(F.col("src") != F.col("dst"))
    labels = component_max(edges, ["birth_date"]).select("birth_date", "node", (-F.col("label")).alias("group_id"))
    members = guests.join(nodes, ["birth_date", "n"]).join(labels, ["birth_date", "node"], "left").select(
        "id", "birth_date", F.coalesce("group_id", -F.col("node")).alias("group_id"))
    sizes = members.groupBy("birth_date", "group_id").agg(F.count(F.lit(1)).alias("guests")).filter("guests > 1")
    return members.join(sizes, ["birth_date", "group_id"]).select("id", "birth_date", "group_id", "guests")
