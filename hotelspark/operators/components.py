"""Connected components by label propagation joins (alternating large-star and small-star, Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotelspark.session import ensure_checkpoint_dir


def component_max(edges: DataFrame, scope: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """(scope..., node, label): every node of an undirected graph with the largest node of its component.

    Each star is an aggregation to one row per node and an equi-join back to the edges, so a hub node is
    combined on the map side and its edges may be split over tasks. A round is one large star and one small star
    in one job; the driver only sees whether the edge set still changes. Lineage is cut by reliable checkpoints.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.filter(F.col(src) != F.col(dst)).select(
        *scope, F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")
    ).distinct().checkpoint()
    seen = _fingerprint(pairs, scope)
    while True:
        # The large star keeps the number of edges, so duplicates are only removed after the small one.
        larger = _star(pairs, scope, both_ways=True)
        pairs = _star(larger, scope, both_ways=False).distinct().checkpoint()
        now = _fingerprint(pairs, scope)
        if now == seen:
            break
        seen = now
    labels = pairs.select(*scope, F.col("u").alias("node"), F.col("v").alias("label"))
    roots = labels.select(*scope, F.col("label").alias("node"), "label").distinct()
    return labels.unionByName(roots)


def _star(pairs: DataFrame, scope: list[str], both_ways: bool) -> DataFrame:
    """Link neighbours of a node to the largest of them; pairs are (u, v) with u < v and v nearer the root.

    ``both_ways`` is the large star: a node's smaller neighbours move to its largest neighbour. Otherwise the
    small star: a node's larger neighbours, and the node, move to the largest of those.
    """
    if both_ways:
        ends = pairs.unionByName(pairs.select(*scope, F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        ends = pairs
    top = ends.groupBy(*scope, "u").agg(F.max("v").alias("top"))
    top = top.withColumn("top", F.greatest("top", "u"))
    linked = ends.join(top, [*scope, "u"])
    moved = linked.filter(F.col("v") < F.col("u")) if both_ways else linked
    out = moved.select(*scope, F.col("v").alias("u"), F.col("top").alias("v"))
    if not both_ways:
        out = out.unionByName(top.select(*scope, "u", F.col("top").alias("v")))
    return out.filter(F.col("u") != F.col("v"))


def _fingerprint(pairs: DataFrame, scope: list[str]) -> tuple:
    """Size and order-free hash of a set of edges; equal sets give equal values."""
    h = F.xxhash64(*scope, "u", "v")
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
