"""Connected components of an edge table, without any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded


def _pairs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once, without loops."""
    e = edges.where(F.col("a") != F.col("b"))
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Label every node of ``edges(a long, b long)`` with its component's least node.

    Contraction in rounds.  In a round each node hooks to its least neighbour
    if that is smaller, the hooks are shortened by pointer jumping until all
    point at roots, and the edges are rewritten onto roots; at least half of
    the nodes of every component that still has an edge vanish.  A hub's edges
    are only ever pre-aggregated (``min``) or joined between two written
    tables, so adaptive execution can split them; the driver builds no table of
    more than ``BROADCAST_ROWS`` rows.  Every round is written to
    the shared folder: into ``scratch``, or into one of its own of which only
    the result stays.

    Nulls, loops and repeated edges are ignored.  An edge table without proper
    edges gives an empty result.  Returns ``node long, component long`` for
    nodes that have an edge to another node.
    """
    if scratch is None:
        with Scratch(edges.sparkSession, "components") as own:
            return own.write(connected_components(edges, own), "labels", keep=True)
    edges, left = scratch.counted(_pairs(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()).distinct(), "edges")
    levels: list[tuple[DataFrame, int]] = []
    while left:
        hooks = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        hooks, moved = scratch.write(hooks, "hooks"), 1
        while moved:
            up = hooks.select(F.col("node").alias("to"), F.col("to").alias("upper"))
            jumped = hooks.join(bounded(up, left), "to", "left").select("node", F.coalesce("upper", "to").alias("next"), "to")
            jumped, moved = scratch.counted(jumped, "jumped", F.col("next") != F.col("to"))
            hooks = jumped.select("node", F.col("next").alias("to"))
        levels.append((hooks, left))
        half = edges.where("a < b").join(bounded(hooks.select(F.col("node").alias("a"), F.col("to").alias("x")), left), "a")
        half = scratch.write(half.select("b", "x"), "half")
        both = half.join(bounded(hooks.select(F.col("node").alias("b"), F.col("to").alias("y")), left), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges, left = scratch.counted(_pairs(both).distinct(), "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels, _ = levels[0]
    for deeper, size in levels[1:]:
        up = deeper.select(F.col("node").alias("to"), F.col("to").alias("upper"))
        labels = scratch.write(labels.join(bounded(up, size), "to", "left").select("node", F.coalesce("upper", "to").alias("to")), "labels")
    return labels.select("node", F.col("to").alias("component"))
