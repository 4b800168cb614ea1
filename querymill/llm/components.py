"""Connected components of links between documents, by alternating stars."""

from pyspark.sql import DataFrame, functions as F

from querymill.session import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the smallest node of its component.

    Each round hangs the neighbours of a node below the smallest of them, first the larger neighbours, then the
    smaller ones; after a number of rounds that grows with the logarithm of the longest path, all hang below their
    root. Smallest neighbours are aggregates combined before the shuffle and written before the join, so a node with
    any number of neighbours is split among tasks. Nothing but a row count reaches the driver. Null ends and loops
    are left out.
    """
    edges = scratch.cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hang(scratch, both, "b > a", keep_own=False)
        small = _hang(scratch, large, "b < a", keep_own=True)
        changed = small.exceptAll(edges).limit(1).count() or edges.exceptAll(small).limit(1).count()
        scratch.drop(edges, large)
        edges = small
        if not changed:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )


def _hang(scratch: Scratch, edges: DataFrame, which: str, keep_own: bool) -> DataFrame:
    """Hang the neighbours b of each a that satisfy ``which`` below the least of a and its neighbours."""
    least = scratch.cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
    moved = edges.where(which).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if keep_own:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    out = scratch.cut(moved.where("a <> b").distinct())
    scratch.drop(least)
    return out
