"""Connected components of links, by tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A row per node of links: node, label, its component's smallest node.

    Every round each node hooks to its smallest neighbour. Only pairs of nodes can have chosen each
    other in a circle; the smaller is their root. Trees are followed to their roots by doubling, and
    links between roots go on to the next round. A tree has two nodes at least, so each round halves
    the nodes left at least, whatever their names and however long a chain is, and the rounds go on
    until no link is left. Sums run partially before each shuffle, so a node of very many links is
    no hot group. Nothing but whether rows are left reaches the driver.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a)))
    edges = materialize(both.where("node <> other").distinct(), "graph-links", 2 * links.count())
    labels, total = None, edges.count()
    while labels is None or edges.limit(1).count():
        up = roots(edges, total)
        over = up.select(F.col("node").alias("label"), "up")
        made = labels.join(over, "label", "left").select("node", F.coalesce("up", "label").alias("label")) if labels is not None else up.select("node", F.col("up").alias("label"))
        labels = materialize(made, "graph-labels", total)
        ends = edges.join(up, "node").select("other", F.col("up").alias("a")).join(up.select(F.col("node").alias("other"), F.col("up").alias("b")), "other")
        edges = materialize(ends.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other")).distinct(), "graph-links", total)
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return materialize(labels.join(least, "label").select("node", F.col("least").alias("label")), "graph-labels", total)


def roots(edges: DataFrame, total: int) -> DataFrame:
    """node, up: the root of the tree that each node of edges (node, other; both ways; at most `total`) hooks into."""
    hooks = edges.groupBy("node").agg(F.min("other").alias("low"))
    back = hooks.select(F.col("node").alias("low"), F.col("low").alias("again"))
    root = (F.col("again") == F.col("node")) & (F.col("node") < F.col("low"))
    up = materialize(hooks.join(back, "low").select("node", F.when(root, F.col("node")).otherwise(F.col("low")).alias("up")), "graph-roots", total)
    while True:
        above = up.select(F.col("node").alias("up"), F.col("up").alias("jump"))
        stepped = materialize(up.join(above, "up").select("node", "up", "jump"), "graph-roots", total)
        if not stepped.where("jump <> up").limit(1).count():
            return up
        up = stepped.select("node", F.col("jump").alias("up"))
