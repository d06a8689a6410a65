"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import discard, join_counted, materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node reachable from each node that has an edge: rows (node, component) for edges (a, b) of long values.

    Alternates two steps, each one grouped aggregation and one join: every node links its larger neighbours to its
    smallest one, then its smaller neighbours and itself to the smallest one. Edges never get more than they were, and
    the graph becomes stars around the smallest nodes in a logarithmic number of rounds. A node's neighbours are never
    gathered: they meet as a minimum, and the minimum of a node with a large share of all edges reaches them by a
    broadcast. Each round is written in the shared folder. Loops and repeated edges do no harm; no edges give no rows.
    """
    links, size = measured(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    while size[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count("*").alias("copies"))
        large = join_counted(both, least, ["a"], 2 * size[0]).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = materialize(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("copies"))
        small = join_counted(large, least, ["a"], size[0]).filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        new, new_size = measured(small.filter("a <> b").distinct(), name)
        discard(large)
        discard(links)
        links, ended, size = new, size == new_size, new_size
        if ended:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def measured(edges: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """The edges, materialized, with their number and the sum of their hashes, both taken while they are written."""
    seen = Observation()
    kept = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hashes")), name)
    return kept, (seen.get["n"], int(seen.get["hashes"] or 0))


def joined(parts: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """Components (node, component) after more links (a, b) between the nodes of parts, which components() gave, or other nodes.

    Only the links between parts go through the rounds. A part is known by its smallest node, so the smallest of its parts is the smallest node of a component.
    """
    for end in ("a", "b"):
        links = links.join(parts.select(F.col("node").alias(end), F.col("component").alias("part")), end, "left").withColumn(end, F.coalesce("part", end)).drop("part")
    met = materialize(components(links, name), name)
    members = parts.unionByName(met.select("node", F.col("node").alias("component"))).distinct()
    sizes = members.groupBy("component").agg(F.count("*").alias("copies"))
    to = sizes.join(met.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").withColumn("to", F.coalesce("to", "component"))
    return join_counted(members, to, ["component"], members.count()).select("node", F.col("to").alias("component"))
