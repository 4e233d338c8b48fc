"""Connected components of a link table by contraction: every node hooks onto its smallest neighbour, trees become single nodes.

A round points each node to the smallest node it is linked with, itself left out. Such pointers meet no cycle but pairs
that point at each other, and the smaller node of that pair is the smallest of its whole tree. Pointers are then doubled
until all show the root, and the links are carried over to the roots. A tree has two nodes at least, so every round
leaves half of the nodes or fewer, and no graph, however long its chains, takes more than log2(nodes) rounds.

Defined cases
    * links of a node with itself, repeated links and links given both ways count once; nodes without another link are left out;
    * an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.llm.common import cut_lineage, heavy_keys, salted_join


def doubled(pointers: DataFrame) -> DataFrame:
    """(node, to) with every pointer followed to its end; an end points at itself. Takes log2(longest way) joins.

    Many nodes may point at one, so each join deals heavy ends over several tasks.
    """
    while True:
        further = pointers.select(F.col("node").alias("to"), F.col("to").alias("further"))
        joined = salted_join(pointers, further, ["to"], ["node"], heavy_keys(pointers, ["to"]))
        step = cut_lineage(joined.select("node", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
        pointers = step.select("node", "to")
        if step.filter("moved").limit(1).count() == 0:
            return pointers


def _hooked(links: DataFrame) -> DataFrame:
    """(node, to) of one round: the root of each node's tree, which is the smallest node of the tree."""
    both = links.select("a", "b").union(links.select("b", "a"))
    least = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")))
    further = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
    pairs = salted_join(least, further, ["to"], ["node"], heavy_keys(least, ["to"]))
    # The smaller of one step and two: both lie on the way, and of the last pair it is the root, for the root too.
    return doubled(cut_lineage(pairs.select("node", F.least("to", "further").alias("to"))))


def _between_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        side = roots.select(F.col("node").alias(end), F.col("to").alias(f"root_{end}"))
        links = salted_join(links, side, [end], ["a", "b"], heavy_keys(links, [end]))
        links = cut_lineage(links) if end == "a" else links
    a, b = F.col("root_a"), F.col("root_b")
    return links.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable. Each step is written to the shared folder."""
    left = cut_lineage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not rounds or left.limit(1).count():
        rounds.append(_hooked(left))
        left = cut_lineage(_between_roots(left, rounds[-1]))
    ends = rounds.pop()
    while rounds:
        # A root of this round that was linked on is a node of the next; the others are at their end.
        before = rounds.pop()
        side = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
        linked_on = salted_join(before, side, ["to"], ["node"], heavy_keys(before, ["to"])).select("node", F.col("end").alias("to"))
        done = before.join(ends.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to")
        ends = cut_lineage(linked_on.union(done))
    return ends.select("node", F.col("to").alias("component"))
