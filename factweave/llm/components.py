"""Problem 5: connected components of pairwise matches by seed-tree pruning.

Each round works on an undirected graph that shrinks:

1. every vertex tells its neighbourhood (itself included) the neighbourhood's
   minimum;
2. a vertex that hears several minima links the others to the smallest of them:
   these links are the next round's graph;
3. a vertex that is nobody's minimum can't become a seed.  It leaves the graph
   and hangs below the smallest minimum it heard, as a child in the propagation
   forest.

Vertices that stay without links are the seeds, the minima of their components.
When the graph is empty the forest is collapsed: every vertex takes over its
parent's parent until all parents are seeds, which takes as many steps as the
logarithm of the forest's depth.

No step collects a neighbourhood: minima are aggregates with map-side partial
results, and a hot vertex is spread by AQE's skew join.  Each round's graph is
written to the shared folder, so a lost executor costs one round's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of distinct undirected edges (a, b)."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame, scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component): the smallest vertex, in order of the type, of the
    component of each vertex that has an edge to another vertex.

    Null ends and loops are ignored, repeated edges count once.  An input without
    usable edges gives an empty result.
    """
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    graph = scratch.write(e.where("x and y and a <> b").select("a", "b").distinct())
    forest: list[DataFrame] = []
    while not graph.isEmpty():
        both = symmetric(graph)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # what each vertex hears: from itself, and from every neighbour u -> v
        heard = both.join(least, "u").select(F.col("v").alias("h"), "m").unionByName(least.select(F.col("u").alias("h"), "m"))
        heard = scratch.write(heard.distinct())
        best = scratch.write(heard.groupBy("h").agg(F.min("m").alias("best"), F.max(F.col("m") == F.col("h")).alias("stays")))
        forest.append(best.where("not stays").select(F.col("h").alias("child"), F.col("best").alias("parent")))
        links = heard.join(best.select("h", "best"), "h").where("m <> best").select(F.col("best").alias("a"), F.col("m").alias("b")).distinct()
        nxt = scratch.write(links)
        scratch.drop(graph, heard)
        graph = nxt
    if not forest:
        empty = graph.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        return empty.where(F.lit(False))
    tree = forest[0]
    for f in forest[1:]:
        tree = tree.unionByName(f)
    tree = scratch.write(tree)
    while True:
        up = tree.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        step = tree.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        step = scratch.write(step)
        done = step.where("moved").isEmpty()
        scratch.drop(tree)
        tree = step.drop("moved")
        tree._scratch_path = step._scratch_path
        if done:
            break
    seeds = tree.select("parent").distinct().select(F.col("parent").alias("vertex"), F.col("parent").alias("component"))
    return tree.select(F.col("child").alias("vertex"), F.col("parent").alias("component")).unionByName(seeds)


def fact_groups(relationships: DataFrame, facts: DataFrame, scratch, kind: str = "corroborates") -> DataFrame:
    """(fact_id, group_id) of facts linked by relationships of ``kind``.

    A link joins two different ids that are both in ``facts``; letter case and
    outer blanks of ``relationship_type`` are ignored.  ``group_id`` is the
    smallest id, in string order, of all facts linked directly or indirectly.
    Null ends or types, self pairs, repeated pairs and ends that are not in
    ``facts`` make no link.
    """
    links = relationships.where(F.lower(F.regexp_replace("relationship_type", r"(?U)^\s+|(?<!\s)\s+$", "")) == kind)
    links = links.where("fact_a_id <> fact_b_id").select(F.least("fact_a_id", "fact_b_id").alias("a"), F.greatest("fact_a_id", "fact_b_id").alias("b")).distinct()
    known = facts.select(F.col("id")).where("id is not null")
    links = links.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi")
    return components(links, scratch).select(F.col("vertex").alias("fact_id"), F.col("component").alias("group_id"))
