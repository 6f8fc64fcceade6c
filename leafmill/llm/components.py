"""Connected components of links, by repeated contraction with DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of `links` (a, b: long); equal labels mean connected. Labels are vertices.

    Each round points every vertex at its smallest neighbour or itself, jumps once more along these pointers, and replaces
    the links' ends by what they point at; links within one vertex go. Vertices left shrink by a constant factor or
    better. Each round is written to the shared folder, so lineage stays short. Only aggregates by minimum are shuffled by
    vertex, combined before; a vertex with very many links is split by adaptive joins. Null ends are ignored.
    """
    links = materialize(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    parents = links.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    while links.limit(1).count():
        both = links.union(links.select("b", "a"))
        step = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        step = materialize(step, "pointers")
        jump = step.alias("s").join(step.select(F.col("a").alias("at"), F.col("to").alias("far")), F.col("s.to") == F.col("at")).select("a", F.least("to", "far").alias("to"))
        jump = materialize(jump, "pointers")
        ends = links.join(jump.select(F.col("a"), F.col("to").alias("x")), "a").join(jump.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        links = materialize(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        parents = materialize(parents.join(jump.select(F.col("a").alias("component"), "to"), "component", "left").select("vertex", F.coalesce("to", "component").alias("component")), "parents")
    return parents
