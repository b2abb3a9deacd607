"""Union-find as Spark jobs: connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycolumn.session import cut_lineage


def _mapped(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``column`` replaced by its parent where it has one."""
    renamed = parents.select(F.col("id").alias("_id"), F.col("component").alias("_parent"))
    return (df.join(renamed, df[column] == F.col("_id"), "left")
            .withColumn(column, F.coalesce(F.col("_parent"), F.col(column))).drop("_id", "_parent"))


def _oriented(edges: DataFrame) -> DataFrame:
    return (edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns a, b. Returns (id, component) for each vertex that is not the smallest of its
    component; ``component`` is that smallest vertex.

    A round gives each vertex its smallest smaller neighbour, follows these pointers to their roots by doubling
    and contracts the edges to roots. A star needs one round. All tables are written, so no round recomputes
    another, and joins on a hot vertex are plain equi-joins that skew handling can split.
    """
    edges, result = cut_lineage(_oriented(edges)), None
    while not edges.isEmpty():
        parents = cut_lineage(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")))
        while True:
            further = cut_lineage(_mapped(parents.withColumn("_old", F.col("component")), "component", parents))
            parents = further.drop("_old")
            if further.filter("component <> _old").isEmpty():
                break
        result = parents if result is None else cut_lineage(_mapped(result, "component", parents).unionByName(parents))
        edges = cut_lineage(_oriented(_mapped(_mapped(edges, "a", parents), "b", parents)))
    if result is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return result
