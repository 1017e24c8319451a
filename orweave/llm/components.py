"""Connected components of a graph given as a table of edges, by alternating star contraction.

Each round hangs every node's larger neighbours onto its smallest neighbour (large star), then
every node's smaller neighbours onto the smallest of them (small star), until the edges are
stars around the smallest member of each component. A round is two aggregations and two
equi-joins; no neighbour list is ever gathered in one row. The edges of a round are a written table,
which cuts the lineage; smallest neighbours are kept on disk within their round, gathered into fewer
partitions than they were dealt out to, so that the join doesn't rest on how they were: a hub with a third
of all edges is a skewed join of two sides that are shuffled for it, which Spark splits.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orweave.llm import common


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """One star step over edges (a, b), a > b: the new edges, and what to release once they are there."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.few_files(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))).persist(StorageLevel.DISK_ONLY)
        hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = common.few_files(edges.groupBy("a").agg(F.min("b").alias("m"))).persist(StorageLevel.DISK_ONLY)
        hung = edges.join(least, "a").select("a", "b", "m")
        hung = hung.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return hung.where("a != b").distinct(), least


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs onto one other, which itself hangs onto none."""
    n, nodes = edges.agg(F.count("*"), F.count_distinct("a")).first()
    return n == nodes and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is its smallest node.

    ``edges`` has two columns of one orderable type, in any order; loops and repeats don't matter.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    spark = edges.sparkSession
    state, path = common.table_at(edges, "edges", few=1)
    while not _stars(state):
        hung, first = _star(state, True)
        hung = hung.persist(StorageLevel.DISK_ONLY)
        small, second = _star(hung, False)
        state, new = common.table_at(small, "edges", few=1)
        for old in (first, hung, second):
            old.unpersist()
        common.remove(spark, path)
        path = new
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
