"""Connected components by alternating stars, in DataFrame operations only.

A round has a dozen stages.  Each runs in as many tasks as its edges need, whose number is known
and never grows; a task for every shuffle partition would cost more files and log than rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, renew

#: Edges that a task handles; from as many tasks as there are partitions on, nothing is gathered.
EDGES_A_TASK = 50_000


def _parents(edges: DataFrame, tasks: int) -> DataFrame:
    """(of, m): the least of each node's lesser neighbours.

    Written out, so that the join with it is between two plain exchanges: a node with very many
    neighbours makes a skewed partition of edges, which adaptive execution then splits.
    """
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m").coalesce(tasks))


def _large(edges: DataFrame, tasks: int) -> DataFrame:
    """Tie every greater neighbour of a node to the least of its neighbourhood.  Each edge has u > v."""
    tied = edges.join(_parents(edges, tasks), F.col("v") == F.col("of"), "left")
    return tied.select("u", F.coalesce("m", "v").alias("v")).coalesce(tasks).distinct().coalesce(tasks)


def _small(edges: DataFrame, tasks: int) -> DataFrame:
    """Tie a node and its lesser neighbours to the least of them.

    Both kinds of edges come from one array: a union would carry what is known of each side's rows
    into the next round's plan, which then doubles from round to round.
    """
    tied = edges.join(_parents(edges, tasks), F.col("u") == F.col("of"))
    both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return tied.select(F.explode(both).alias("e")).select("e.u", "e.v").where("u > v").coalesce(tasks).distinct().coalesce(tasks)


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node of a pair can reach.

    Pairs of a node with itself or with null are left out.  The edges are written after every
    round; only their number and a checksum come to the driver, to see when they stay the same.
    """
    edges = pairs.where(F.col(a) != F.col(b))
    edges = renew(cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()))
    last = None
    while True:
        check = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
        state = edges.agg(F.count(F.lit(1)).alias("n"), check).first()
        if state["n"] == 0 or state == last:
            break
        last = state
        tasks = -(-state["n"] // EDGES_A_TASK)
        edges = renew(cut(_small(cut(_large(edges.coalesce(tasks), tasks)), tasks)))
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
