"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinesieve.llm.shared import salted, staged


def _state(edges: DataFrame) -> tuple:
    """How many edges, and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame) -> DataFrame:
    """rows (u, v) with m, the least v of their u. Least ones are partial aggregates; a hub's rows are joined in shares."""
    return salted(rows, rows.groupBy("u").agg(F.min("v").alias("m")), "u", F.col("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the edges (a, b), two longs; a component is named by its smallest node.

    Each round is one job: every node's larger neighbours are tied to its smallest one, then its smaller neighbours are.
    Rounds end when the edges no longer change, after about the logarithm of the longest path; each is written to the
    shared folder. Self-loops are nodes alone.
    """
    rounds = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    loops = rounds.where("u = v").select(F.col("u").alias("node"))
    now = staged(rounds.where("u <> v"), "edges")
    state, before = _state(now), None
    while state[0] and state != before:
        before = state
        both = _with_least(now.union(now.select("v", "u")))
        large = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_least(large).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select("e.*")
        now = staged(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        state = _state(now)
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).union(loops).distinct()
    alone = roots.join(named.select("node"), "node", "left_anti")
    return named.union(alone.select("node", F.col("node").alias("component")))
