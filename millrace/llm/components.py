"""Connected components of links, by alternating star contractions.

Each round replaces links by links to the smallest neighbour, first for larger neighbours, then for
smaller ones; the rounds end when nothing changes, and then every link leads to the smallest member
of its component. A round is two aggregations (combined on the map side) and two joins; nothing is
collected. Every round is written to the shared folder, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import forget, small, write


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """From links (a, b), in any direction and order, to (node, component): every linked node and the smallest node of its component.

    Links with a null end and links of a node with itself say nothing. No links: no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = write(links.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "links")
    before = None
    while (state := _digest(now.df)) != before:
        before = state
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = write(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
        least = large.df.groupBy("a").agg(F.min("b").alias("m"))
        turned = large.df.join(least, "a")
        both = turned.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(turned.select("a", F.col("m").alias("b")))
        after = write(both.where("a <> b").distinct(), "links")
        forget(now.df.sparkSession, now, large)
        now = after
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def smallest_ids(found: DataFrame, classes: DataFrame) -> DataFrame:
    """From (node, component) in numbers of classes and (key, rep) to (key, component): the smallest rep of each linked class's component."""
    named = write(found.join(classes.select(F.col("key").alias("node"), "rep"), "node"), "named").df
    least = write(named.groupBy("component").agg(F.min("rep").alias("least")), "least")
    return named.join(small(least), "component").select(F.col("node").alias("key"), F.col("least").alias("component"))
