"""Connected components of a table of links, by repeated contraction.

Each round sends every node to the least of itself and its neighbours and replaces links by links between
what their ends were sent to; nodes that are hashes make the number of rounds logarithmic. Both tables are
written to the shared folder each round, and those of the round before deleted. Nothing is collected but
whether links are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of links (a, b); component is one node of each component."""
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = materialize(nodes.withColumn("component", F.col("node")), "components")
    while not links.isEmpty():
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        least = materialize(both.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("to")).select("from", F.least("from", "to").alias("to")), "least")
        moved = materialize(found.join(least, found.component == least["from"], "left").select("node", F.coalesce("to", "component").alias("component")), "components")
        left = links.join(least, links.a == least["from"]).select(F.col("to").alias("a"), "b")
        left = left.join(least, left.b == least["from"]).select("a", F.col("to").alias("b"))
        left = materialize(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        discard(links, least, found)
        links, found = left, moved
    discard(links)
    return found
