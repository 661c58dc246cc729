"""Connected components of a link table, by hooking and contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lossframe.llm.common import written


def _jumped(parent: DataFrame) -> DataFrame:
    """Parents of parents, until every node points at its root."""
    while True:
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        further = written(parent.join(up, "p").select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "cc-parent")
        parent = further.select("node", "p")
        if further.filter("moved").isEmpty():
            return parent


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the least node of its component.

    Each round hooks every node to its least neighbour, jumps to the roots and
    contracts the links to roots, so the links shrink; minima are combined
    before the shuffle, and every joined side is a written table, so Spark can
    split the rows of a hot root.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-links")
    label = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "cc-label")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("p"))
        parent = _jumped(written(hooked, "cc-parent"))
        label = written(label.join(parent.withColumnRenamed("node", "label"), "label", "left")
                        .select("node", F.coalesce("p", "label").alias("label")), "cc-label")
        mid = written(edges.join(parent.withColumnRenamed("node", "a"), "a").select(F.col("p").alias("a"), "b"), "cc-mid")
        edges = written(mid.join(parent.withColumnRenamed("node", "b"), "b").select(F.greatest("a", "p").alias("a"), F.least("a", "p").alias("b"))
                        .filter("a <> b").distinct(), "cc-links")
    return label
