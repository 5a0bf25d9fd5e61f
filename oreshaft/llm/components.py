"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def components(links: DataFrame, s: Scratch) -> DataFrame:
    """(v, label) for every vertex of links (a, b): label is the least vertex reachable.

    In each round a vertex takes the least of its neighbours' labels and of its label's
    label, until none changes: a number of rounds logarithmic in a component's
    diameter. Each round is written out, so that lost executors cost one round. Minima
    are reduced before they are shuffled; joins on a hot vertex are split by Spark.
    """
    pairs = links.where("a <> b")
    edges = s.written(pairs.select("a", "b").union(pairs.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = s.written(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        near = edges.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        up = labels.select(F.col("v").alias("label"), F.col("label").alias("up"))
        new = labels.select("v", "label").join(near, "v").join(up, "label")
        labels = s.written(new.select("v", F.least("near", "up").alias("label"), (F.least("near", "up") < F.col("label")).alias("moved")), "labels")
    return labels.select("v", "label")
