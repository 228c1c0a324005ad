"""Connected components of links between documents, without collecting them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B


def components(links: DataFrame) -> DataFrame:
    """(node, label) for links(a, b): label is the least node of the component.

    Least labels travel along links and then jump to the label's own label, so a
    chain of n links takes about log n rounds.  Every step is a join or a combined
    minimum; a node with very many links is a skewed join key, which is split.
    Nulls are no nodes; repeated links and loops change nothing.
    """
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    both = B.saved(links.union(links.select("b", "a")).toDF("node", "other").distinct())
    label = B.saved(both.groupBy("node").agg(F.min(F.least("node", "other")).alias("label")))
    while True:
        near = both.join(label.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = label.join(near, "node").select("node", F.least("label", "near").alias("to"), "label")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new = B.saved(step.join(jump, "to", "left").select("node", F.least("to", "far").alias("label"), (F.least("to", "far") < F.col("label")).alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.select("node", "label")
        label = new.select("node", "label")
