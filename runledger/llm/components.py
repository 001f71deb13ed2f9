"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of
    that label, so a chain shortens by half and a star settles at once. Labels are
    aggregated before they are shuffled, so a node with very many neighbours costs no
    more than others. Null ends and loops carry no link; an empty table gives no rows.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stored(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(),
        "links",
    )
    labels = stored(
        both.groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("near"))
        .select("node", F.least("node", "near").alias("component"), F.lit(True).alias("moved")),
        "labels",
    )
    while labels.where("moved").limit(1).count():
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        closer = labels.join(near, "node").select(
            "node", F.col("component").alias("before"),
            F.least("component", "near").alias("component"),
        )
        known = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        labels = stored(
            closer.join(known, "component", "left").select(
                "node", F.least("component", "beyond").alias("component"),
                (F.least("component", "beyond") < F.col("before")).alias("moved"),
            ),
            "labels",
        )
    return labels.select("node", "component")
