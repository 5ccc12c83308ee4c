"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.operators import graph


def components(links: DataFrame) -> DataFrame:
    """links (a, b), any order, repeats and loops allowed, to (node, component): the smallest node reachable, for every node
    that a link to another holds."""
    return graph.components_by_rounds(graph.canonical(links.select("a", "b"), "a", "b")).withColumnRenamed("vid", "node")
