"""Connected components of a table of links, by stars that shrink: no link list or component is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vahi.llm.common import join_by, stored


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest node of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
    return join_by(both, least, "a", "n", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    least = stored(links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    hung = join_by(links, least, "a", "n", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _left(links: DataFrame) -> tuple[int, int]:
    """How many links (a, b), a > b, there are, and how many nodes keep them from being stars: nodes hung on two others, or hung while others hang on them."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, bad = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1))).first()
    return n, bad


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b): the smallest node reachable. Ends within about log(n) squared rounds, as soon as only stars are left."""
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    n, bad = _left(links)
    while bad:
        links = stored(_small_star(stored(_large_star(links, n), "links"), n), "links")  # a large star has at most as many as before
        n, bad = _left(links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def with_links(label: DataFrame, links: DataFrame) -> DataFrame:
    """The (node, component) of components() after more links (a, b); its stars stand for the links before."""
    if not links.head(1):
        return label
    return components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
