"""Connected components of links between ids, by alternating star contractions.

Each turn points an id's larger neighbours at its smallest one (large star) and
then its smaller neighbours at the smallest (small star), until every id points
at the smallest of its component. Turns are stored in the shared folder; sums
of hashes tell when nothing changes. Minima are partial aggregates, so an id
with very many links is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitally.session import settle


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """id, root (the smallest id that links reach) for every id that has a link
    to another one. ``links`` has the columns a and b."""
    big, small = F.greatest("a", "b"), F.least("a", "b")
    edges = settle(
        links.filter("a <> b").select(big.alias("u"), small.alias("v")).distinct(), "links"
    )
    state = None
    while True:
        now = _state(edges)
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u").filter("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        )
        large = settle(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = settle(
            joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct(),
            "small-star",
        )
