"""Connected components of links between ids, with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import stored


def components(links: DataFrame) -> DataFrame:
    """(id, root): for every id of ``links`` (a, b) the smallest id it is linked with, over any number of links; roots themselves are left out.

    Alternates two steps until nothing changes: each id's larger neighbours point to its smallest neighbour, then its smaller
    ones and itself do. Neighbours are summed up with map-side minima, no id's neighbours meet in one row, and each round is
    written to the checkpoint folder. Links with a null end or equal ends are ignored.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        edges = stored(small)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = now
