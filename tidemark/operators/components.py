"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.staging import Staged


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as rows ``(node, label)``; the label is the least node.

    Alternates large-star and small-star steps until the edges are stars, so rounds grow with the logarithm
    of the longest path. Every round is staged, and each minimum too, so that the joins read shuffles whose
    hot keys Spark can split. Nodes without an edge (or only to themselves) are not returned.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = Staged(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = _checksum(now.df)
    while mark[0]:
        both = now.df.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            now.df.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        low = Staged(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "cc-min")
        large = Staged(
            both.join(low.df, "x").where("y > x and y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(),
            "cc-large",
        )
        least = Staged(large.df.groupBy("u").agg(F.min("v").alias("m")), "cc-min")
        small = (
            large.df.join(least.df, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.df.select("u", F.col("m").alias("v")))
            .distinct()
        )
        then = Staged(small, "cc")
        for old in (now, low, large, least):
            old.drop()
        now, before = then, mark
        mark = _checksum(now.df)
        if mark == before:
            break
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _checksum(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], int(row[1] or 0)
