"""Exact duplicates by deterministic block naming, with DataFrame operations only.

The normalised text is cut into blocks of ``block_bytes`` bytes. The distinct blocks of the whole corpus are
sorted and numbered; a number is a block's *name*. Then the names of neighbouring blocks are paired, the
distinct pairs sorted and numbered in turn, until every document has one name. Two documents have the same
number of blocks and the same last name if and only if their texts are equal: names are given to contents,
not to hashes of them.

A 64-bit hash only routes a block to its name, so that texts are shuffled once. Where two different blocks
share a hash (``collisions``), the blocks themselves are joined instead.

Scale: one shuffle carries the text, already collapsed map-side, so a block that a third of all rows share
arrives once per map task. All other steps move a few numbers per document. Joins read staged tables on
both sides, so Spark splits hot keys. Only documents of more than one block take part in the levels.

Defined cases: null text counts as empty and equals it; of equal texts the largest doc_id stays, of repeated
rows of that doc_id exactly one; null doc_ids rank last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, ascii_lower, stage

#: Stands for the missing right half of the last pair.
NOTHING = -(2**63)


def exact_groups(docs: DataFrame, block_bytes: int = 1024, route: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``route`` is the hash of a block; tests force collisions with a weak one.
    """
    texts = docs.select("doc_id", F.coalesce(ascii_lower(F.col("text")), F.lit("")).cast("binary").alias("__tm_text"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("__tm_text") / F.lit(block_bytes))).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), n_blocks - 1),
        lambda i: F.substring(F.col("__tm_text"), i * F.lit(block_bytes) + 1, F.lit(block_bytes)),
    )

    distinct = texts.select(F.explode(cut).alias("block")).distinct()
    named = Staged(_named(distinct, ["block"]).select(route(F.col("block")).alias("h"), "name"), "block-names")
    clash = Staged(named.df.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "block-clashes")
    clashes = clash.df.count()

    rows = texts.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        n_blocks.alias("n_blocks"),
        F.unhex(F.sha2("__tm_text", 256)).alias("sha"),
        F.transform(cut, lambda b: route(b)).alias("hs"),
        *([cut.alias("blocks")] if clashes else []),
    )
    rows = Staged(rows, "rows")
    parts = rows.df.select("uid", "n_blocks", F.posexplode("hs").alias("pos", "h"))
    names = named.df if not clashes else named.df.join(clash.df, "h", "left_anti")
    known = parts.join(names, "h").select("uid", "n_blocks", "pos", "name")
    if clashes:
        split = rows.df.select("uid", "n_blocks", F.posexplode("blocks").alias("pos", "block"))
        split = split.withColumn("h", route(F.col("block"))).join(clash.df, "h", "left_semi")
        exact = stage(_named(split.select("block").distinct(), ["block"]).select("block", (-F.col("name") - 1).alias("name")), "block-exact")
        known = known.unionByName(split.join(exact, "block").select("uid", "n_blocks", "pos", "name"))
    level = Staged(known.select("uid", "n_blocks", "pos", "name", F.col("n_blocks").alias("left")), "level0")
    for table in (named, clash):
        table.drop()
    levels = [level]

    done = [level.df.where("left = 1").select("uid", "n_blocks", "name")]
    longest = rows.df.agg(F.max("n_blocks")).first()[0] or 0
    while longest > 1:
        longest = (longest + 1) // 2
        pairs = (
            level.df.where("left > 1")
            .groupBy("uid", "n_blocks", "left", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NOTHING)).alias("b"),
            )
        )
        pairs = Staged(pairs, "pairs")
        given = Staged(_named(pairs.df.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        level = Staged(
            pairs.df.join(given.df, ["a", "b"]).select("uid", "n_blocks", "pos", "name", F.ceil(F.col("left") / 2).cast("int").alias("left")),
            "level",
        )
        pairs.drop()
        given.drop()
        levels.append(level)
        done.append(level.df.where("left = 1").select("uid", "n_blocks", "name"))

    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    ids = stage(whole.join(rows.df.select("uid", "doc_id", "sha"), "uid"), "identities")
    for table in (rows, *levels):
        table.drop()
    best = F.max(F.struct("doc_id", "uid"))
    groups = stage(ids.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), best.alias("best")), "groups")
    return ids.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Number distinct keys in sorted order: partitions hold disjoint keys, so (partition, rank) is unique."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())

