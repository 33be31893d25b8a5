"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; target over size is the copies its documents should have, from
none to ``max_copies``. The whole part is given to every document; the fraction is rounded by pivoting: two
documents with fractional shares pass words to each other, one way or the other at random, until one of them
has a whole number of copies. The odds keep each document's expected copies, the exchange keeps the source's
words exactly. What a leaf block leaves over - one document with a fraction - goes up a reduction tree of fixed
fan-in and meets the leftovers of other blocks, until one document per source remains, which is rounded to the
nearer copy. So a source misses its target by half of one document at most.

Scale: leaves are blocks of about ``leaf`` documents of one source, dealt by a hash of doc_id (and of the row's
number where a doc_id repeats more than ``leaf / 8`` times), so a source with a third of
all rows is many blocks; each level of the tree shrinks the rows by ``fan_in``. Only ids and sizes move. Random
numbers come from hashes of doc_id and seed, blocks from hashes of doc_id, so reruns agree.

Defined cases: null text has size 0 and takes nothing; a source of size 0 has target 0; null sources form one
source, last in order; rows that repeat a doc_id are documents of their own; an empty table gives an empty
result; the number of sources is taken to be that of a catalogue: targets are windows over one row per source.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, stage, with_columns_last

ROW = "uid long, doc_id long, source string, block long, size long, p double"


def word_counts(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, source, size) of (uid, doc_id, source, text): words of ``[^\\x20\\x09-\\x0D]+`` in each text."""

    def count(batches):
        for batch in batches:
            sizes = [0 if (t := x.as_py()) is None else len(t.encode().split()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64())], ["uid", "doc_id", "source", "size"])

    return docs.mapInArrow(count, "uid long, doc_id long, source string, size long")


def source_targets(sizes: DataFrame, weights: list[int], budget: float, max_copies: int) -> DataFrame:
    """(source, source_size, target): ``budget`` times all words by weight, none above ``max_copies`` its size.

    A source is held at its cap if its cap per weight is below the rate that the sources not yet held would
    get; in order of cap per weight the held ones come first, so one pass of running sums finds them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_copies)
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(budget))
    free = F.sum("w").over(every) - F.coalesce(F.sum("w").over(by), F.lit(0))
    per = per.withColumn("rate", (total - F.coalesce(F.sum("cap").over(by), F.lit(0))) / free)
    held = F.col("cap") < F.col("rate") * F.col("w")
    per = per.withColumn("held", held).withColumn("rate", F.max(F.when(~F.col("held"), F.col("rate"))).over(every))
    target = F.when(F.col("held"), F.col("cap").cast("double")).otherwise(F.least(F.col("rate") * F.col("w"), F.col("cap").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def pivot(ids: list[int], sizes: list[int], shares: list[float], seed: int):
    """Round fractional shares in order: [(position, 0 or 1)], and the position left with a fraction.

    The held document k meets the next one i. Either k gains ``up`` copies from i or i gains from k what
    ``down`` copies of k are worth in words; the odds keep the expectation of both.
    """
    done, held = [], None
    for i, p in enumerate(shares):
        if p <= 0.0 or p >= 1.0:
            done.append((i, int(p >= 1.0)))
            continue
        if held is None:
            held = (i, p)
            continue
        k, q = held
        ratio = sizes[i] / sizes[k]
        up, down = min(1.0 - q, p * ratio), min(q, (1.0 - p) * ratio)
        draw = xxhash.xxh64_intdigest(f"{ids[k]},{ids[i]}", seed) / 2.0**64
        if draw * (up + down) < down:
            first_whole, q, p = up == 1.0 - q, q + up, p - up / ratio
        else:
            first_whole, q, p = down == q, q - down, p + down / ratio
        if not first_whole:
            done.append((i, int(p > 0.5)))
            held = (k, q)
            continue
        done.append((k, int(q > 0.5)))
        held = (i, p)
        if not 1e-9 < p < 1.0 - 1e-9:
            done.append((i, int(p > 0.5)))
            held = None
    return done, held


def round_copies(shares: DataFrame, leaf: int = 4096, fan_in: int = 64, seed: int = 42) -> DataFrame:
    """(uid, extra) with extra 0 or 1 for rows (uid, doc_id, source, size > 0, p in (0, 1))."""
    per = stage(shares.groupBy("source").agg(F.count("*").alias("n")), "per-source")
    n = per.agg(F.max("n")).first()[0] or 0
    blocks = F.ceil(F.col("n") / F.lit(leaf))
    often = stage(shares.groupBy(F.col("doc_id").alias("__tm_d")).agg(F.count("*").alias("__tm_n")).where(F.col("__tm_n") > leaf // 8), "repeated")
    salt = F.when(F.col("__tm_n").isNotNull(), F.col("uid")).otherwise(F.lit(0).cast("long"))
    key = F.pmod(F.xxhash64("doc_id", F.lit(seed), salt), F.greatest(F.lit(1), blocks)).cast("long")
    now = shares.join(per.withColumnRenamed("source", "__tm_s"), F.col("source").eqNullSafe(F.col("__tm_s")))
    now = now.join(often, F.col("doc_id") == F.col("__tm_d"), "left").select("uid", "doc_id", "source", key.alias("block"), "size", "p")
    width, done = max(1, -(-n // leaf)), []

    def level(last: bool):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["size", "doc_id", "uid"], ascending=[False, True, True], ignore_index=True)
            ids = group["doc_id"].tolist()
            sealed, held = pivot(ids, group["size"].tolist(), group["p"].tolist(), seed)
            p = [0.0] * len(group)
            for i, whole in sealed:
                p[i] = float(whole)
            if held:
                p[held[0]] = float(held[1] >= 0.5) if last else held[1]
            return group.assign(p=p)[["uid", "doc_id", "source", "block", "size", "p"]]

        return run

    while n:
        last = width == 1
        out = Staged(now.groupBy("source", "block").applyInPandas(level(last), ROW), "rounded")
        done.append(out.df.where("p = 0 or p = 1").select("uid", F.col("p").cast("int").alias("extra")))
        if last:
            break
        now = out.df.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / fan_in).cast("long"))
        width = -(-width // fan_in)
    if not done:
        return shares.select("uid", F.lit(0).alias("extra"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def plan_mix(docs: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_copies: int = 2, leaf: int = 4096, fan_in: int = 64, seed: int = 42) -> DataFrame:
    """One row per document: uid, doc_id, source, size, source_size, target, copies, taken.

    The uid numbers the rows of this call, unless ``docs`` brings numbers of its own as ``__tm_uid``.
    """
    uid = F.col("__tm_uid") if "__tm_uid" in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(uid.alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    sizes = stage(word_counts(rows), "sizes")
    targets = stage(source_targets(sizes, list(weights), budget, max_copies), "targets")
    rows = sizes.join(targets.withColumnRenamed("source", "__tm_s"), F.col("source").eqNullSafe(F.col("__tm_s"))).drop("__tm_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("int"))
    rows = stage(rows.withColumn("p", F.when(F.col("size") > 0, F.col("ratio") - F.col("whole")).otherwise(F.lit(0.0))), "shares")
    extra = round_copies(rows.where("p > 0 and p < 1").select("uid", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "source", "size", "p"), leaf, fan_in, seed)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)).cast("int")
    out = rows.join(stage(extra, "extra"), "uid", "left").withColumn("copies", copies)
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return out.select("uid", "doc_id", "source", "size", "source_size", "target", "copies", taken)


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, with their columns and copies and taken; see ``plan_mix``.

    Texts move once, to meet their copies by doc_id; the plan has a row for each text, so it is never broadcast. Where a doc_id is not unique the rows are numbered and staged
    first and meet their copies by number.
    """
    base = docs.select(*with_columns_last(docs, ["copies", "taken"]))
    rest = base.columns
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        base = stage(base.withColumn("__tm_uid", F.monotonically_increasing_id()), "numbered")
        own, same = "uid", F.col("__tm_uid") == F.col("__tm_key")
    else:
        own, same = "doc_id", F.col("doc_id").cast("long").eqNullSafe(F.col("__tm_key"))
    plan = stage(plan_mix(base, **how).where("copies > 0").select(F.col(own).alias("__tm_key"), "copies", "taken"), "plan")
    return base.join(plan.hint("merge"), same).select(*rest, "copies", "taken")
