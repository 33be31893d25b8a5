"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lower-cased, known by 128 hash bits: among
10^13 different lines the odds of any two being taken for one are below 10^-12. The store holds *runs*: tables
bucketed and sorted by key, one file a bucket, in which each key stands once in all runs together, with the number
of documents and the largest doc_id of the batch that brought it. A new batch becomes such a table, too, and is
merged with each run bucket by bucket, without a shuffle or a sort: keys the runs lack become a run of their own
(the anti-join), keys they have go to the log of repeats. ``fanout`` runs of a level are compacted to one of the
next, so a key is rewritten a logarithmic number of times. Totals come from runs and repeats.

Scale: a line moves as 16 bytes of hash; text moves once, when each document meets its own list of lines to
drop. A line of every document collapses map-side when it is counted, and the join that hands decisions back
reads staged tables on both sides, so Spark splits it. No list is longer than its own document.

Defined cases: null and empty text are one empty line; a document is its doc_id, so repeated rows of one
doc_id count once and lose the same lines, and rows without doc_id keep all lines and count for nothing;
an empty table gives an empty result; columns of the same names as ours are replaced.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_LOWER, Staged, shared_dir, stage, with_columns_last
from tidemark.staging import cleaned_shuffles

BLANK = b" \t\n\x0b\x0c\r"
#: A kept line dropped from the document leaves these counts behind.
ADDED = ["n_lines", "n_dropped"]


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """The hashes of a line's key, or None if the key is shorter than ``min_chars`` code points."""
    key = line.strip(BLANK).translate(ASCII_LOWER)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    whole = xxhash.xxh3_128_intdigest(key)
    return ((whole & (2**64 - 1)) - 2**63, (whole >> 64) - 2**63)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows (h1, h2, doc_id): each document's distinct keys."""

    def find(batches):
        for batch in batches:
            h1, h2, ids = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if doc_id is None or not text or len(text) < min_chars:
                    continue
                keys = {line_key(x, min_chars) for x in text.encode().split(b"\n")}
                keys.discard(None)
                for a, b in keys:
                    h1.append(a)
                    h2.append(b)
                    ids.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "h1 long, h2 long, doc_id long")


class Run:
    """Rows (h1, h2, n, top) as a table bucketed and sorted by key, in the shared folder."""

    def __init__(self, df: DataFrame, buckets: int, tag: str):
        self.spark, self.name = df.sparkSession, f"tm_{tag}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        # rows of a bucket are on one task, which writes them as one file
        dealt = df.select("h1", "h2", "n", "top").repartition(buckets, "h1", "h2")
        with merging(self.spark):
            dealt.write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.path).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def merging(spark):
    """Queries started inside take a bucket of one file as sorted, and keep no shuffle files."""
    key, was = "spark.sql.legacy.bucketedTableScan.outputOrdering", None
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        with cleaned_shuffles(spark):
            yield
    finally:
        spark.conf.set(key, was)


class LineRuns:
    """The store of runs. ``add`` takes one batch of ``line_keys``; batches must not share documents."""

    def __init__(self, fanout: int = 4, buckets: int = 8):
        self.fanout, self.buckets = fanout, buckets
        self.levels: list[list[Run]] = []
        self.repeats: list[Staged] = []

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        mine = Run(keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")), self.buckets, "batch")
        known = self.runs()
        if not known:
            return self._put(0, mine)
        fresh, again = mine.df, None
        for run in known:  # each key is in one run at most
            hit = mine.df.hint("merge").join(run.df.select("h1", "h2"), ["h1", "h2"], "left_semi")
            again = hit if again is None else again.unionByName(hit)
            fresh = fresh.hint("merge").join(run.df.select("h1", "h2"), ["h1", "h2"], "left_anti")
        with merging(again.sparkSession):
            self.repeats.append(Staged(again, "repeats"))
        self._put(0, Run(fresh, self.buckets, "run0"))
        mine.drop()
        return None

    def _put(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, Run(_union([r.df for r in old]), self.buckets, f"run{level + 1}"))
            for r in old:
                r.drop()

    def totals(self) -> DataFrame:
        """Rows (h1, h2, n, top) over all batches."""
        parts = [r.df for r in [*self.runs(), *self.repeats]]
        return _union(parts).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def drop(self) -> None:
        for r in [*self.runs(), *self.repeats]:
            r.drop()
        self.levels, self.repeats = [], []


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and with n_lines (before) and n_dropped.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines
    except in the largest doc_id that holds them.
    """
    keys = line_keys(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    keys = Staged(keys.distinct(), "line-keys")
    store = LineRuns(fanout, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for b in range(batches):
        store.add(keys.df.where(F.col("batch") == b).drop("batch"))
    common = stage(store.totals().where(F.col("n") >= min_docs).select("h1", "h2", "top"), "common-lines")
    store.drop()
    lost = keys.df.join(common, ["h1", "h2"]).where("doc_id < top")
    lost = stage(
        lost.groupBy(F.col("doc_id").alias("__tm_id")).agg(F.collect_list(F.struct("h1", "h2")).alias("__tm_lost")), "lost-lines"
    )
    keys.drop()

    rest = with_columns_last(docs, ADDED)
    joined = docs.select(*[F.col(c) for c in rest]).join(lost, F.col("doc_id") == F.col("__tm_id"), "left").drop("__tm_id")
    schema = docs.select(*rest).schema.add("n_lines", "long").add("n_dropped", "long")
    at = rest.index("text")

    def cut(parts):
        for batch in parts:
            lost_at = batch.column(len(rest))
            texts, before, gone = [], [], []
            for text, lost in zip(batch.column(at), lost_at):
                raw = text.as_py()
                lines = (raw or "").encode().split(b"\n")
                drop = {(x["h1"], x["h2"]) for x in lost.as_py() or ()}
                kept = [x for x in lines if line_key(x, min_chars) not in drop] if drop else lines
                texts.append(raw if len(kept) == len(lines) else b"\n".join(kept).decode())
                before.append(len(lines))
                gone.append(len(lines) - len(kept))
            columns = [batch.column(i) for i in range(len(rest))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(before, pa.int64()), pa.array(gone, pa.int64())], [*rest, "n_lines", "n_dropped"]
            )

    return joined.mapInArrow(cut, schema)
