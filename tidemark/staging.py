"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a query when it ends; a staged table needs none of them any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What is staged inside the innermost ``scratch()``, or nothing.
_owners: list[list[Staged]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves a plain local session (as in tests); any other master is
    refused, since its executors would not see the driver's disk.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark, "_tm_shared", None)
    if own is None:
        own = spark._tm_shared = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return own


class Staged:
    """A table written once to the shared folder; it cuts the lineage and survives lost executors."""

    def __init__(self, df: DataFrame, tag: str, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        self.gone = False
        with cleaned_shuffles(self.spark):
            df.write.parquet(self.path, partitionBy=partition_by)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        if _owners:
            _owners[-1].append(self)

    def drop(self) -> None:
        """Delete the files, once nothing that is still to run reads them."""
        if not self.gone:
            self.gone = True
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, tag: str) -> DataFrame:
    return Staged(df, tag).df


@contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Queries started inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def scratch():
    """Deletes at its end whatever was staged inside; the caller has written what it keeps elsewhere or ``keep`` s it.

    >>> with scratch() as keep:
    ...     result = keep(Staged(operator(docs), "result"))
    """
    mine: list[Staged] = []
    kept: list[Staged] = []

    def keep(table: Staged) -> Staged:
        kept.append(table)
        return table

    _owners.append(mine)
    try:
        yield keep
    finally:
        _owners.pop()
        for table in mine:
            if table not in kept:
                table.drop()
        if _owners:
            _owners[-1].extend(kept)
