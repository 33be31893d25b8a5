"""What the operators of this subpackage share: ASCII lower-casing, and the library's staging and components.

Names that start with ``__tm_`` are ours; every operator adds and drops them itself, so tables may bring
any other column of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.components import components
from tidemark.staging import Staged, shared_dir, stage

__all__ = ["ALNUM_LOWER", "ASCII_LOWER", "Staged", "ascii_lower", "components", "set_aside", "shared_dir", "small_batches", "stage", "with_columns_last"]

#: Rows that go to Python in one batch have this many bytes, about; Spark's own bound is 10,000 rows, however long.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: bytes.translate tables. Both lower-case A-Z; the second also turns ASCII that is neither letter nor digit into blanks.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else (b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII takes the fast built-in, which agrees on it."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_columns_last(docs: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``docs`` that an operator passes through when it adds columns called ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() not in taken]


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its own columns called ``names`` out of an operator's way, and what gives its columns back."""
    taken, columns = {n.lower() for n in names}, docs.columns
    moved = {c: f"__tm_own_{i}" for i, c in enumerate(columns) if c.lower() in taken}
    return docs.withColumnsRenamed(moved), lambda out: out.select(*[F.col(moved.get(c, c)).alias(c) for c in columns])


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """From now on rows go to Python in batches of about ``most``, for the session: plans read this when they run.

    An executor holds a batch of each task twice, in Spark's buffers and in the worker, which keeps what its largest took.
    """
    spark.conf.set(BATCH_BYTES, most)
