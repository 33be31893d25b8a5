"""Labelled image chips: split lists, box files and pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHIPS = "image string, rows int, cols int, pixels binary"


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(image): the stripped non-blank lines of a split list."""
    return spark.read.text(path).select(F.trim("value").alias("image")).where("image <> ''")


def read_boxes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Boxes (image, box_id, x0, y0, x1, y1) of Pascal-VOC files, and (rule, n) of what their objects lack.

    Boxes are numbered in file order. An object that is no ship is kept; one without a box or with corners that
    are no numbers is dropped.
    """
    schema = "name string, bndbox struct<xmin: string, ymin: string, xmax: string, ymax: string>"
    raw = spark.read.format("xml").option("rowTag", "object").schema(schema).load(path)
    image = F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^.]*$", 1)
    raw = raw.select(image.alias("image"), F.monotonically_increasing_id().alias("box_id"), F.lower(F.trim(F.coalesce("name", F.lit("")))).alias("label"), "bndbox")
    number = lambda c: F.expr(f"try_cast(trim(bndbox.{c}) as double)")
    rows = raw.withColumns({"x0": number("xmin"), "y0": number("ymin"), "x1": number("xmax"), "y1": number("ymax")})
    whole = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    found = F.filter(
        F.array(
            F.when(F.col("label") != "ship", F.lit("object not labelled 'ship' (kept)")),
            F.when(F.col("bndbox").isNull(), F.lit("object without a box (dropped)")),
            F.when(F.col("bndbox").isNotNull() & ~whole, F.lit("box with non-numeric corners (dropped)")),
        ),
        lambda r: r.isNotNull(),
    )
    audit = rows.select(F.explode(found).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    return rows.where(whole).select("image", "box_id", "x0", "y0", "x1", "y1"), audit


def read_chips(spark: SparkSession, path: str) -> DataFrame:
    """(image, rows, cols, pixels): chips as float32 grey in [0, 1], decoded by the JVM's image source."""
    raw = spark.read.format("image").load(path).select("image.*")

    def grey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(np.float32)
                if r.nChannels >= 3:  # stored blue first; the weights of ITU-R 601
                    pixels = np.rint(pixels[..., 2] * 0.299 + pixels[..., 1] * 0.587 + pixels[..., 0] * 0.114)
                else:
                    pixels = pixels[..., 0]
                out.append((r.origin.rsplit("/", 1)[-1].rsplit(".", 1)[0], r.height, r.width, (pixels / 255).astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["image", "rows", "cols", "pixels"])

    return raw.mapInPandas(grey, CHIPS)


def audit_chips(listed: DataFrame, chips: DataFrame, labelled: DataFrame, size: int = 800) -> DataFrame:
    """(image, rule) of listed images that are missing, of another size, mostly outside the swath, or without a label file."""
    rows = listed.join(chips.select("image", "rows", "cols", "pixels"), "image", "left")
    rows = rows.join(labelled.select("image").distinct().withColumn("__label", F.lit(True)), "image", "left")

    @F.pandas_udf("double")
    def dark(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda b: None if b is None else float((np.frombuffer(b, "<f4") == 0).mean()))

    found = F.array(
        F.when(F.col("rows").isNull(), F.lit("image missing (dropped)")),
        F.when((F.col("rows") != size) | (F.col("cols") != size), F.lit(f"image not {size} x {size} (dropped)")),
        F.when(dark("pixels") >= 0.5, F.lit("image mostly outside the swath (kept, no-data masked)")),
        F.when(F.col("__label").isNull(), F.lit("label file missing (kept as no ships)")),
    )
    return rows.select("image", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"))


def score_chips(chips: DataFrame, detector) -> DataFrame:
    """points (image, id, row, col, score) of a detector over chips, one Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                window = np.frombuffer(r.pixels, "<f4").reshape(r.rows, r.cols)
                out += [(r.image, i, *map(float, p)) for i, p in enumerate(detector.scored(window))]
            yield pd.DataFrame(out, columns=["image", "id", "row", "col", "score"])

    return chips.mapInPandas(run, "image string, id long, row double, col double, score double")
