"""Pages, their lines, and how they are put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions.geometry import bbox, clip_line, crop_size, frame
from scriptorium.runtime import parted, task_parts

#: Zone classes of the public layout vocabulary, in the order of their numbers.
LAYOUT = tuple(f"{x}Zone" for x in "Damage DigitizationArtefact DropCapital Graphic Main MarginText Music Numbering QuireMarks RunningTitle Seal Stamp Table TitlePage".split())


def page_text(lines: DataFrame, page: str, order: str, text_col: str = "text") -> DataFrame:
    """(page, lines, text): each page's lines in order, joined by line ends; null lines are left out."""
    rows = lines.filter(F.col(text_col).isNotNull())
    return rows.groupBy(page).agg(F.count("*").alias("lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text_col))), lambda r: r[text_col]), "\n").alias("text"))


def missing_segments(pages: DataFrame, segments: DataFrame, page: str) -> DataFrame:
    """Pages that have no segmentation."""
    return pages.join(segments.select(page), page, "left_anti")


def numbered_lines(segments: DataFrame) -> DataFrame:
    """(imagename, idx, id, baseline, boundary, text) of each line of a segmentation, numbered from 0."""
    rows = segments.select("imagename", F.posexplode("lines").alias("idx", "line"))
    return rows.select("imagename", "idx", "line.id", "line.baseline", "line.boundary", "line.text")


def page_lines(segments: DataFrame) -> DataFrame:
    """:func:`numbered_lines` without those that have no boundary; the others keep their number."""
    return numbered_lines(segments).filter("boundary is not null")


def line_crops(lines: DataFrame, kind: str = "polygon") -> DataFrame:
    """``lines`` with the crop of each boundary, and baseline and boundary relative to it."""
    crop = crop_size(F.col("box"), kind)
    rows = lines.withColumn("box", bbox(F.col("boundary"))).withColumn("crop", crop)
    return rows.withColumns({"local_baseline": clip_line(F.col("baseline"), F.col("box"), F.col("crop.w"), F.col("crop.h")), "local_boundary": frame(F.col("crop.w"), F.col("crop.h"))})


def _parts(rows: DataFrame, parts: int | None) -> int:
    return task_parts(rows.sparkSession, rows.count()) if parts is None else parts


def with_lines(inventory: DataFrame, segments: DataFrame, parts: int | None = None) -> DataFrame:
    """(folder, stem, idx, found, line fields): ``inventory`` (folder, stem) joined to its line by page and the number at the end of
    the stem; ``found`` is false for numbers beyond the page's lines. Here and below ``parts`` are the partitions of the join, by default
    as many as the counted rows need."""
    parts = _parts(inventory, parts)
    rows = inventory.withColumn("idx", T.line_index(F.col("stem")))
    lines = segments.select(F.col("imagename").alias("folder"), F.posexplode("lines").alias("idx", "line"))
    return parted(rows, parts, "folder", "idx").join(parted(lines, parts, "folder", "idx"), ["folder", "idx"], "left").select("folder", "stem", "idx", F.col("line").isNotNull().alias("found"), "line.id", "line.baseline", "line.boundary")


def with_images(inventory: DataFrame, images: DataFrame, parts: int | None = None) -> DataFrame:
    """``inventory`` (folder, stem, ...) with ``image_found``: whether ``images`` (folder, stem) has the line's image file."""
    parts = _parts(inventory, parts)
    have = parted(images.select("folder", "stem"), parts, "folder", "stem").distinct().withColumn("image_found", F.lit(True))
    return parted(inventory, parts, "folder", "stem").join(have, ["folder", "stem"], "left").withColumn("image_found", F.coalesce("image_found", F.lit(False)))


def with_masks(pages: DataFrame, masks: DataFrame, name: str = "name") -> DataFrame:
    """``pages`` (name, ...) with ``mask``: the path of the mask (stem, path) whose stem is the page's normalised name; null where there is none."""
    return pages.join(masks.select(F.col("stem").alias("_page"), F.col("path").alias("mask")), T.page_file_name(F.col(name)) == F.col("_page"), "left").drop("_page")


def transcribed(kept: DataFrame, texts: DataFrame, parts: int | None = None) -> DataFrame:
    """(folder, stem, idx, status, text) of inventory rows with found (its line) and image_found: failed where either is missing or the
    recogniser reported an error, empty where it gave no text, else ok. ``texts`` has (folder, stem, text, error)."""
    parts = _parts(kept, parts)
    rows = parted(kept, parts, "folder", "stem").join(parted(texts.select("folder", "stem", "text", "error"), parts, "folder", "stem"), ["folder", "stem"], "left")
    bad = ~F.col("found") | ~F.col("image_found") | F.col("error").isNotNull()
    return rows.select("folder", "stem", "idx", F.when(bad, "failed").when(F.col("text").isNull(), "empty").otherwise("ok").alias("status"), F.when(~bad, F.col("text")).alias("text"))


def plot_marks(lines: DataFrame, off: int = 20) -> DataFrame:
    """(imagename, idx, baseline, boundary, label_x, label_y): what a plot of a page's lines draws. Baselines of other than two points aren't
    drawn; the line's number stands ``off`` up and left of the baseline's start, within the page."""
    start = F.when(F.size("baseline") > 0, F.col("baseline")[0])
    return lines.select("imagename", "idx", F.when(F.size("baseline") == 2, F.col("baseline")).alias("baseline"), "boundary", *(F.greatest(F.lit(0), start[i].cast("int") - off).alias(c) for i, c in enumerate(("label_x", "label_y"))))


def join_by_file_name(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """Left join of two tables by the normalised form of their file names."""
    r = right.withColumn("_page", T.page_file_name(F.col(name))).drop(name)
    return left.withColumn("_page", T.page_file_name(F.col(name))).join(r, "_page", "left").drop("_page")


def layout_dimension(spark) -> DataFrame:
    """(index, tag, label) of the layout classes."""
    return spark.createDataFrame([(i, f"BT{i:03d}", x) for i, x in enumerate(LAYOUT)], "index int, tag string, label string")
