"""Whole runs: from folders to reports. Each returns the frames that it wrote.

A missing input folder is an error that says so.
"""

from __future__ import annotations

import datetime
import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.geometry import fitted_size
from scriptorium.functions.imaging import binarized, crop_files, line_measures, mask_files, overlay_files
from scriptorium.functions.text import page_file_name
from scriptorium.operators import alignment, corpus, detection, lexicon, lines, models, pages, tokenizer
from scriptorium.runtime import Cut
from scriptorium.sources import readers, sinks


def run_name(now: datetime.datetime | None = None) -> str:
    return (now or datetime.datetime.now()).strftime("%Y%m%d_%H%M%S")


def code_version() -> str:
    """Short hash of the checked-out commit, or "unknown"."""
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def run_config(spark: SparkSession, **settings) -> DataFrame:
    """One row: when, which code, and the settings as JSON."""
    return spark.createDataFrame([(run_name(), code_version(), json.dumps(settings, sort_keys=True, default=str))], "run string, code string, settings string")


def lexicon_evaluation(spark: SparkSession, texts: str, dictionary: str, out: str, threshold: float = 82.0, min_length: int = 2) -> dict[str, DataFrame]:
    """Metrics, fuzzy candidates and unmatched words of a folder of transcriptions against a JSON lexicon."""
    freq = Cut(lexicon.token_frequency(readers.text_files(spark, texts), order_col="name"), "words")
    forms = lexicon.lexicon_forms(readers.lexicon_file(spark, dictionary))
    unknown = lexicon.unknown_words(lexicon.vocabulary(freq.df, min_length), forms)
    fuzzy = Cut(lexicon.fuzzy_candidates(unknown, forms, threshold), "fuzzy")
    got = {
        "metrics": lexicon.dictionary_metrics(freq.df, forms, threshold, min_length),
        "fuzzy_candidates": fuzzy.df.orderBy(F.desc("frequency"), "ocr_normalized"),
        "top_unmatched": lexicon.unmatched(unknown, fuzzy.df),
    }
    sinks.write_json(got["metrics"], f"{out}/metrics")
    sinks.write_csv(got["fuzzy_candidates"], f"{out}/fuzzy_candidates")
    sinks.write_csv(got["top_unmatched"], f"{out}/top_unmatched")
    sinks.write_json(run_config(spark, texts=texts, dictionary=dictionary, threshold=threshold, min_length=min_length), f"{out}/config")
    return got


def unify_corpus(spark: SparkSession, texts: str, out: str, recursive: bool = False) -> dict[str, DataFrame]:
    """One cleaned corpus of a folder's texts, with its summary and characters."""
    cleaned = corpus.clean_corpus(readers.text_files(spark, texts, recursive))
    sinks.write_corpus(cleaned, f"{out}/corpus", "name")
    got = {"texts": cleaned, "summary": corpus.corpus_summary(cleaned), "characters": corpus.char_inventory(cleaned)}
    sinks.write_json(got["summary"], f"{out}/summary")
    sinks.write_inventory(got["characters"], f"{out}/characters")
    return got


def noisy_line_filter(spark: SparkSession, images: str, out: str, density: tuple[float, ...] = lines.DENSITY, size: tuple[float, ...] = lines.SIZE) -> dict[str, DataFrame]:
    """Measures a folder tree of line images and writes which of them to keep, with the funnel."""
    measures = Cut(line_measures(readers.gray_images(spark, images)), "measures").df
    tracking = lines.filter_tracking(measures, density, size)
    got = {"tracking": tracking, "funnel": lines.filter_funnel(measures, density, size), "density": lines.describe(measures, "density", density), "size": lines.describe(measures, "size", size)}
    sinks.write_tracking(tracking, f"{out}/filter_tracking")
    sinks.write_kept_and_removed(tracking, f"{out}/lines")
    sinks.write_csv(got["funnel"], f"{out}/funnel")
    return got


def binarization(spark: SparkSession, images: str, out: str, method: str = "otsu_gaussian") -> dict[str, DataFrame]:
    """Black-and-white images and a summary of thresholds per folder."""
    done = Cut(binarized(readers.gray_images(spark, images), method), "binary").df
    done.write.mode("overwrite").parquet(f"{out}/images")
    got = {"images": done, "summary": lines.threshold_summary(done)}
    sinks.write_csv(got["summary"], f"{out}/thresholds")
    return got


def detection_evaluation(spark: SparkSession, page_xml: str, found: DataFrame, out: str, kind: str = "MainZone", least: float = 0.25, thresholds: tuple[float, ...] = detection.THRESHOLDS) -> dict[str, DataFrame]:
    """Detections (image, class, x1, y1, x2, y2, conf, pos) of one class against all blocks of the page XML files, in document order.
    Images without a page XML file are left out."""
    blocks = readers.page_blocks(spark, page_xml)
    truth = blocks.select(F.col("stem").alias("image"), "x1", "y1", "x2", "y2", "pos")
    annotated = readers.annotated_pages(spark, page_xml)
    sure = found.filter((F.col("class") == kind) & (F.col("conf") >= least))
    got = {"metrics": detection.detection_metrics(truth, sure, thresholds, annotated), "masks": detection.mask_summary(annotated, found, kind)}
    sinks.write_json(got["metrics"], f"{out}/metrics")
    return got


def page_crops(spark: SparkSession, segments: str, out: str, kind: str = "polygon") -> DataFrame:
    """Crop, baseline and boundary of every line of a folder of segmentations."""
    crops = pages.line_crops(pages.page_lines(readers.segmentations(spark, segments)), kind)
    crops.write.mode("overwrite").parquet(out)
    return crops


def zone_masks(spark: SparkSession, pages_: DataFrame, zones: DataFrame, out: str, kind: str = "MainZone") -> dict[str, DataFrame]:
    """A PNG mask for every page (image, height, width) from the zones of a layout model, and the summary."""
    named = pages_.withColumn("image", page_file_name(F.col("image")))
    drawn = mask_files(named, zones.withColumn("image", page_file_name(F.col("image"))), kind)
    sinks.write_files(drawn.select(F.concat("stem", F.lit(".png")).alias("name"), "content"), f"{out}/masks")
    got = {"summary": detection.mask_summary(pages_, zones, kind)}
    sinks.write_json(got["summary"], f"{out}/summary")
    return got


def page_segmentation(spark: SparkSession, images: DataFrame, masks: DataFrame, load, sizes: DataFrame, out: str) -> dict[str, DataFrame]:
    """Runs a segmenter (see :func:`models.apply_model`) over images (name, path) with their masks (stem, path): its JSON per page, the same
    as page XML where the page's size (imagename, width, height) is known, and counters."""
    rows = pages.with_masks(images, masks).withColumn("page", page_file_name(F.col("name")))
    done = Cut(models.apply_model(rows, load, ["path", "mask"], "json", keep=["name", "page"]), "segmented").df
    fine = done.filter("error is null")
    sinks.write_files(fine.select(F.concat("page", F.lit(".json")).alias("name"), F.col("json").alias("content")), out)
    segments = fine.select(F.col("page").alias("imagename"), F.from_json("json", readers.SEGMENTS)["lines"].alias("lines"))
    sinks.write_files(sinks.line_page_xml(segments, sizes), f"{out}/alto_format")
    got = {"pages": done, "counters": models.counters(done)}
    sinks.write_json(got["counters"], f"{out}/counters")
    return got


def transcription(spark: SparkSession, inventory: DataFrame, segments: DataFrame, images: DataFrame, load, out: str) -> dict[str, DataFrame]:
    """Recognises the kept lines of an inventory (folder, stem, was_removed) by a model over (path, baseline, boundary), see
    :func:`models.apply_model`. Folders without a segmentation are skipped; a line without image or number in its page fails. Writes a
    file for each line and page, and the counters."""
    kept = lines.kept_lines(inventory).select("folder", "stem")
    known = kept.join(segments.select(F.col("imagename").alias("folder")).distinct(), "folder", "left_semi")
    rows = Cut(pages.with_images(pages.with_lines(known, segments), images), "inventory").df
    ready = rows.filter("found and image_found").join(images.select("folder", "stem", "path"), ["folder", "stem"])
    texts = models.apply_model(ready, load, ["path", "baseline", "boundary"], "text", keep=["folder", "stem"])
    done = Cut(pages.transcribed(rows, texts), "transcribed").df
    sinks.write_line_and_page_texts(done.filter("status <> 'failed'"), f"{out}/texts")
    got = {"lines": done, "counters": lines.run_counters(done), "skipped": pages.missing_segments(kept.select("folder").distinct(), segments.select(F.col("imagename").alias("folder")), "folder")}
    sinks.write_json(got["counters"], f"{out}/counters")
    return got


def plot_bounds(spark: SparkSession, images: DataFrame, segments: DataFrame, out: str) -> int:
    """A PNG for each page (folder, stem, height, width, pixels) with its lines drawn on; how many."""
    marks = pages.plot_marks(pages.numbered_lines(segments))
    return sinks.write_files(overlay_files(images, marks).select(F.concat("stem", F.lit(".png")).alias("name"), "content"), out)


def line_crops_as_files(spark: SparkSession, images: DataFrame, segments: DataFrame, out: str, kind: str = "polygon") -> int:
    """A PNG for each line with a boundary: page folder / page_line_number; how many."""
    made = crop_files(images, pages.page_lines(segments), kind)
    return sinks.write_files(made.select(F.concat_ws("/", "folder", F.concat("stem", F.lit(".png"))).alias("name"), "content"), out)


def export_tokenizer(spark: SparkSession, files: DataFrame, name: str, merges: int, out: str, specials: tuple[str, ...] = ("[PAD]", "[UNK]", "[CLS]", "[EOS]")) -> None:
    """The first ``merges`` merges of a tokenizer file as a tokenizer file of their own, with specials and end-of-text template, and its special
    tokens' map. A tokenizer's merges are few; they are collected."""
    some = [(r.left, r.right) for r in tokenizer.merge_table(files.filter(F.col("name") == name)).filter(F.col("rank") < merges).orderBy("rank").collect()]
    letters = sorted(r.token for r in tokenizer.vocabulary_table(files.filter(F.col("name") == name)).filter(F.length("token") == 1).collect())
    whole = sinks.tokenizer_json([*letters, *(a + b for a, b in some)], some, specials)
    names = {k: v for k, v in (("pad_token", "[PAD]"), ("unk_token", "[UNK]"), ("cls_token", "[CLS]"), ("sep_token", "[SEP]"), ("eos_token", "[EOS]")) if v in specials}
    made = [("tokenizer.json", whole), ("special_tokens_map.json", json.dumps(names)), ("tokenizer_config.json", json.dumps({"tokenizer_class": "PreTrainedTokenizerFast", **names}))]
    sinks.write_files(spark.createDataFrame(made, "name string, content string"), out)


def resize_manifest(images: DataFrame, out: str, target: int = 224) -> DataFrame:
    """(folder, stem, original, final) of images (folder, stem, height, width)."""
    rows = images.select("folder", "stem", F.struct("width", "height").alias("original"), fitted_size(F.col("width"), F.col("height"), target).alias("final"))
    rows.write.mode("overwrite").parquet(out)
    return rows


def text_alignment(spark: SparkSession, texts: str, reference: str, out: str, corrected: bool = False) -> DataFrame:
    """Aligns a folder of page texts, in natural order of their names, with one reference text."""
    from scriptorium.functions.text import natural_key

    p = readers.text_files(spark, texts).select(F.lit("edition").alias("edition"), natural_key(F.col("name")).alias("page"), "text")
    r = spark.read.text(reference, wholetext=True).select(F.lit("edition").alias("edition"), F.col("value").alias("text"))
    rows = Cut(alignment.side_by_side(alignment.align_pages(p, r, "edition", "page", corrected=corrected)), "aligned").df
    rows.write.mode("overwrite").parquet(out)
    return rows
