"""Layout detection: greedy one-to-one matching of boxes by IoU, precision, recall and F1.

Boxes have columns (image, x1, y1, x2, y2), predictions also conf, and pos orders ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.geometry import iou, overlap, share

THRESHOLDS = (0.3, 0.5, 0.7)
BOX = ("x1", "y1", "x2", "y2")


def iou_pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(image, truth_pos, found_pos, iou) of all pairs of an image's boxes that overlap."""
    t = truth.select("image", F.col("pos").alias("truth_pos"), F.struct(*BOX).alias("t"))
    f = found.select("image", F.col("pos").alias("found_pos"), F.struct(*BOX).alias("f"))
    return t.join(f, "image").filter(overlap(F.col("t"), F.col("f")) > 0).select("image", "truth_pos", "found_pos", iou(F.col("t"), F.col("f")).alias("iou"))


def matched(truth: DataFrame, found: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, annotated: DataFrame | None = None) -> DataFrame:
    """(image, iou_threshold, tp, fp, fn) of the annotated images: those of ``annotated`` (image), which may have no true box at all, or
    those with a true box. Boxes of other images are left out, since nothing says what is true there. An image's predictions, surest first, each take the free true box with the highest IoU (the
    first on ties) if that reaches the threshold. Boxes meet per image, in one shuffle; the choice is a fold over sorted arrays."""
    t = truth.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("pos", *BOX))).alias("t"))
    f = found.groupBy("image").agg(F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("less"), "pos", *BOX))).alias("f"))
    if annotated is not None:
        t = annotated.select("image").distinct().join(t, "image", "left")
    both = t.join(f, "image", "left").select("image", F.coalesce("t", F.array().cast(t.schema["t"].dataType)).alias("t"), F.coalesce("f", F.array().cast(f.schema["f"].dataType)).alias("f"))
    near = F.transform("f", lambda p: F.sort_array(F.filter(F.transform("t", lambda g: F.struct((-iou(g, p)).alias("less"), g["pos"].alias("g"))), lambda z: z["less"] < 0)))
    rows = both.select("image", F.size("t").alias("n_t"), F.size("f").alias("n_f"), near.alias("near")).withColumn("iou_threshold", F.explode(F.array(*map(F.lit, thresholds))))

    def take(used: Column, cand: Column) -> Column:
        best = F.try_element_at(F.filter(cand, lambda z: ~F.array_contains(used, z["g"])), F.lit(1))
        return F.when(best["less"] <= -F.col("iou_threshold"), F.concat(used, F.array(best["g"]))).otherwise(used)

    used = F.aggregate("near", F.array().cast("array<bigint>"), take)
    tp = F.size(used).cast("long")
    return rows.select("image", "iou_threshold", tp.alias("tp"), (F.col("n_f") - tp).alias("fp"), (F.col("n_t") - tp).alias("fn"))


def detection_metrics(truth: DataFrame, found: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, annotated: DataFrame | None = None) -> DataFrame:
    """(iou_threshold, tp, fp, fn, precision, recall, f1), summed over all images before the ratios are taken."""
    s = matched(truth, found, thresholds, annotated).groupBy("iou_threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    out = s.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", share(2 * p * r, p + r))


def mask_summary(images: DataFrame, zones: DataFrame, kind: str) -> DataFrame:
    """One row: images, zones of the class drawn, images with and without such a zone."""
    z = zones.filter(F.col("class") == kind).groupBy("image").agg(F.count("*").alias("zones"))
    rows = images.select("image").distinct().join(z, "image", "left")
    return rows.agg(F.count("*").alias("images"), F.coalesce(F.sum("zones"), F.lit(0)).alias("zones"), F.count("zones").alias("images_with_zones"), F.count_if(F.col("zones").isNull()).alias("images_no_detections"))
