"""Filtering line images by percentile bounds of ink density and size.

Measures have columns (folder, stem, density, size, height, width).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.runtime import Cut

DENSITY, SIZE = (0.001, 0.997), (0.03,)
REASONS = ("clean", "density_high", "density_low", "long_img", "size_high", "size_low")


def exact_percentiles(rows: DataFrame, wanted: dict[str, tuple[float, ...]], bins: int = 4096, few: int = 50_000) -> dict[str, list[float | None]]:
    """Linearly interpolated percentiles of each column's values that aren't null or NaN, None where there are none.

    All columns share each pass. A histogram of equal bins says which bins hold the ranks in question, and their least and greatest
    values bound the next histogram, until no such bin holds more than ``few`` values or more than one distinct value; those few are then
    counted. So an outlier that squeezes all others into one bin costs one more pass, and neither a task nor the driver ever holds more
    than the bins and ``few`` values a rank. ``rows`` is read three times or more: give a written table.
    """
    cols = list(wanted)
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)))).alias("e")).select("e.c", "e.x").filter("x is not null and not isnan(x)")
    ends = {r.c: r for r in each.groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    ranks = {(i, k): (0, ends[i].n, ends[i].low, ends[i].high) for i, c in enumerate(cols) if i in ends for p in wanted[c] for k in (int(p * (ends[i].n - 1)), min(int(p * (ends[i].n - 1)) + 1, ends[i].n - 1))}

    def spans(held: dict) -> tuple[dict, DataFrame]:
        """The distinct spans of ranks by number, and the rows in them."""
        found = {s: j for j, s in enumerate(dict.fromkeys((i, *v) for (i, _), v in held.items()))}
        at = F.lit(None).cast("int")
        for (i, _, _, low, high), j in found.items():
            at = F.when((F.col("c") == i) & F.col("x").between(low, high), j).otherwise(at)
        return found, each.withColumn("span", at).filter("span is not null")

    while wide := {r: v for r, v in ranks.items() if v[1] > few and v[2] < v[3]}:
        found, inside = spans(wide)
        low, step = F.lit(None).cast("double"), F.lit(None).cast("double")
        for (_, _, _, lo, hi), j in found.items():
            low, step = F.when(F.col("span") == j, lo).otherwise(low), F.when(F.col("span") == j, hi / bins - lo / bins).otherwise(step)
        at = F.least(F.floor((F.col("x") - low) / F.greatest(step, F.lit(5e-324))), F.lit(bins - 1))
        got = inside.groupBy("span", at.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("span", "bin").collect()
        upto: dict[int, list] = {}
        for r in got:
            before = upto[r.span][-1] if upto.get(r.span) else None
            upto.setdefault(r.span, []).append((before[0] + before[1] if before else 0, r.n, r.low, r.high))
        for (i, k), v in wide.items():
            start, n, lo, hi = next(b for b in upto[found[i, *v]] if b[0] <= k - v[0] < b[0] + b[1])
            ranks[i, k] = (v[0] + start, n, lo, hi)
    value = {r: v[2] for r, v in ranks.items() if v[2] == v[3]}
    if left := {r: v for r, v in ranks.items() if r not in value}:
        found, inside = spans(left)
        seen: dict[int, list] = {}
        for r in inside.groupBy("span", "x").agg(F.count("*").alias("n")).orderBy("span", "x").collect():
            before = seen[r.span][-1][0] if seen.get(r.span) else 0
            seen.setdefault(r.span, []).append((before + r.n, r.x))
        for (i, k), v in left.items():
            value[i, k] = next(x for upto_, x in seen[found[i, *v]] if k - v[0] < upto_)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        n = ends[i].n if i in ends else 0
        out[c] = [None if not n else value[i, lo] + (value[i, min(lo + 1, n - 1)] - value[i, lo]) * (r - lo) for r, lo in ((p * (n - 1), int(p * (n - 1))) for p in wanted[c])]
    return out


def describe(measures: DataFrame, col: str, percentiles: tuple[float, ...]) -> DataFrame:
    """One row: count, mean, sample deviation, min, interpolated percentiles (the median always), max."""
    cuts = tuple(sorted({*percentiles, 0.5}))
    x, held = F.col(col), Cut(measures.select(col), "measure")
    named = [F.lit(v).cast("double").alias(f"p{format(c * 100, '.10g').replace('.', '_')}") for c, v in zip(cuts, exact_percentiles(held.df, {col: cuts})[col], strict=True)]
    out = held.df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select("count", "mean", "std", "min", *named, "max")


def outlier_flags(measures: DataFrame, density: tuple[float, ...] = DENSITY, size: tuple[float, ...] = SIZE) -> DataFrame:
    """``measures`` with a flag for each reason. The first threshold is a lower bound, the second an upper one; both are inclusive.
    The measures are written first, so that what they are made from is read once."""
    if len(density) > 2 or len(size) > 2:
        raise ValueError("at most a lower and an upper threshold")
    measures = Cut(measures, "measures").df
    bounds = exact_percentiles(measures, {"density": density, "size": size})

    def flag(c: str, i: int) -> Column:
        edge = bounds[c][i] if len(bounds[c]) > i else None
        if edge is None:
            return F.lit(False)
        return F.coalesce((F.col(c) <= edge) if i == 0 else (F.col(c) >= edge), F.lit(False))

    flags = {"density_low": flag("density", 0), "density_high": flag("density", 1), "size_low": flag("size", 0), "size_high": flag("size", 1), "long_img": F.coalesce(F.col("height") > F.col("width"), F.lit(False))}
    return measures.withColumns(flags).withColumn("clean", ~F.col("long_img"))


def removed(density_low="density_low", density_high="density_high", size_low="size_low", size_high="size_high", long_img="long_img") -> Column:
    """Long images go, and those that are outliers in density and in size."""
    return F.col(long_img) | ((F.col(density_low) | F.col(density_high)) & (F.col(size_low) | F.col(size_high)))


def filter_tracking(measures: DataFrame, density: tuple[float, ...] = DENSITY, size: tuple[float, ...] = SIZE) -> DataFrame:
    """(folder, stem, density, size, height, width, reasons, was_removed) of every image."""
    flags = outlier_flags(measures, density, size)
    reasons = F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r in REASONS)))
    return flags.select("folder", "stem", "density", "size", "height", "width", reasons.alias("reasons"), removed().alias("was_removed"))


def filter_funnel(measures: DataFrame, density: tuple[float, ...] = DENSITY, size: tuple[float, ...] = SIZE) -> DataFrame:
    """(step, images, bar): sizes of the three sets, their intersections, and what is removed and kept."""
    f = outlier_flags(measures, density, size).select((F.col("density_low") | F.col("density_high")).alias("d"), (F.col("size_low") | F.col("size_high")).alias("s"), F.col("long_img").alias("l"))
    d, s, n = F.col("d"), F.col("s"), F.col("l")
    gone = n | (d & s)
    steps = {"total": F.lit(True), "density": d, "size": s, "long": n, "density_size": d & s, "density_long": d & n, "size_long": s & n, "all_three": d & s & n, "removed": gone, "kept": ~gone}
    one = f.agg(*(F.count_if(c).alias(k) for k, c in steps.items()))
    rows = one.select("total", F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(k).alias("images")) for k in steps))).alias("r"))
    return rows.select("r.step", "r.images", F.expr("repeat('█', int(40 * r.images / greatest(total, 1)))").alias("bar"))


def kept_lines(tracking: DataFrame) -> DataFrame:
    return tracking.filter(~F.col("was_removed"))


def folder_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("folder").agg(F.count("*").alias("lines"))


def threshold_summary(measures: DataFrame, col: str = "threshold") -> DataFrame:
    """(folder, min, max, avg) of a value, to two places."""
    return measures.groupBy("folder").agg(F.round(F.min(col), 2).alias("min"), F.round(F.max(col), 2).alias("max"), F.round(F.avg(col), 2).alias("avg"))


def run_counters(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: total, processed, failed, empty and the share processed in percent."""
    s, n = F.col(status), F.count("*")
    return rows.agg(n.alias("total"), F.count_if(s == "ok").alias("processed"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "empty").alias("empty"), F.when(n > 0, 100.0 * F.count_if(s == "ok") / n).otherwise(F.lit(0.0)).alias("rate"))


def channel_statistics(images: DataFrame, col: str = "pixels", weight: str | None = None) -> DataFrame:
    """Mean and population deviation over all pixels, as shares of 255. ``col`` holds one value a row, counted ``weight`` times."""
    w = F.col(weight) if weight else F.lit(1.0)
    x = F.col(col) / 255.0
    s = images.agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"))
    mean = F.col("sx") / F.col("n")
    both = images.crossJoin(F.broadcast(s.select(mean.alias("mean"), F.col("n").alias("total"))))
    return both.groupBy("mean", "total").agg(F.sqrt(F.sum(w * (x - F.col("mean")) * (x - F.col("mean"))) / F.first("total")).alias("std")).select("mean", "std")
