"""Pixel tables (capture_id, x, y, luma or r, g, b) and row tables (capture_id, y, row array)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from capturelake.functions.colour import srgb_to_linear
from capturelake.functions.geometry import apply_homography

KEY = "capture_id"
BINS = 256
TRIM = 0.1
DARK_END, BRIGHT_END = 0.5 / 255, 254.5 / 255


def luma(r: Column, g: Column, b: Column) -> Column:
    """Brightness of encoded 8-bit values, 0..1."""
    return (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255


def downscale(pixels: DataFrame, most: int, values: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Block means of 8-bit ``values`` by a whole factor that brings the longer side to ``most``, as 8-bit levels (halves to the
    even one); rows and columns beyond whole blocks go. One aggregation by capture and block, combined before the shuffle."""
    size = pixels.groupBy(KEY).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    size = size.withColumn("f", F.greatest(F.lit(1), F.ceil(F.greatest("w", "h") / most)).cast("int"))
    rows = pixels.join(size, KEY).filter((F.col("x") < F.floor(F.col("w") / F.col("f")) * F.col("f")) & (F.col("y") < F.floor(F.col("h") / F.col("f")) * F.col("f")))
    block = [F.floor(F.col(c) / F.col("f")).cast("int").alias(c) for c in "xy"]
    return rows.groupBy(KEY, *block).agg(*(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.avg(v)))).cast("int").alias(v) for v in values))


def otsu(pixels: DataFrame) -> DataFrame:
    """(capture_id, threshold): midpoint of the class means at the first best split of a 256-bin histogram, over 255; 0.5
    where no split parts anything."""
    level = F.least(F.lit(BINS - 1), F.floor(F.col("luma") * 255 + 0.5)).cast("int")
    bins = pixels.groupBy(KEY, level.alias("bin")).agg(F.count("*").alias("n"))
    upto, all_ = W.partitionBy(KEY).orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(KEY)
    rows = bins.select(
        KEY, "bin", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("s0"), F.sum("n").over(all_).alias("w"),
        F.sum(F.col("n") * F.col("bin")).over(all_).alias("s"),
    ).withColumn("w1", F.col("w") - F.col("w0"))
    parts = rows.filter("w1 > 0").select(KEY, "bin", "w0", "w1", (F.col("s0") / F.col("w0")).alias("m0"), ((F.col("s") - F.col("s0")) / F.col("w1")).alias("m1"))
    score = F.col("w0") * F.col("w1") * F.pow(F.col("m0") - F.col("m1"), F.lit(2))
    best = parts.withColumn("score", score).groupBy(KEY).agg(F.max_by(F.struct("m0", "m1"), F.struct("score", (-F.col("bin")).alias("b"))).alias("p"))
    found = best.select(KEY, ((F.col("p.m0") + F.col("p.m1")) / 2 / 255).alias("threshold"))
    return pixels.select(KEY).distinct().join(found, KEY, "left").select(KEY, F.coalesce("threshold", F.lit(0.5)).alias("threshold"))


def focus_score(rows: DataFrame) -> DataFrame:
    """(capture_id, focus_score): population variance of the 4-neighbour Laplacian over inner pixels, times 1e4; 0 for frames
    under 3 x 3. Works on image rows, not single pixels."""
    order = W.partitionBy(KEY).orderBy("y")
    near = rows.select(KEY, "row", F.lag("row").over(order).alias("up"), F.lead("row").over(order).alias("down")).filter("up is not null and down is not null")
    inner = F.sequence(F.lit(1), F.size("row") - 2)
    value = F.transform(inner, lambda i: 4 * F.get("row", i) - F.get("row", i - 1) - F.get("row", i + 1) - F.get("up", i) - F.get("down", i))
    cells = near.filter(F.size("row") > 2).select(KEY, F.explode(value).alias("v"))
    found = cells.groupBy(KEY).agg((F.var_pop("v") * 1e4).alias("focus_score"))
    return rows.select(KEY).distinct().join(found, KEY, "left").select(KEY, F.coalesce("focus_score", F.lit(0.0)).alias("focus_score"))


def bilinear_probe(points: DataFrame, pixels: DataFrame, *values: str) -> DataFrame:
    """``points`` (capture_id, point_id, px, py) with ``values`` (luma, if none are named) blended from four pixels; null outside
    the frame or for NaN. One equality join on the pixel, whatever the number of values."""
    values = values or ("luma",)
    low = points.withColumns({"x0": F.floor("px").cast("int"), "y0": F.floor("py").cast("int")}).withColumns({"fx": F.col("px") - F.col("x0"), "fy": F.col("py") - F.col("y0")})
    finite = low.filter(~F.isnan("px") & ~F.isnan("py"))
    taps = [(0, 0, (1 - F.col("fx")) * (1 - F.col("fy"))), (1, 0, F.col("fx") * (1 - F.col("fy"))), (0, 1, (1 - F.col("fx")) * F.col("fy")), (1, 1, F.col("fx") * F.col("fy"))]
    tap = F.explode(F.array(*(F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"), w.alias("w")) for dx, dy, w in taps)))
    cells = finite.select(KEY, "point_id", tap.alias("t")).select(KEY, "point_id", "t.x", "t.y", "t.w").filter("w > 0")
    joined = cells.join(pixels.select(KEY, "x", "y", *(F.col(v).alias(f"pv_{v}") for v in values)), [KEY, "x", "y"], "left")
    mixed = joined.groupBy(KEY, "point_id").agg(*(F.when(F.count(f"pv_{v}") == F.count("*"), F.sum(F.col("w") * F.col(f"pv_{v}"))).alias(v) for v in values))
    return points.join(mixed, [KEY, "point_id"], "left")


def trimmed_mean(values: DataFrame, keys: list[str], value: str, fraction: float = TRIM) -> DataFrame:
    """(keys, mean, raw_mean, deviation, n): mean without the lowest and highest share; the plain mean if nothing is left. The
    deviation is of the population, before trimming, 0 under two values."""
    sorted_ = F.array_sort(F.collect_list(value))
    groups = values.groupBy(*keys).agg(sorted_.alias("v"), F.avg(value).alias("raw_mean"), F.stddev_pop(value).alias("deviation"), F.count(value).alias("n"))
    drop = F.floor(F.col("n") * fraction).cast("int")
    left = F.when(F.col("n") > 2 * drop, F.slice("v", drop + 1, (F.col("n") - 2 * drop).cast("int"))).otherwise(F.col("v"))
    mean = F.aggregate(left, F.lit(0.0), lambda s, x: s + x) / F.size(left)
    return groups.select(*keys, F.when(F.col("n") > 0, mean).otherwise(0.0).alias("mean"), "raw_mean", F.coalesce("deviation", F.lit(0.0)).alias("deviation"), "n")


def grid_points(rects: DataFrame, nx: int, ny: int) -> DataFrame:
    """Cell centres of an nx x ny grid over each rectangle (region_id, x, y, width, height): (region_id, point_id, mx, my)."""
    cells = rects.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))))
    i, j = F.col("cell") % nx, F.floor(F.col("cell") / nx)
    return cells.select("region_id", "cell", (F.col("x") + (i + 0.5) / nx * F.col("width")).alias("mx"), (F.col("y") + (j + 0.5) / ny * F.col("height")).alias("my"))


def sample_regions(homographies: DataFrame, rects: DataFrame, pixels: DataFrame, nx: int = 24, ny: int = 16, trim: float = TRIM) -> DataFrame:
    """Each region of each capture read on a grid in card millimetres: trimmed mean, raw mean and deviation of linear light,
    clipped and out-of-frame shares, count. ``pixels`` have r, g, b (0..1); the region table is small and broadcast."""
    points = homographies.crossJoin(F.broadcast(grid_points(rects, nx, ny)))
    x, y = apply_homography(F.col("h"), F.col("mx"), F.col("my"))
    points = points.select(KEY, "region_id", F.concat_ws(":", "region_id", "cell").alias("point_id"), x.alias("px"), y.alias("py"))
    probed = bilinear_probe(points.select(KEY, "point_id", "px", "py"), pixels, "r", "g", "b")
    read = points.join(probed.select(KEY, "point_id", *"rgb"), [KEY, "point_id"], "left")
    clipped = F.greatest(*(F.when((F.col(c) <= DARK_END) | (F.col(c) >= BRIGHT_END), 1).otherwise(0) for c in "rgb"))
    counts = read.groupBy(KEY, "region_id").agg(
        F.count("r").alias("count"), (1 - F.count("r") / F.count("*")).alias("out_fraction"),
        F.coalesce(F.avg(F.when(F.col("r").isNotNull(), clipped)), F.lit(0.0)).alias("clipped_fraction"),
    )
    long = read.filter("r is not null").select(KEY, "region_id", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), srgb_to_linear(F.col(c)).alias("v")) for c in "rgb"))).alias("s"))
    means = trimmed_mean(long.select(KEY, "region_id", "s.channel", "s.v"), [KEY, "region_id", "channel"], "v", trim)
    wide = means.groupBy(KEY, "region_id").agg(*(F.max(F.when(F.col("channel") == c, F.col(m))).alias(f"{name}{c}") for c in "rgb" for m, name in (("mean", ""), ("raw_mean", "raw_"), ("deviation", "std_"))))
    names = [f"{n}{c}" for n in ("", "raw_", "std_") for c in "rgb"]
    return counts.join(wide, [KEY, "region_id"], "left").select(KEY, "region_id", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names), "clipped_fraction", "out_fraction", "count")


def rectify(homographies: DataFrame, pixels: DataFrame, width: int, height: int, card_width: float, card_height: float) -> DataFrame:
    """(capture_id, x, y, luma): the card seen from the front, read by the inverse map; 0 outside the frame."""
    size = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))
    cells = homographies.withColumn("cell", size).withColumns({"x": (F.col("cell") % width).cast("int"), "y": F.floor(F.col("cell") / width).cast("int")})
    px, py = apply_homography(F.col("h"), (F.col("x") + 0.5) / width * card_width, (F.col("y") + 0.5) / height * card_height)
    points = cells.select(KEY, F.col("cell").alias("point_id"), "x", "y", px.alias("px"), py.alias("py"))
    return bilinear_probe(points, pixels).select(KEY, "x", "y", F.coalesce("luma", F.lit(0.0)).alias("luma"))


def region_mean_luma(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """(capture_id, region_id, mean_luma) over the probes inside the frame; null if there are none."""
    return bilinear_probe(points, pixels).groupBy(KEY, "region_id").agg(F.avg("luma").alias("mean_luma"))
