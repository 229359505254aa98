"""The reference card: its patches, sampling rectangles and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions.colour import hex_to_lab

#: Card geometry in millimetres, and the twelve patches by row and slot.
WIDTH, HEIGHT = 88.9, 54.0
MARGIN, GAP, PATCH_HEIGHT = 2.5, 1.5, 7.5
PATCH_WIDTH = (WIDTH - 2 * MARGIN - 5 * GAP) / 6
ROW_Y = {"A": 11.5, "B": 34.0}
MARKERS = ((6.5, 6.5), (82.4, 6.5), (82.4, 47.5), (6.5, 47.5))
PATCH_INSET = 0.25
#: The window for the sample (x, y, width, height), the share of it that is left out on every side, and its middle on the card.
WINDOW, WINDOW_INSET = (14.0, 21.0, 60.9, 11.0), 0.2
SAMPLE_U, SAMPLE_V = (WINDOW[0] + WINDOW[2] / 2) / WIDTH, (WINDOW[1] + WINDOW[3] / 2) / HEIGHT
SLOTS = {
    "A": (("neutral-112", "#707070"), ("chroma-red", "#b5473c"), ("neutral-216", "#d8d8d8"), ("chroma-green", "#4f8f52"), ("neutral-81", "#515151"), ("chroma-blue", "#3f5f9e")),
    "B": (("chroma-orange", "#cf8b3f"), ("neutral-145", "#919191"), ("chroma-cyan", "#3f8f9e"), ("neutral-50", "#323232"), ("chroma-purple", "#7b4f8f"), ("neutral-180", "#b4b4b4")),
}
RAMP = (216, 180, 145, 112, 81, 50)
PROVENANCE = {"measured": "Instrument-measured", "self-measured": "Self-measured (camera)", "nominal": "Nominal (print targets)"}
ALL_PATCHES = 12


def _linear(colour: str) -> tuple[float, float, float]:
    levels = [int(colour[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    return tuple(c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in levels)


def patch_rows() -> list[tuple]:
    rows = []
    for n, (row, at, patch, colour) in enumerate((r, i, *s) for r, slots in SLOTS.items() for i, s in enumerate(slots)):
        x, y = MARGIN + at * (PATCH_WIDTH + GAP), ROW_Y[row]
        kind, _, level = patch.partition("-")
        role = "neutral" if kind == "neutral" else "chromatic"
        ramp = RAMP.index(int(level)) if role == "neutral" else None
        centre = ((x + PATCH_WIDTH / 2) / WIDTH, (y + PATCH_HEIGHT / 2) / HEIGHT)
        rows.append((patch, role, row, n, ramp, x, y, PATCH_WIDTH, PATCH_HEIGHT, *centre, colour, *hex_to_lab(colour), *_linear(colour)))
    return rows


def card_patches(spark: SparkSession) -> DataFrame:
    """The twelve patches: place, role, position in the grey ramp, nominal colour (hex, Lab and linear light)."""
    schema = (
        "patch_id string, role string, row string, slot int, ramp_pos int, x double, y double, width double, height double, "
        "u double, v double, nominal_hex string, L double, a double, b double, ref_r double, ref_g double, ref_b double"
    )
    return spark.createDataFrame(patch_rows(), schema)


def _inner(x: float, y: float, width: float, height: float, inset: float) -> tuple[float, ...]:
    return x + width * inset, y + height * inset, width * (1 - 2 * inset), height * (1 - 2 * inset)


def sample_rows(inset: float = PATCH_INSET) -> list[tuple]:
    """(patch_id, x, y, width, height) of the inner part of each patch that is read."""
    return [(p[0], *_inner(*p[5:9], inset)) for p in patch_rows()]


def window_row(inset: float = WINDOW_INSET) -> tuple:
    """The same of the sample's window."""
    return "sample", *_inner(*WINDOW, inset)


def sample_rects(patches: DataFrame, inset: float = PATCH_INSET) -> DataFrame:
    """(patch_id, x, y, width, height): the inner part of each patch that is read."""
    return patches.select(
        "patch_id", (F.col("x") + F.col("width") * inset).alias("x"), (F.col("y") + F.col("height") * inset).alias("y"),
        (F.col("width") * (1 - 2 * inset)).alias("width"), (F.col("height") * (1 - 2 * inset)).alias("height"),
    )


def reference_lab(patches: DataFrame, cards: DataFrame, measured: DataFrame) -> DataFrame:
    """(card_serial, patch_id, L, a, b, is_measured): a card's own value of a patch, else the nominal one."""
    own = measured.select("card_serial", "patch_id", *(F.col(c).alias(f"own_{c}") for c in "Lab"))
    rows = cards.select("card_serial").distinct().crossJoin(F.broadcast(patches.select("patch_id", "L", "a", "b")))
    return rows.join(own, ["card_serial", "patch_id"], "left").select(
        "card_serial", "patch_id", *(F.coalesce(f"own_{c}", c).alias(c) for c in "Lab"), F.col("own_L").isNotNull().alias("is_measured")
    )


def calibration_status(calibrations: DataFrame, measured: DataFrame, patches: DataFrame) -> DataFrame:
    """(card_serial, provenance, patches, is_fully_measured, has_per_patch_references) of every card."""
    known = measured.join(F.broadcast(patches.select("patch_id")), "patch_id", "left_semi")
    counts = known.groupBy("card_serial").agg(F.countDistinct("patch_id").alias("patches"))
    rows = calibrations.join(counts, "card_serial", "left").withColumn("patches", F.coalesce("patches", F.lit(0)))
    whole = F.col("patches") == ALL_PATCHES
    return rows.select(
        "card_serial", "provenance", "patches", (whole & (F.col("provenance") == "measured")).alias("is_fully_measured"),
        (whole & (F.col("provenance") != "nominal")).alias("has_per_patch_references"),
    )


def describe_provenance(provenance: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in PROVENANCE.items():
        out = F.when(provenance == name, text).otherwise(out)
    return out


def calibration_worksheet(patches: DataFrame) -> DataFrame:
    """Twelve rows to fill in with an instrument: index, names, nominal colour, three blanks."""
    number = lambda c: F.format_string("%.3f", F.col(c))
    return patches.select(
        (F.col("slot") + 1).alias("index"), "patch_id", "role", "row", "nominal_hex", number("L").alias("nominal_L"), number("a").alias("nominal_a"),
        number("b").alias("nominal_b"), *(F.lit("").alias(f"measured_{c}") for c in "Lab"),
    )


