"""Self-calibration of cards: medians of repeated frames, their agreement, and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from capturelake.functions.card import ALL_PATCHES
from capturelake.functions.colour import linear_rgb_to_lab, round_measure, with_delta_e_2000

LEAST_FRAMES = 3
MOST_DISAGREEMENT = 6.0


def patch_agreements(readings: DataFrame) -> DataFrame:
    """(card_serial, patch_id, slot, L, a, b, frames, agreement): component medians over frames, and the mean Delta E of
    the frames to them. Of several readings of a patch in a frame the first counts (reading_pos); one without a colour is none.

    Readings are dealt once, by card and patch; frames, medians and agreement are all taken where they lie."""
    key = ["card_serial", "patch_id"]
    readings = readings.filter("r is not null and g is not null and b is not null").repartition(*key)
    lab = linear_rgb_to_lab((F.col("r"), F.col("g"), F.col("b")))
    first = readings.groupBy("card_serial", "frame_id", "patch_id").agg(F.min_by(F.struct("slot", "r", "g", "b"), "reading_pos").alias("x"))
    rows = first.select(*key, "x.*")
    rows = rows.select(*key, "slot", lab[0].alias("L"), lab[1].alias("a"), lab[2].alias("b"))
    rows = rows.withColumns({f"m_{c}": F.median(c).over(W.partitionBy(*key)) for c in "Lab"})
    both = with_delta_e_2000(rows, tuple(F.col(f"m_{c}") for c in "Lab"), tuple(F.col(c) for c in "Lab"), "d")
    return both.groupBy(*key).agg(F.first("slot").alias("slot"), *(F.first(f"m_{c}").alias(c) for c in "Lab"), F.count("*").alias("frames"), F.avg("d").alias("agreement"))


def self_calibrate(readings: DataFrame, least_frames: int = LEAST_FRAMES, most: float = MOST_DISAGREEMENT) -> DataFrame:
    """One row per card: frames, reason of refusal (too-few-frames, incomplete-patch-coverage, frames-disagree, in this
    order) with the patch at fault, worst and mean agreement, and the accepted patches with rounded values."""
    frames = readings.groupBy("card_serial").agg(F.countDistinct("frame_id").alias("frame_count"))
    patches = patch_agreements(readings).join(frames, "card_serial")
    entry = F.struct("slot", "patch_id", *(round_measure(F.col(c), 4).alias(c) for c in "Lab"), round_measure(F.col("agreement"), 2).alias("agreement"))
    short = F.col("frames") != F.col("frame_count")
    cards = patches.groupBy("card_serial").agg(
        F.first("frame_count").alias("frame_count"), F.array_sort(F.collect_list(entry)).alias("patches"), F.max("agreement").alias("worst_agreement"),
        F.avg("agreement").alias("mean_agreement"), F.max_by("patch_id", F.struct("agreement", "slot")).alias("worst_patch"),
        F.collect_set(F.when(~short, F.col("slot"))).alias("whole"),
    )
    missing = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(ALL_PATCHES - 1)), "whole"))
    reason = (
        F.when(F.col("frame_count") < least_frames, "too-few-frames").when(missing.isNotNull(), "incomplete-patch-coverage")
        .when(F.col("worst_agreement") > most, "frames-disagree")
    )
    cards = cards.withColumns({"reason": reason, "missing_slot": missing})
    ok = F.col("reason").isNull()
    report = ok | (F.col("reason") == "frames-disagree")
    return cards.select(
        "card_serial", "frame_count", ok.alias("ok"), "reason", F.when(F.col("reason") == "incomplete-patch-coverage", F.col("missing_slot")).alias("missing_slot"),
        F.when(F.col("reason") == "frames-disagree", F.col("worst_patch")).alias("worst_patch"), F.when(report, F.col("worst_agreement")).alias("worst_agreement"),
        F.when(report, F.col("mean_agreement")).alias("mean_agreement"), F.when(ok, "self-measured").alias("provenance"), F.when(ok, F.col("patches")).alias("patches"),
    )


def calibration_report(readings: DataFrame) -> DataFrame:
    """(card_serial, frame_count, worst_agreement, mean_agreement) whatever the verdict."""
    frames = readings.groupBy("card_serial").agg(F.countDistinct("frame_id").alias("frame_count"))
    found = patch_agreements(readings).groupBy("card_serial").agg(F.max("agreement").alias("worst_agreement"), F.avg("agreement").alias("mean_agreement"))
    return frames.join(found, "card_serial")


def calibration_patches(cards: DataFrame) -> DataFrame:
    """(card_serial, patch_id, L, a, b, agreement) of the accepted cards."""
    return cards.filter("ok").select("card_serial", F.explode("patches").alias("p")).select("card_serial", "p.patch_id", "p.L", "p.a", "p.b", "p.agreement")


