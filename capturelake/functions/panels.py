"""Reagent panels and their reference outcomes, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions.colour import hex_to_lab, with_delta_e_2000

MAX_MATCH = 12.0
MIN_SEPARATION = 8.0
PROVENANCE_RANK = ("placeholder", "literature", "lab-verified")
#: Fixed values: (panel, name, outcome, label, category, colour, substances), in panel order.
OUTCOMES = (
    ("marquis", "Marquis", "marquis-no-reaction", "No colour change, negative", "negative", "#efe7c8", ()),
    ("marquis", "Marquis", "marquis-orange-brown", "Orange to brown, consistent with amphetamine-type substances", "positive", "#b06a24", ("amphetamine", "methamphetamine")),
    ("marquis", "Marquis", "marquis-purple", "Purple to violet, consistent with opiates", "positive", "#5a2a6e", ("morphine", "heroin", "codeine")),
    ("marquis", "Marquis", "marquis-dark", "Very dark purple to black, consistent with MDMA/MDA group", "positive", "#241428", ("MDMA", "MDA")),
    ("cobalt-thiocyanate", "Cobalt thiocyanate (Scott)", "cobalt-pink", "Pink, unchanged, negative", "negative", "#d96b8a", ()),
    ("cobalt-thiocyanate", "Cobalt thiocyanate (Scott)", "cobalt-blue", "Blue, consistent with cocaine", "positive", "#1f4fa8", ("cocaine hydrochloride", "cocaine base")),
    ("duquenois-levine", "Duquenois-Levine", "dl-no-reaction", "No significant colour, negative", "negative", "#ece4d6", ()),
    ("duquenois-levine", "Duquenois-Levine", "dl-purple", "Purple to violet, consistent with cannabis", "positive", "#6b2f7a", ("cannabis",)),
    ("simons", "Simon's", "simons-no-reaction", "No blue colour, negative for secondary amines", "negative", "#f0e8c8", ()),
    ("simons", "Simon's", "simons-blue", "Deep blue, consistent with a secondary amine such as MDMA", "positive", "#1c3f80", ("MDMA", "methamphetamine")),
)
PANELS = tuple(dict.fromkeys(o[0] for o in OUTCOMES))


def outcome_rows() -> list[tuple]:
    """One tuple for each outcome, with its position in its panel and its Lab reference."""
    seen: dict[str, int] = {}
    rows = []
    for panel, name, outcome, label, category, colour, substances in OUTCOMES:
        pos = seen[panel] = seen.get(panel, -1) + 1
        rows.append((panel, name, pos, outcome, label, category, colour, *hex_to_lab(colour), "placeholder", list(substances), MAX_MATCH, MIN_SEPARATION))
    return rows


def panel_outcomes(spark: SparkSession) -> DataFrame:
    schema = (
        "panel_id string, panel_name string, outcome_pos int, outcome_id string, label string, category string, hex string, "
        "L double, a double, b double, provenance string, substances array<string>, max_match double, min_separation double"
    )
    return spark.createDataFrame(outcome_rows(), schema)


def find_panel(outcomes: DataFrame, panel_id: str) -> DataFrame:
    """A panel's outcomes in its order; of an unknown panel no rows."""
    return outcomes.filter(F.col("panel_id") == panel_id).orderBy("outcome_pos")


def panel_provenance(outcomes: DataFrame) -> DataFrame:
    """(panel_id, provenance, needs_verification): a panel is as good as its weakest reference."""
    rank = F.array_position(F.array(*map(F.lit, PROVENANCE_RANK)), F.col("provenance"))
    weakest = outcomes.groupBy("panel_id").agg(F.min_by("provenance", rank).alias("provenance"))
    return weakest.withColumn("needs_verification", F.col("provenance") != "lab-verified")


def panel_separation(outcomes: DataFrame) -> DataFrame:
    """(panel_id, closest_delta_e, first, second, separable): the closest pair of each panel's outcomes; of equal pairs the
    first counts. A panel with one outcome has an infinite distance and is separable."""
    one = outcomes.select("panel_id", "min_separation", F.col("outcome_pos").alias("i"), F.col("outcome_id").alias("x"), *(F.col(c).alias(f"{c}1") for c in "Lab"))
    two = outcomes.select("panel_id", F.col("outcome_pos").alias("j"), F.col("outcome_id").alias("y"), *(F.col(c).alias(f"{c}2") for c in "Lab"))
    pairs = one.join(F.broadcast(two), "panel_id").filter("i < j")  # pairs within a panel of a few outcomes
    pairs = with_delta_e_2000(pairs, tuple(map(F.col, ("L1", "a1", "b1"))), tuple(map(F.col, ("L2", "a2", "b2"))), "d")
    best = pairs.groupBy("panel_id").agg(F.min_by(F.struct("d", "x", "y"), F.struct("d", "i", "j")).alias("p"))
    panels = outcomes.groupBy("panel_id").agg(F.first("min_separation").alias("least"))
    gap = F.coalesce(F.col("p.d"), F.lit(float("inf")))
    return panels.join(F.broadcast(best), "panel_id", "left").select(
        "panel_id", gap.alias("closest_delta_e"), F.col("p.x").alias("first"), F.col("p.y").alias("second"), (gap > F.col("least")).alias("separable")
    )


def panel_data_checks(outcomes: DataFrame) -> DataFrame:
    """(panel_id, outcomes, ids_unique, one_negative, accepts_apart): what a panel must hold before it is used."""
    basic = outcomes.groupBy("panel_id").agg(
        F.count("*").alias("outcomes"), (F.count("*") == F.countDistinct("outcome_id")).alias("ids_unique"),
        (F.count_if(F.col("category") == "negative") == 1).alias("one_negative"), F.first("max_match").alias("radius"),
    )
    gaps = panel_separation(outcomes).select("panel_id", "closest_delta_e")
    return basic.join(gaps, "panel_id").select("panel_id", "outcomes", "ids_unique", "one_negative", (F.col("radius") < F.col("closest_delta_e")).alias("accepts_apart"))


def ordered_panels(outcomes: DataFrame) -> DataFrame:
    """One row a panel with its outcomes as an array in panel order, to be broadcast."""
    entry = F.struct("outcome_pos", "outcome_id", "label", "category", "L", "a", "b", "substances")
    rows = outcomes.groupBy("panel_id").agg(
        F.first("panel_name").alias("panel_name"), F.array_sort(F.collect_list(entry)).alias("outcomes"),
        F.first("max_match").alias("max_match"), F.first("min_separation").alias("min_separation"),
    )
    return rows.join(panel_provenance(outcomes), "panel_id")
