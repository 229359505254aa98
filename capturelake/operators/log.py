"""The record log: search, lookups, sync states, summaries, and its exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.canonical import fixed_text, number_text

CSV_COLUMNS = (
    "chain_index", "record_id", "captured_at_utc", "operator_id", "case_reference", "panel", "capture_accepted", "category", "outcome",
    "confidence", "match_delta_e", "latitude", "longitude", "accuracy_m", "reference_provenance", "requires_lab_confirmation", "sync_state",
)
TEXT_FIELDS = ("case_reference", "operator_id", "operator_name", "label", "operator_notes", "panel_name", "kit_lot_number")
STATES = ("pending", "synced", "failed")


def search(
    records: DataFrame, category: str = "", panel_id: str = "", operator_id: str = "", sync_state: str = "", since: str = "", until: str = "",
    text: str = "", include_rejected: bool = False,
) -> DataFrame:
    """Records that meet every filter given (empty: no filter), newest chain index first. Times are ISO strings, bounds
    included. ``text`` is looked for in seven fields joined by a space. Equalities come first, so they reach the scan; of a log
    that is stored by days (``sources.io.write_records``) only those that time bounds allow are read."""
    c = F.col
    if "capture_date" in records.columns:
        if since:
            records = records.filter(c("capture_date") >= since[:10])
        if until:
            records = records.filter(c("capture_date") <= until[:10])
    for name, value in (("category", category), ("panel_id", panel_id), ("operator_id", operator_id), ("sync_state", sync_state)):
        if value:
            records = records.filter(c(name) == value)
    if not include_rejected:
        records = records.filter("capture_accepted")
    if since:
        records = records.filter(c("captured_at") >= since)
    if until:
        records = records.filter(c("captured_at") <= until)
    if needle := text.strip().lower():
        there = [c(f) for f in TEXT_FIELDS if f in records.columns]
        records = records.filter(F.lower(F.concat_ws(" ", *there)).contains(needle))
    return records.orderBy(c("chain_index").desc(), c("device_id"))


def day_bounds(day: Column, zone: str) -> tuple[Column, Column]:
    """UTC ISO strings of a local day's first and last millisecond."""
    form = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    start = F.to_utc_timestamp(day.cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone) - F.expr("interval 1 millisecond")
    return F.date_format(start, form), F.date_format(end, form)


def get(records: DataFrame, record_id: str) -> DataFrame:
    return records.filter(F.col("record_id") == record_id)


def all_records(records: DataFrame) -> DataFrame:
    """The whole log in the order of its chains."""
    return records.orderBy("device_id", "chain_index", "record_id")


def count(records: DataFrame) -> DataFrame:
    """(device_id, records) of each device."""
    return records.groupBy("device_id").agg(F.count("*").alias("records"))


def latest(records: DataFrame) -> DataFrame:
    """The head record of each device. Tasks keep one row of each device before anything is shuffled."""
    heads = records.groupBy(F.col("device_id").alias("lg_device")).agg(F.max_by(F.struct(*records.columns), F.struct("chain_index", "record_id")).alias("lg_row"))
    return heads.select("lg_row.*")


def newest(records: DataFrame, version: str) -> DataFrame:
    """One row of each record_id: that with the greatest ``version``, of equal ones the one with the greatest hash of its row."""
    columns = records.columns
    rank = F.struct(version, F.xxhash64(*columns))
    rows = records.groupBy(F.col("record_id").alias("lg_id")).agg(F.max_by(F.struct(*columns), rank).alias("lg_row"))
    return rows.select("lg_row.*")


def upsert(records: DataFrame, updates: DataFrame, version: str) -> DataFrame:
    """Both tables' records by record_id; of several the newest ``version`` stays. ``sources.io.upsert_records`` does this to a stored
    log."""
    return newest(records.unionByName(updates), version)


def unknown_updates(records: DataFrame, updates: DataFrame) -> DataFrame:
    """The updates of records that the log does not have."""
    return updates.join(records.select("record_id"), "record_id", "left_anti")


def update_sync_state(records: DataFrame, updates: DataFrame, unknown: str = "fail") -> DataFrame:
    """Records with the last state given for each (update_pos); nothing else changes.

    An update of an unknown record fails the job when the result is read; with ``unknown="ignore"`` it has no effect, for
    callers that handle ``unknown_updates`` themselves. Both sides are joined once, by record_id."""
    if unknown not in ("fail", "ignore"):
        raise ValueError(f"unknown is fail or ignore, not {unknown}")
    last = updates.groupBy(F.col("record_id").alias("lg_id")).agg(F.max_by("sync_state", "update_pos").alias("lg_state"))
    there = records.withColumn("lg_there", F.lit(True))
    if unknown == "ignore":
        joined = there.join(last, F.col("record_id") == F.col("lg_id"), "left")
    else:
        joined = there.join(last, F.col("record_id") == F.col("lg_id"), "full")
        stray = F.col("lg_there").isNull()
        state = F.when(stray, F.raise_error(F.concat(F.lit("no record "), F.coalesce("lg_id", F.lit("null")))).cast("string")).otherwise(F.col("lg_state"))
        joined = joined.withColumn("lg_state", state).filter("lg_there or lg_state is not null")
    return joined.select(*(F.coalesce("lg_state", c).alias(c) if c == "sync_state" else F.col(c) for c in records.columns))


def pending_sync(records: DataFrame) -> DataFrame:
    return records.filter(F.col("sync_state") == "pending")


def log_summary(records: DataFrame) -> DataFrame:
    """(device_id, total, shown, refused, unsynced)."""
    return records.groupBy("device_id").agg(
        F.count("*").alias("total"), F.count_if("capture_accepted").alias("shown"), F.count_if(~F.col("capture_accepted")).alias("refused"),
        F.count_if(F.col("sync_state") != "synced").alias("unsynced"),
    )


def quoted(x: Column, kind: str = "string") -> Column:
    """Quotes only around text with a quote, comma or line feed; null is empty; doubles as JavaScript prints them."""
    text = number_text(x.cast("double")) if kind in ("double", "float") else x.cast("string")
    return F.when(text.isNull(), "").when(text.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(records: DataFrame) -> DataFrame:
    """(device_id, chain_index, line): one export line a record; columns a table lacks are empty."""
    kinds = dict(records.dtypes)
    own = {"captured_at_utc": "captured_at", "panel": "panel_name", "outcome": "outcome_id"}
    cells = []
    for name in CSV_COLUMNS:
        column = own.get(name, name)
        if name == "requires_lab_confirmation":
            cells.append(F.lit("yes"))
        elif column not in records.columns:
            cells.append(F.lit(""))
        elif name == "match_delta_e":
            cells.append(F.coalesce(fixed_text(F.col(column).cast("double"), 2), F.lit("")))
        else:
            cells.append(quoted(F.col(column), kinds[column]))
    return records.select("device_id", "chain_index", F.concat_ws(",", *cells).alias("line"))


def json_lines(records: DataFrame, text: str = "record_json") -> DataFrame:
    return records.select("device_id", "chain_index", F.col(text).alias("value"))


def export_manifest(records: DataFrame, exported_at: str, note: str) -> DataFrame:
    """One row: when, how many records, a note."""
    return records.agg(F.lit(exported_at).alias("exportedAt"), F.count("*").alias("recordCount"), F.lit(note).alias("note"))
