"""Reading photographs and record exports, writing records and exports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from capturelake.functions.canonical import sound_text
from capturelake.operators import log
from capturelake.operators.log import CSV_COLUMNS, csv_lines, export_manifest, json_lines
from capturelake.shared import kept, there

MOST_PIXELS = 1 << 18


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(origin, width, height, channels, data) of the photographs under a path; of a broken file the sizes are -1."""
    images = spark.read.format("image").option("dropInvalid", "false").load(path)
    return images.select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def _misfit(width, height, channels, data) -> str | None:
    """Why a photograph's buffer cannot be read, or None."""
    if data is None:
        return "no-image-data"
    if any(x is None or x != x or x <= 0 for x in (width, height)):
        return "image-size-invalid"
    if channels not in (1, 3, 4):
        return "image-channels-unknown"
    return None if len(data) == width * height * channels else "image-data-misfit"


def rgb_frames(images: DataFrame, key: str = "origin") -> DataFrame:
    """Photographs as rows for the frame operators: (capture_id, width, height, data: red, green, blue by rows, error). Grey ones are
    spread over the three. One that cannot be read keeps its row, without data and with the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data, errors = [], []
            for w, h, c, d in zip(batch["width"], batch["height"], batch["channels"], batch["data"], strict=True):
                errors.append(_misfit(w, h, c, d))
                if errors[-1]:
                    data.append(None)
                    continue
                a = np.frombuffer(d, np.uint8).reshape(-1, int(c))
                data.append((np.repeat(a, 3, axis=1) if c == 1 else a[:, 2::-1]).tobytes())
            yield pd.DataFrame({"capture_id": batch[key], "width": batch["width"], "height": batch["height"], "data": data, "error": errors})

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "width", "height", "channels", "data").mapInPandas(run, f"capture_id {kind}, width int, height int, data binary, error string")


def read_image_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256): files as they are kept; the bytes are hashed at the scan and go no further."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def frames_to_pixels(frames: DataFrame) -> DataFrame:
    """(origin, x, y, r, g, b, error): one row a pixel; a frame whose buffer does not fit its size gives one row with an
    error. Buffers are blue first, as the image reader gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples(index=False):
                if error := _misfit(f.width, f.height, f.channels, f.data):
                    yield pd.DataFrame({"origin": [f.origin], "x": [None], "y": [None], "r": [None], "g": [None], "b": [None], "error": [error]})
                    continue
                width, height, channels = int(f.width), int(f.height), int(f.channels)
                a = np.frombuffer(f.data, np.uint8).reshape(height, width, channels)
                blue, green, red = (a[:, :, 0], a[:, :, 0], a[:, :, 0]) if channels == 1 else (a[:, :, 0], a[:, :, 1], a[:, :, 2])
                for at in range(0, width * height, MOST_PIXELS):
                    y, x = np.divmod(np.arange(at, min(at + MOST_PIXELS, width * height)), width)
                    yield pd.DataFrame({"origin": f.origin, "x": x, "y": y, "r": red[y, x], "g": green[y, x], "b": blue[y, x], "error": None})

    return frames.mapInPandas(run, "origin string, x int, y int, r int, g int, b int, error string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_json, pos, exported_at, error): the records of JSON export documents, as canonical text. A document is one row;
    exports of any size are written by ``export_json`` and read by ``read_export``. A document that is not JSON or has no
    list of records gives one row with the error and its own text."""
    files = spark.read.text(path, wholetext=True).select("value", F.try_parse_json("value").alias("doc"))
    rows = files.select(
        F.try_variant_get("doc", "$.exportedAt", "string").alias("exported_at"), F.try_variant_get("doc", "$.records", "array<variant>").alias("records"),
        F.when(F.col("doc").isNull(), "document-malformed").when(F.try_variant_get("doc", "$.records", "array<variant>").isNull(), "no-records").alias("error"), "value",
    )
    good = rows.filter("error is null").select("exported_at", F.posexplode("records").alias("pos", "r")).select("exported_at", "pos", F.to_json("r").alias("record_json"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(rows.filter("error is not null").select("exported_at", F.lit(None).cast("int").alias("pos"), F.col("value").alias("record_json"), "error"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(record_json, error, exported_at) of a folder that ``export_json`` wrote, as canonical text; a line that is no record stays as it
    is, with the error."""
    manifest = spark.read.schema("exportedAt string, recordCount long, note string").json(f"{path}/manifest")
    lines = spark.read.text(f"{path}/records").withColumn("sound", sound_text(F.col("value")))
    lines = lines.select(F.coalesce(F.to_json(F.parse_json("sound")), "value").alias("record_json"), F.when(F.col("sound").isNull(), "record-malformed").alias("error"))
    return lines.crossJoin(F.broadcast(manifest.select(F.col("exportedAt").alias("exported_at"))))  # one row


def _by_day(records: DataFrame) -> DataFrame:
    return records.withColumn("capture_date", F.coalesce(F.substring("captured_at", 1, 10), F.lit("unknown")))


def _write_days(dated: DataFrame, path: str, files: int) -> None:
    """The days in ``dated`` anew, others untouched. A day is split over ``files`` tasks by device and stretch of its chain, and sorted
    by device, so that files and their row groups hold few devices."""
    place = F.pmod(F.xxhash64("device_id", F.expr("chain_index div 65536")), F.lit(files))
    dealt = dated.repartition("capture_date", place).sortWithinPartitions("capture_date", "device_id", "chain_index")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("capture_date").parquet(path)


def write_records(records: DataFrame, path: str, files: int = 16) -> None:
    """A new log: Parquet by capture date, so that searches by time read only their days. There must be none at ``path``;
    ``upsert_records`` adds to one."""
    if there(records.sparkSession, path):
        raise ValueError(f"{path} holds a log; add to it with upsert_records")
    _write_days(_by_day(records), path, files)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored log, with capture_date as text, whatever the days look like."""
    kinds = spark.read.parquet(path).schema
    text = StructType([StructField(f.name, StringType() if f.name == "capture_date" else f.dataType) for f in kinds])
    return spark.read.schema(text).parquet(path)


def upsert_records(updates: DataFrame, path: str, version: str = "version", files: int = 16) -> None:
    """Put ``updates`` into the stored log at ``path`` (or begin one): a record_id stands once, with the greatest ``version``.

    Only the days of the updates are read and written anew; the merged days are kept in the shared folder first, so that a
    write that fails can be run again from the same updates. A record's time is signed and never changes: an update that
    would move one to another day is refused, which a scan of two columns finds out. One writer at a time."""
    spark = updates.sparkSession
    new = kept(log.newest(_by_day(updates), version), "log-updates")
    if not there(spark, path):
        _write_days(new, path, files)
        return
    stored = read_log(spark, path)
    moved = stored.select("record_id", F.col("capture_date").alias("was")).join(new.select("record_id", "capture_date"), "record_id").filter("was != capture_date")
    if first := moved.first():
        raise ValueError(f"record {first['record_id']} stands under {first['was']}, not {first['capture_date']}")
    days = [r["capture_date"] for r in new.select("capture_date").distinct().collect()]
    touched = stored.filter(F.col("capture_date").isin(days))
    merged = kept(log.newest(touched.unionByName(new, allowMissingColumns=True), version), "log-days")
    _write_days(merged, path, files)


def export_csv(records: DataFrame, path: str) -> None:
    """The export with its header: lines in order of device and chain index, sorted in ranges, one file each; the header is a
    file of its own that sorts first."""
    lines = csv_lines(records).repartitionByRange("device_id", "chain_index").sortWithinPartitions("device_id", "chain_index").select("line")
    spark = records.sparkSession
    spark.createDataFrame([(",".join(CSV_COLUMNS),)], "line string").coalesce(1).write.text(f"{path}/0-header")
    lines.write.text(f"{path}/1-lines")


def export_json(records: DataFrame, path: str, exported_at: str, note: str = "") -> None:
    """One JSON record a line in chain order, and a manifest row."""
    lines = json_lines(records).repartitionByRange("device_id", "chain_index").sortWithinPartitions("device_id", "chain_index").select("value")
    lines.write.text(f"{path}/records")
    export_manifest(records, exported_at, note).coalesce(1).write.json(f"{path}/manifest")
