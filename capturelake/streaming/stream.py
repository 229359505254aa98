"""Streams: appends under an exclusive chain head, and verdicts of samples as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from capturelake.functions.canonical import GENESIS
from capturelake.operators.chain import tried
from capturelake.operators.classify import classify
from capturelake.shared import kept, there

OUT = "device_id long, record_id string, chain_index long, accepted boolean, sync_state string"
STATE = "next_index long, head string"


def _append(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    index, head = state.get if state.exists else (0, GENESIS)
    frame = pd.concat(list(batches), ignore_index=True).sort_values(["chain_index", "captured_at", "record_id"])
    accepted = []
    for own, previous, digest in zip(frame["chain_index"], frame["previous_hash"], frame["record_hash"], strict=True):
        good = own == index and previous == head
        if good:
            index, head = index + 1, digest
        accepted.append(good)
    state.update((int(index), head))
    yield pd.DataFrame(
        {"device_id": key[0], "record_id": frame["record_id"], "chain_index": frame["chain_index"], "accepted": accepted, "sync_state": ["pending" if a else None for a in accepted]}
    )


def stream_append(records: DataFrame) -> DataFrame:
    """Accepted and refused rows of a stream of records (device_id, chain_index, captured_at, record_id, previous_hash,
    record_hash). The state is one small row a device and never expires. Arrival order within a micro-batch is not
    defined, so a device's records are tried by chain index, time and id; late or stale records are refused."""
    return records.groupBy("device_id").applyInPandasWithState(_append, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


#: Heads are written whole every so many micro-batches, and as changes in between.
WHOLE_HEADS = 100


def _heads(path: str, batch: DataFrame, number: int, since: int) -> DataFrame:
    """(device_id, next_index, previous_hash) after the micro-batches before ``number``, from that of ``since`` on."""
    spark = batch.sparkSession
    kind = f"device_id {batch.schema['device_id'].dataType.simpleString()}, next_index long, previous_hash string, number long"
    if not there(spark, f"{path}/heads"):
        return spark.createDataFrame([], kind).drop("number")
    found = spark.read.schema(kind).parquet(f"{path}/heads").filter((F.col("number") < number) & (F.col("number") >= since))
    return found.groupBy("device_id").agg(F.max_by(F.struct("next_index", "previous_hash"), "number").alias("h")).select("device_id", "h.*")


def append_stream(records: DataFrame, path: str) -> DataStreamWriter:
    """A writer that appends a stream of records (as for ``stream_append``, further columns pass) to the log at ``path``: each
    micro-batch becomes ``appended/number=N``, every record with accepted and sync_state, and moves the devices' heads.

    A micro-batch is sorted by Spark and streamed through the tasks like any batch (``chain.append``), so a device that sends all
    of it needs no more memory than another; nothing is gathered. A micro-batch that is run again reads the heads
    before its number and overwrites its own folders, so each counts once. Start the writer with a checkpoint location."""

    def each(batch: DataFrame, number: int) -> None:
        base = (number - 1) // WHOLE_HEADS * WHOLE_HEADS if number else 0
        heads = _heads(path, batch, number, base)
        done = kept(tried(batch, heads), "appended")
        done.write.mode("overwrite").parquet(f"{path}/appended/number={number}")
        moved = done.filter("accepted").groupBy("device_id").agg(F.max_by(F.struct((F.col("chain_index") + 1).alias("next_index"), F.col("record_hash").alias("previous_hash")), "chain_index").alias("h"))
        moved = moved.select("device_id", "h.*")
        if number and number % WHOLE_HEADS == 0:
            moved = kept(moved.withColumn("n", F.lit(1)).unionByName(heads.withColumn("n", F.lit(0))).groupBy("device_id").agg(F.max_by(F.struct("next_index", "previous_hash"), "n").alias("h")).select("device_id", "h.*"), "heads")
        moved.write.mode("overwrite").parquet(f"{path}/heads/number={number}")

    return records.writeStream.foreachBatch(each)


def appended(spark, path: str) -> DataFrame:
    """Every record that ``append_stream`` tried, with its micro-batch's number."""
    return spark.read.parquet(f"{path}/appended")


def stream_classify(samples: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Verdicts of a stream of samples: a stream-static broadcast join and array functions, without state."""
    return classify(samples, outcomes)
