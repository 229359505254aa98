"""The evidence audit: every record of a log by its own text, its signature, its image and its place in the chain.

Hashes and signatures are taken where the records are read, before anything is shuffled; images are hashed at their scan and
joined as digests; the chain's sort carries hashes and findings only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.canonical import key_fingerprint, sound_text, with_hashes
from capturelake.functions.signature import verify_signature
from capturelake.operators import chain
from capturelake.shared import kept

#: Where the checked members stand in a record.
MEMBERS = {
    "algorithm": ("$.signature.algorithm", "string"), "signed_core_hash": ("$.signature.coreHash", "string"), "vl_value": ("$.signature.value", "string"),
    "vl_kind": ("$.signature.publicKeyJwk.kty", "string"), "vl_curve": ("$.signature.publicKeyJwk.crv", "string"), "vl_x": ("$.signature.publicKeyJwk.x", "string"), "vl_y": ("$.signature.publicKeyJwk.y", "string"),
    "signed_image_hash": ("$.image.sha256", "string"), "own_index": ("$.chain.index", "long"), "previous_hash": ("$.chain.previousRecordHash", "string"),
    "device_fingerprint": ("$.device.publicKeyFingerprint", "string"), "own_id": ("$.recordId", "string"),
}


def with_members(records: DataFrame, text: str = "record_json") -> DataFrame:
    """Add the members that checks need, and ``malformed``: true of a text that is no JSON object. A member that is absent or of
    another kind is null."""
    rows = records.withColumn("vl_sound", sound_text(F.col(text)))
    value = F.try_parse_json("vl_sound")
    found: dict[str, Column] = {name: F.try_variant_get(value, path, kind) for name, (path, kind) in MEMBERS.items()}
    return rows.withColumns({**found, "malformed": F.col("vl_sound").isNull()}).drop("vl_sound")


def verify_image_hash(records: DataFrame, images: DataFrame) -> DataFrame:
    """Add ``image_hash``: the digest of the file at a record's image_path, from ``images`` (path, sha256; as ``read_image_bytes`` gives
    them), null where there is no path or no such file, so that nothing is compared. Of a path that stands twice one file counts."""
    digests = images.groupBy(F.col("path").alias("image_path")).agg(F.min("sha256").alias("image_hash"))
    return records.drop("image_hash").join(digests, "image_path", "left")


def verify_log(records: DataFrame, images: DataFrame | None = None, long_chains: bool = False) -> DataFrame:
    """One row for each record of a log: device_id, record_id, pos, chain_index, ``failures`` (all, in fixed order), ``valid``, the
    signer's fingerprint, ``attributed`` (the device's key signed), and its hash.

    ``records`` have device_id, record_id, chain_index (their place in the log) and record_json, and image_path where ``images`` are
    to be compared. Everything that is checked comes from the text. A text that is no record fails as malformed-record, alone,
    and breaks the link of the record after it. With ``long_chains`` a device's log is sorted by many tasks; what was found of each
    record by itself is then kept first, as sorting in ranges reads its input twice."""
    hashed = with_members(with_hashes(records, core_text="vl_core"))
    known = (F.col("vl_kind") == "EC") & (F.col("vl_curve") == "P-256")
    checked = hashed.withColumn("vl_signed", verify_signature(F.when(known, F.col("vl_x")), F.col("vl_y"), F.col("vl_core"), F.col("vl_value")))
    signer = F.when(F.col("vl_signed.key_ok"), key_fingerprint(F.col("vl_curve"), F.col("vl_x"), F.col("vl_y")))
    facts = ["algorithm", "core_hash", "signed_core_hash", "signed_image_hash", "record_hash", "own_index", "previous_hash", "device_fingerprint", "malformed"]
    path = ["image_path"] if images is not None else []
    rows = checked.select(
        "device_id", "record_id", F.col("chain_index").cast("long").alias("chain_index"), *path, *facts, F.col("vl_signed.key_ok").alias("key_ok"),
        F.col("vl_signed.signature_ok").alias("signature_ok"), signer.alias("signer_fingerprint"),
    )
    rows = rows.withColumn("image_hash", F.lit(None).cast("string")) if images is None else verify_image_hash(rows, images)
    linked = chain.verify_long_chains(kept(rows, "checked-records"), "own_index") if long_chains else chain.verify_chains(rows, "own_index")
    done = chain.attribution_check(chain.verify_records(linked))
    return done.select("device_id", "record_id", F.col("pos").cast("long").alias("pos"), "chain_index", "failures", (F.size("failures") == 0).alias("valid"), "signer_fingerprint", "attributed", "record_hash")


def log_verdicts(verified: DataFrame) -> DataFrame:
    """(device_id, valid, first_invalid, records, failed): each device's log; first_invalid is a position, or -1."""
    bad = F.min(F.when(~F.col("valid"), F.col("pos")))
    return verified.groupBy("device_id").agg(
        bad.isNull().alias("valid"), F.coalesce(bad, F.lit(-1).cast("long")).alias("first_invalid"), F.count("*").alias("records"), F.count_if(~F.col("valid")).alias("failed")
    )
