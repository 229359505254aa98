"""Whole logs: chaining of record cores, the evidence audit, storage, sync states and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from capturelake.functions import canonical
from capturelake.operators import audit, chain, correction, log
from capturelake.plans.views import signer
from capturelake.sources import io
from capturelake.streaming import stream

KEYS, SIGN = signer()


def core(n, index, head, note="plain", image="none", finger="f"):
    return {
        "chain": {"index": index, "previousRecordHash": head}, "device": {"publicKeyFingerprint": finger}, "image": {"sha256": image}, "note": note, "recordId": f"r{n}", "x": None,
        "y": -0.0 if n % 2 else 1e-7,
    }


def fingerprint(key):
    return hashlib.sha256(f"P-256.{KEYS[key][2]}.{KEYS[key][3]}".encode()).hexdigest()[:32]


def signed(n, index, head, key=0, **more):
    """(record text, its hash) of a signed record."""
    own = core(n, index, head, finger=fingerprint(key), **more)
    text = canonical.canonical_text(json.dumps(own))
    own["signature"] = {"algorithm": "ECDSA-P256-SHA256", "coreHash": hashlib.sha256(text.encode()).hexdigest(), "publicKeyJwk": {"crv": "P-256", "kty": "EC", "x": KEYS[key][2], "y": KEYS[key][3]}, "value": SIGN(text, key)}
    whole = canonical.canonical_text(json.dumps(own))
    return whole, hashlib.sha256(whole.encode()).hexdigest()


def signed_log(n, key=0, **more):
    head, out = canonical.GENESIS, []
    for i in range(n):
        text, head = signed(i, i, head, key, **more)
        out.append(text)
    return out


SCHEMA = "device_id long, record_id string, chain_index long, record_json string, image_path string"


def audited(spark, texts, images=None, paths=None, long_chains=False):
    rows = [(1, f"r{i}", i, t, (paths or {}).get(i)) for i, t in enumerate(texts) if t is not ...]
    done = audit.verify_log(spark.createDataFrame(rows, SCHEMA), images, long_chains)
    got = {r.record_id: r for r in done.collect()}
    return [got[f"r{i}"].failures for i, t in enumerate(texts) if t is not ...], audit.log_verdicts(done).first(), got


def changed(text, f):
    own = json.loads(text)
    f(own)
    return canonical.canonical_text(json.dumps(own))


BOTH = ["chain-broken", "chain-index-mismatch"]


@pytest.mark.parametrize("long_chains", [False, True])
def test_tampering(spark, long_chains):
    base = signed_log(6)
    run = lambda texts: audited(spark, texts, long_chains=long_chains)[:2]
    found, verdict = run(base)
    assert found == [[]] * 6 and (verdict.valid, verdict.first_invalid, verdict.records, verdict.failed) == (True, -1, 6, 0)
    edit = [*base[:2], changed(base[2], lambda r: r.update(note="other")), *base[3:]]
    found, verdict = run(edit)
    assert found == [[], [], ["core-hash-mismatch", "bad-signature"], ["chain-broken"], [], []] and verdict.first_invalid == 2
    rehashed = changed(edit[2], lambda r: r["signature"].update(coreHash=hashlib.sha256(canonical.pruned_text(edit[2], "signature").encode()).hexdigest()))
    assert run([*base[:2], rehashed, *base[3:]])[0] == [[], [], ["bad-signature"], ["chain-broken"], [], []]
    gone, verdict = run([*base[:2], ..., *base[3:]])
    assert gone == [[], [], BOTH, [], []] and verdict.first_invalid == 2
    assert run([..., *base[1:]])[0][0] == BOTH
    swapped = [base[0], base[2], base[1], *base[3:]]
    assert run(swapped)[0] == [[], BOTH, BOTH, BOTH, [], []]
    own, _ = signed(2, 2, json.loads(base[2])["chain"]["previousRecordHash"], key=3)
    found = run([*base[:2], own, *base[3:]])
    assert found[0] == [[], [], [], ["chain-broken"], [], []]  # signed anew by another key: only its successor tells
    for f, want in (
        (lambda r: r["signature"].update(algorithm="RSA"), ["unsupported-algorithm"]), (lambda r: r.pop("signature"), ["unsupported-algorithm"]),
        (lambda r: r["signature"]["publicKeyJwk"].update(x="AAAA"), ["malformed-public-key"]), (lambda r: r["signature"].pop("publicKeyJwk"), ["malformed-public-key"]),
        (lambda r: r["signature"]["publicKeyJwk"].update(crv="P-384"), ["malformed-public-key"]), (lambda r: r["signature"].update(value="!"), ["bad-signature"]),
    ):
        assert run([*base[:2], changed(base[2], f), *base[3:]])[0] == [[], [], want, ["chain-broken"], [], []]


def test_texts_that_are_no_records(spark):
    """They fail by themselves and break the next link; the rest of the log is judged."""
    base = signed_log(8)
    twice = '{"a":1,' + base[3][1:-1] + ',"recordId":"again"}'
    found, verdict, _ = audited(spark, [base[0], base[1][:-3], base[2], twice, base[4], None, base[6], "[1]"])
    assert found == [[], ["malformed-record"], BOTH, ["malformed-record"], BOTH, ["malformed-record"], BOTH, ["malformed-record"]]
    assert (verdict.first_invalid, verdict.failed) == (1, 7)
    assert audit.log_verdicts(audit.verify_log(spark.createDataFrame([], SCHEMA))).count() == 0


def test_images_and_signers(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"image a")
    (tmp_path / "b").write_bytes(b"image b")
    images = io.read_image_bytes(spark, str(tmp_path))
    path = {r.path.rpartition("/")[2]: r.path for r in images.collect()}
    texts = signed_log(4, key=2, image=hashlib.sha256(b"image a").hexdigest())
    found, _, got = audited(spark, texts, images, {0: path["a"], 1: path["b"], 2: "file:/no/such", 3: None})
    assert found == [[], ["image-hash-mismatch"], [], []]
    assert {r.attributed for r in got.values()} == {True} and got["r0"].signer_fingerprint == fingerprint(2)
    other = changed(texts[0], lambda r: r["device"].update(publicKeyFingerprint="other"))
    assert not audited(spark, [other])[2]["r0"].attributed
    assert not audited(spark, ["{}"])[2]["r0"].attributed


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_long_chains_equal_the_window(spark, parts):
    n = 3000
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 3).when(F.col("id") % 10 == 1, None).otherwise(7).alias("device_id"), (F.col("id") % 2500).alias("chain_index"), F.concat(F.lit("r"), F.col("id") % 2900).alias("record_id"),
        F.concat(F.lit("h"), F.col("id") - 1).alias("previous_hash"), F.when(F.col("id") % 77 != 0, F.concat(F.lit("h"), "id")).alias("record_hash"),
    )
    want = chain.verify_chains(rows)
    got = chain.verify_long_chains(rows, parts=parts)
    columns = sorted(want.columns)
    key = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert key(got) == key(want)
    if parts == 16:
        hot = got.sparkSession.createDataFrame([(1, i, f"r{i}", "p", "h") for i in range(400)], "device_id long, chain_index long, record_id string, previous_hash string, record_hash string")
        sizes = chain.verify_long_chains(hot, parts=4).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1


def test_cores_are_chained(spark):
    """Cores with whatever links become finished records that verify, with columns that pass; texts without a link are refused."""
    trap = '{index} "chain":{"index":1,"previousRecordHash":"' + "a" * 64 + '"}  é'
    rows = [(d, f"r{i}", f"2026-01-0{i + 1}", canonical.canonical_text(json.dumps(core(i, 5, "b" * 64, note=trap))), i * 10) for d in (1, 2) for i in range(4)]
    rows += [(1, "none", "2026-01-02T5", '{"a":1}', 0), (1, "null", "2026-01-02T6", None, 0)]
    cores = spark.createDataFrame(rows, "device_id long, record_id string, captured_at string, record_json string, extra long")
    heads = spark.createDataFrame([(2, 9, "c" * 64)], "device_id long, next_index long, previous_hash string")
    done = chain.chain_records(cores, heads)
    got = {(r.device_id, r.record_id): r for r in done.collect()}
    assert {k for k, r in got.items() if r.refused} == {(1, "none"), (1, "null")} and got[1, "none"].record_json == '{"a":1}'
    for device, first, head in ((1, 0, canonical.GENESIS), (2, 9, "c" * 64)):
        for i in range(4):
            r = got[device, f"r{i}"]
            own = json.loads(r.record_json)
            assert own == core(i, first + i, head, note=trap) and r.extra == i * 10
            assert canonical.canonical_text(r.record_json) == r.record_json
            assert (r.chain_index, r.previous_hash, r.record_hash) == (first + i, head, hashlib.sha256(r.record_json.encode()).hexdigest())
            head = r.record_hash
    hashed = done.filter("refused is null").withColumn("record_hash", canonical.record_hash(F.col("record_json")))
    checked = chain.verify_chains(hashed.filter("device_id = 1"))
    assert chain.chain_summary(checked).first().valid
    assert "Join" not in chain.chain_records(cores)._jdf.queryExecution().optimizedPlan().toString()


def stored_rows(spark, *rows):
    return spark.createDataFrame([(*r, "op", "p") for r in rows], "record_id string, captured_at string, sync_state string, version int, device_id long, chain_index long, operator_id string, panel_id string").withColumn("capture_accepted", F.lit(True))


def test_stored_log_keeps_what_it_has(spark, tmp_path):
    at = str(tmp_path / "log")
    day = lambda d, h=0: f"2026-01-{d:02d}T{h:02d}:00:00.000Z"
    io.upsert_records(stored_rows(spark, ("a", day(1), "pending", 1, 1, 0), ("b", day(1, 5), "pending", 1, 1, 1), ("c", day(2), "pending", 1, 1, 2)), at)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "log" / "capture_date=2026-01-02").glob("*.parquet")}
    io.upsert_records(stored_rows(spark, ("d", day(3), "pending", 1, 1, 3), ("a", day(1), "synced", 2, 1, 0), ("b", day(1, 5), "stale", 0, 1, 1)), at)
    table = io.read_log(spark, at)
    assert sorted((r.record_id, r.sync_state, r.capture_date) for r in table.collect()) == [("a", "synced", "2026-01-01"), ("b", "pending", "2026-01-01"), ("c", "pending", "2026-01-02"), ("d", "pending", "2026-01-03")]
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "log" / "capture_date=2026-01-02").glob("*.parquet")} == files  # an untouched day is not written
    with pytest.raises(ValueError, match="record a stands under 2026-01-01"):
        io.upsert_records(stored_rows(spark, ("a", day(2), "synced", 3, 1, 0)), at)
    with pytest.raises(ValueError, match="holds a log"):
        io.write_records(table, at)
    assert io.read_log(spark, at).count() == 4
    found = log.search(table, since="2026-01-02", until=day(2, 23))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [r.record_id for r in found.collect()] == ["c"]
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "capture_date" in filters and "2026-01-02" in filters
    assert [r.record_id for r in log.search(table, since="2026").collect()] == ["d", "c", "b", "a"]
    io.upsert_records(stored_rows(spark, ("z", None, "pending", 1, 1, 9)), at)
    assert io.read_log(spark, at).filter("record_id = 'z'").first().capture_date == "unknown"


def test_sync_states_of_unknown_records(spark):
    records = stored_rows(spark, ("a", "t", "pending", 1, 1, 0), ("b", "t", "pending", 1, 1, 1))
    updates = lambda *rows: spark.createDataFrame(rows, "record_id string, sync_state string, update_pos int")
    states = lambda df: {r.record_id: r.sync_state for r in df.collect()}
    assert states(log.update_sync_state(records, updates(("a", "failed", 1), ("a", "synced", 2)))) == {"a": "synced", "b": "pending"}
    bad = updates(("a", "synced", 1), ("nope", "synced", 1))
    with pytest.raises(Exception, match="no record nope"):
        log.update_sync_state(records, bad).collect()
    assert states(log.update_sync_state(records, bad, "ignore")) == {"a": "synced", "b": "pending"}
    assert [r.record_id for r in log.unknown_updates(records, bad).collect()] == ["nope"]
    assert log.update_sync_state(records, bad.filter("false")).columns == records.columns


def test_lookups(spark):
    records = stored_rows(spark, ("a", "t", "pending", 1, 1, 0), ("b", "t", "pending", 1, 1, 1), ("c", "t", "pending", 1, 2, 0))
    assert [r.record_id for r in log.all_records(records).collect()] == ["a", "b", "c"]
    assert {r.device_id: r.records for r in log.count(records).collect()} == {1: 2, 2: 1}
    assert sorted(r.record_id for r in log.latest(records).collect()) == ["b", "c"] and log.latest(records).columns == records.columns
    from capturelake.functions import panels

    outcomes = panels.panel_outcomes(spark)
    assert [r.outcome_pos for r in panels.find_panel(outcomes, "marquis").collect()] == [0, 1, 2, 3] and panels.find_panel(outcomes, "x").count() == 0
    same = correction.identity_correction(spark.createDataFrame([(1, 0.2, 0.3, 0.4)], "capture_id int, r double, g double, b double"))
    rgb = correction.apply_correction(F.col("matrix"), F.col("field"), (F.lit(0.2), F.lit(0.3), F.lit(0.4)), F.lit(0.1), F.lit(0.9))
    assert list(same.select(*rgb).first()) == pytest.approx([0.2, 0.3, 0.4])


def test_appends_stream_in_sorted_batches(spark, tmp_path):
    """One device sends all of each micro-batch; micro-batches come in any order of files, and one is run again."""
    rows, head = [], canonical.GENESIS
    for i in range(600):
        rows.append((1 if i < 590 else None, i if i < 590 else 0, f"2026-{i:04d}", f"r{i}", head, f"h{i}"))
        head = f"h{i}" if i < 590 else head
    rows[-10:] = [(None, 0, "t", f"n{k}", canonical.GENESIS, f"g{k}") for k in range(10)]
    schema = "device_id long, chain_index long, captured_at string, record_id string, previous_hash string, record_hash string"
    for k in range(3):
        spark.createDataFrame(rows[k * 200 : (k + 1) * 200][::-1], schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.append_stream(source, str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.record_id: r for r in stream.appended(spark, str(tmp_path / "log")).collect()}
    assert len(got) == 600 and sum(r.accepted for r in got.values()) == 591
    assert all(got[f"r{i}"].accepted for i in range(590)) and got["n0"].accepted and not got["n5"].accepted
    heads = stream._heads(str(tmp_path / "log"), spark.createDataFrame([], schema), 99, 0)
    assert {(r.device_id, r.next_index) for r in heads.collect()} == {(1, 590), (None, 1)}


def test_bad_documents_are_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"exportedAt":"now","records":[{"b":1}]}')
    (tmp_path / "b.json").write_text('{"exportedAt":"now","records":[{"b":1,"b":2}]}')
    (tmp_path / "c.json").write_text('{"exportedAt":"now"}')
    (tmp_path / "d.json").write_text("no json")
    got = io.read_records(spark, str(tmp_path)).collect()
    assert sorted((r.error or "", r.record_json[:7]) for r in got) == [("", '{"b":1}'), ("document-malformed", "no json"), ("document-malformed", '{"expor'), ("no-records", '{"expor')]
    (tmp_path / "e" / "records").mkdir(parents=True)
    (tmp_path / "e" / "records" / "x.txt").write_text('{"b":1, "a":2}\nbroken\n[1]\n')
    (tmp_path / "e" / "manifest").mkdir()
    (tmp_path / "e" / "manifest" / "m.json").write_text('{"exportedAt":"now","recordCount":3,"note":""}')
    got = io.read_export(spark, str(tmp_path / "e")).collect()
    assert sorted((r.error or "", r.record_json) for r in got) == [("", '{"a":2,"b":1}'), ("record-malformed", "[1]"), ("record-malformed", "broken")]
