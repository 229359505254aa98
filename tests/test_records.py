"""Canonical text, signatures, chains, detection and corrections on small cases."""

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturelake.functions import canonical, card, geometry, signature
from capturelake.operators import chain, classify, correction, detect, pixels
from capturelake.sources import io


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"b":1,"a":{"d":null,"c":[3,1]}}', '{"a":{"c":[3,1],"d":null},"b":1}'),
        ('{"x":-0.0,"y":12.0,"z":1e-7}', '{"x":0,"y":12,"z":1e-7}'),
        ('{"é":"\\u0001","A":1e21,"k":0.000001}', '{"A":1e+21,"k":0.000001,"é":"\\u0001"}'),
    ],
)
def test_canonical(spark, text, want):
    assert canonical.canonical_text(text) == want
    assert canonical.canonical_text(want) == want
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(canonical.canonicalise(F.col("t"))).first()[0] == want


def test_core_leaves_the_signature_out(spark):
    df = spark.createDataFrame([('{"a":null,"signature":{"v":1},"b":2}',)], "t string")
    assert df.select(canonical.core_hash(F.col("t"))).first()[0] == hashlib.sha256(b'{"a":null,"b":2}').hexdigest()


def _signed(secret: int, message: bytes) -> tuple[str, str, str]:
    b64 = lambda n: base64.urlsafe_b64encode(n.to_bytes(32, "big")).decode().rstrip("=")
    x, y = signature.point_times([(secret, signature.G)])
    k = 123456789
    r = signature.point_times([(k, signature.G)])[0] % signature.N
    e = int.from_bytes(hashlib.sha256(message).digest(), "big")
    s = pow(k, -1, signature.N) * (e + r * secret) % signature.N
    return b64(x), b64(y), base64.urlsafe_b64encode(r.to_bytes(32, "big") + s.to_bytes(32, "big")).decode().rstrip("=")


def test_signatures(spark):
    x, y, sig = _signed(987654321, b"core")
    rows = [(x, y, "core", sig), (x, y, "edited", sig), (x, x, "core", sig), (x, y, "core", "junk!"), (None, y, "core", sig)]
    df = spark.createDataFrame(rows, "x string, y string, t string, s string")
    got = df.select(signature.verify_signature(*map(F.col, "xyts")).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (False, False), (True, False), (False, False)]


def test_deletion_and_edit_break_the_chain(spark):
    h = ["h0", "h1", "h2", "h3"]
    rows = [(1, i, f"r{i}", h[i - 1] if i else canonical.GENESIS, "edited" if i == 1 else h[i]) for i in (0, 1, 3)]
    df = spark.createDataFrame(rows, "device_id long, chain_index long, record_id string, previous_hash string, record_hash string")
    done = {r.record_id: (r.chain_broken, r.index_mismatch) for r in chain.verify_chains(df).collect()}
    assert done == {"r0": (False, False), "r1": (False, False), "r3": (True, True)}
    s = chain.chain_summary(chain.verify_chains(df)).first()
    assert (s.valid, s.first_invalid, s.records) == (False, 2, 3)


def test_stale_append_is_refused(spark):
    rows = [(1, 0, "t", "a", canonical.GENESIS, "ha"), (1, 0, "t", "b", canonical.GENESIS, "hb"), (1, 1, "t", "c", "ha", "hc")]
    df = spark.createDataFrame(rows, "device_id long, chain_index long, captured_at string, record_id string, previous_hash string, record_hash string")
    heads = chain.next_chain_position(df.filter("false"))
    got = {r.record_id: r.accepted for r in chain.append(df, heads).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_a_hot_device_streams(spark):
    """No device's log is gathered in one row, and every record of a device far longer than a batch gets its link."""
    n, heads = 30000, spark.createDataFrame([(2, 5, "h")], "device_id long, next_index long, previous_hash string")
    hot = spark.range(n).select(F.lit(1).cast("long").alias("device_id"), F.col("id").alias("pos"))
    rows = hot.unionByName(spark.createDataFrame([(2, 0), (2, 1), (None, 0)], "device_id long, pos long"))
    cores = rows.select("device_id", "pos", F.concat(F.lit("r"), "pos").alias("record_id"), F.concat(F.lit("<{index}"), F.col("pos").cast("string")).alias("prefix"), F.lit(">").alias("suffix"))
    links = chain.chain_cores(cores, heads)
    got = {(r.device_id, r.record_id): tuple(r)[2:] for r in links.collect()}
    assert len(got) == n + 3
    for device, index, head, count in ((1, 0, canonical.GENESIS, n), (2, 5, "h", 2), (None, 0, canonical.GENESIS, 1)):
        for i in range(count):
            digest = hashlib.sha256(f"<{index + i}{i}{head}>".encode()).hexdigest()
            assert got[device, f"r{i}"] == (index + i, head, digest)
            head = digest
    tried = chain.append(links.withColumn("captured_at", F.lit("t")), heads)
    assert tried.filter("accepted and sync_state = 'pending'").count() == n + 3
    for done in (links, tried):
        assert "collect_list" not in done._jdf.queryExecution().toString()


def _readings(spark, change, n=1):
    rows = []
    for p in card.patch_rows():
        rows.append((n, p[0], p[3], p[1], p[4], p[9], p[10], *map(float, change(p)), *p[15:18], 0.0))
    return spark.createDataFrame(rows, "capture_id int, patch_id string, slot int, role string, ramp_pos int, u double, v double, r double, g double, b double, ref_r double, ref_g double, ref_b double, clipped_fraction double")


def test_corrections_recover_gain_flare_and_gradient(spark):
    gain = correction.fit_corrections(_readings(spark, lambda p: (p[15] * 0.7, p[16] * 0.85, p[17] * 1.15)), "diagonal").first()
    assert [gain.matrix[i][i] for i in range(3)] == pytest.approx([1 / 0.7, 1 / 0.85, 1 / 1.15], rel=1e-6)
    flare = correction.fit_corrections(_readings(spark, lambda p: [0.9 * c + 0.04 for c in p[15:18]])).first()
    assert flare.mean_delta_e < 0.05
    side = correction.fit_corrections(_readings(spark, lambda p: [c * (1 + 0.5 * (p[9] - 0.5)) for c in p[15:18]])).first()
    assert side.field is not None
    assert side.mean_delta_e < 0.05
    flat = correction.fit_corrections(_readings(spark, lambda p: (0.2, 0.2, 0.2))).first()
    assert flat.failure == "singular-system"
    few = correction.fit_corrections(_readings(spark, lambda p: p[15:18]).withColumn("clipped_fraction", F.lit(0.9))).first()
    assert few.failure == "too-few-patches"


def test_verdict_borders(spark):
    from capturelake.functions.colour import hex_to_lab

    rows = [("marquis", *hex_to_lab("#5a2a6e")), ("marquis", *hex_to_lab("#1f4fa8")), ("simons", *hex_to_lab("#00c853"))]
    got = classify.classify(spark.createDataFrame(rows, "panel_id string, L double, a double, b double")).collect()
    assert {(r.panel_id, r.outcome_id, r.confidence, r.inconclusive_reason) for r in got} == {
        ("marquis", "marquis-purple", "moderate", None), ("marquis", None, "low", "no-reference-match"), ("simons", None, "low", "no-reference-match")
    }


def test_homography_refuses_lines():
    line = np.array([[0, 0], [1, 1], [2, 2], [3, 3]], float)
    assert geometry.fit_one(line, line) is None
    assert geometry.fit_one(line[:3], line[:3]) is None


def test_card_is_found(spark):
    """A card drawn at 4 pixels a millimetre in a larger frame, with a bright middle in its first marker."""
    w, h, k, off = 420, 280, 4, (30, 25)
    image = np.full((h, w), 0.85)
    for m, (x, y) in enumerate(card.MARKERS):
        x0, y0, half = int(off[0] + x * k), int(off[1] + y * k), 16
        image[y0 - half : y0 + half, x0 - half : x0 + half] = 0.05
        if m == 0:
            image[y0 - 5 : y0 + 5, x0 - 5 : x0 + 5] = 0.95
    y, x = np.divmod(np.arange(w * h), w)
    import pandas as pd

    frames = spark.createDataFrame(pd.DataFrame({"capture_id": 1, "x": x.astype(np.int32), "y": y.astype(np.int32), "luma": image.ravel()}))
    sizes = spark.createDataFrame([(1, w, h)], "capture_id long, width int, height int")
    got = detect.detect_cards(frames, sizes, pixels.otsu(frames)).first()
    assert got.ok, got.reason
    assert got.quad_aspect == pytest.approx(75.9 / 41, rel=0.02)
    assert got.card_coverage == pytest.approx(75.9 * 41 * 16 / (w * h), rel=0.03)


def test_cards_on_frames_and_pixels_agree(spark):
    """The same drawn frames through the frame helpers and the pixel tables."""
    from capturelake.operators import frames
    from capturelake.plans import views

    rows = []
    for v in (2, 3, 4, 5, 6, 7, 8):
        width, height, image, h = views._draw(v, [0.1, -0.3, 0.6])
        rows.append((v, width, height, bytearray(image.tobytes()), h))
    photos = spark.createDataFrame(rows, views.FRAME_SCHEMA)
    got = {r.capture_id: r for r in frames.detect_frames(photos).collect()}
    import pandas as pd

    tall = []
    for v, width, height, data, _ in rows:
        y, x = np.divmod(np.arange(width * height), width)
        luma = np.frombuffer(bytes(data), np.uint8).reshape(-1, 3) @ np.array([0.2126, 0.7152, 0.0722]) / 255
        tall.append(pd.DataFrame({"capture_id": v, "x": x.astype(np.int32), "y": y.astype(np.int32), "luma": luma.astype(np.float32).astype(float)}))
    pixel = spark.createDataFrame(pd.concat(tall))
    want = detect.detect_cards(pixel, photos.select("capture_id", "width", "height"), pixels.otsu(pixel)).collect()
    for w in want:
        g = got[w.capture_id]
        assert (g.ok, g.reason, g.candidates) == (w.ok, w.reason, w.candidates)
        assert (g.card_to_image is None) == (w.card_to_image is None)
        if g.ok:
            assert g.card_to_image == pytest.approx(w.card_to_image, abs=1e-6) and g.card_coverage == pytest.approx(w.card_coverage)
    assert {r.reason for r in want} == {None, "too-few-marker-candidates", "orientation-key-not-found", "marker-size-implausible", "no-plausible-quad"}


def test_regions_and_flat_cards_on_frames_and_pixels_agree(spark):
    from capturelake.operators import frames
    from capturelake.plans import views

    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (30, 40, 3)).astype(np.uint8)
    h = [0.4, 0.01, 2.0, 0.02, 0.45, 1.0, 0.0001, 0.0002, 1.0]
    photos = spark.createDataFrame([(1, 40, 30, bytearray(image.tobytes()), h), (2, 40, 30, bytearray(image.tobytes()), [0.0, 0.0, -5.0, 0.0, 0.0, -5.0, 0.0, 0.0, 1.0]), (3, 40, 30, bytearray(image.tobytes()), None)], views.FRAME_SCHEMA)
    y, x = np.divmod(np.arange(1200), 40)
    import pandas as pd

    flat = image.reshape(-1, 3) / 255
    one = pd.DataFrame({"x": x.astype(np.int32), "y": y.astype(np.int32), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})
    pixel = spark.createDataFrame(pd.concat([one.assign(capture_id=1), one.assign(capture_id=2)]))
    got = {(r.capture_id, r.region_id): r for r in frames.sample_regions(photos, card.sample_rows(), 6, 4).collect()}
    rects = card.sample_rects(card.card_patches(spark)).withColumnRenamed("patch_id", "region_id")
    for w in pixels.sample_regions(photos.filter("h is not null").select("capture_id", "h"), rects, pixel, 6, 4).collect():
        g = got[w.capture_id, w.region_id]
        assert g["count"] == w["count"] and g.out_fraction == pytest.approx(w.out_fraction)
        for c in ("r", "g", "b", "raw_r", "raw_g", "raw_b", "std_r", "std_g", "std_b"):
            assert g[c] == pytest.approx(w[c], abs=1e-9)
        if w["count"]:
            assert g.clipped_fraction == pytest.approx(w.clipped_fraction)
    assert {k[0] for k in got} == {1, 2} and all(r["count"] == 0 for k, r in got.items() if k[0] == 2)
    cards = {r.capture_id: r for r in frames.rectify(photos, (20, 12)).collect()}
    grey = pixel.withColumn("luma", F.col("g"))
    want = {(r.capture_id, r.x, r.y): r.luma for r in pixels.rectify(photos.filter("h is not null").select("capture_id", "h"), grey, 20, 12, card.WIDTH, card.HEIGHT).collect()}
    for (c, px, py), luma in want.items():
        assert np.frombuffer(bytes(cards[c].data), np.uint8).reshape(12, 20, 3)[py, px, 1] == round(luma * 255)
    means = pixels.region_mean_luma(spark.createDataFrame([(1, "a", "p", 0.0, 0.0), (1, "a", "q", 39.0, 29.0), (1, "b", "r", -1.0, 0.0)], "capture_id long, region_id string, point_id string, px double, py double"), grey)
    got_means = {r.region_id: r.mean_luma for r in means.collect()}
    assert got_means["a"] == pytest.approx((flat[0, 1] + flat[-1, 1]) / 2) and got_means["b"] is None


def test_blobs_of_frames_cut_over_batches(spark):
    """Blobs of many frames, labelled together and in batches of few rows, against one flood fill a frame."""
    import pandas as pd

    rng = np.random.default_rng(5)
    grids = rng.random((20, 9, 7)) < 0.45
    c, y, x = np.nonzero(np.ones(grids.shape, bool))
    pixel = spark.createDataFrame(pd.DataFrame({"capture_id": c, "x": x.astype(np.int32), "y": y.astype(np.int32), "luma": np.where(grids.ravel(), 0.1, 0.9)}))
    limits = pixel.select("capture_id").distinct().withColumn("threshold", F.lit(0.5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = detect.dark_blobs(pixel, limits).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == grids.sum()
    for k, own in got.groupby("capture_id"):
        blob = {(a, b): n for a, b, n in zip(own["x"], own["y"], own["blob_id"], strict=True)}
        seen: dict = {}
        for start in blob:
            if start in seen:
                continue
            todo = [start]
            while todo:
                p = todo.pop()
                if p in seen or p not in blob:
                    continue
                seen[p] = start
                todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert len({(blob[p], seen[p]) for p in blob}) == len(set(seen.values())) == len(set(blob.values())), k


def test_numbers_are_printed_as_by_javascript(spark):
    plain = {0.0: "0", -0.0: "0", 12.0: "12", -3.0: "-3", 0.5: "0.5", 1e-6: "0.000001", 1e-7: "1e-7", 1.5e-7: "1.5e-7", 1e21: "1e+21", 1e20: "100000000000000000000", 12345678.25: "12345678.25", 0.00005: "0.00005", 123456789012345680.0: "123456789012345680", 1.7976931348623157e308: "1.7976931348623157e+308", 0.1: "0.1", 100.0: "100", -1234.5e10: "-12345000000000"}
    df = spark.createDataFrame([(x,) for x in plain], "x double")
    assert [r[0] for r in df.select(canonical.number_text(F.col("x"))).collect()] == list(plain.values())
    fixed = {1.005: "1.00", 2.675: "2.67", 0.125: "0.13", 0.375: "0.38", 1.45: "1.45", 8.345: "8.35", 10.235: "10.23", 0.0: "0.00", 5.0: "5.00", 0.004: "0.00", 0.995: "0.99", 99.995: "100.00", 1e15: "1000000000000000"}
    df = spark.createDataFrame([(x,) for x in fixed], "x double")
    from decimal import ROUND_HALF_UP, Decimal

    got = [r[0] for r in df.select(canonical.fixed_text(F.col("x"), 2)).collect()]
    assert got == [str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP)) if x < 1e15 else "1000000000000000" for x in fixed]
    rng = np.random.default_rng(7)
    many = [float(x) for x in np.concatenate([rng.uniform(0, 100, 300), rng.integers(0, 4000, 300) / 1000, rng.integers(0, 4000, 100) / 8])]
    df = spark.createDataFrame([(x,) for x in many], "x double")
    assert [r[0] for r in df.select(canonical.fixed_text(F.col("x"), 2)).collect()] == [str(Decimal(x).quantize(Decimal("0.01"), ROUND_HALF_UP)) for x in many]


def test_rejected_and_unknown_panels_keep_their_row(spark):
    rows = [("marquis", 30.0, 30.0, -30.0), ("nonesuch", 1.0, 2.0, 3.0), (None, 1.0, 2.0, 3.0), ("simons", None, None, None)]
    df = spark.createDataFrame(rows, "panel_id string, L double, a double, b double")
    got = {r.panel_id: r for r in classify.classify(df).collect()}
    assert len(got) == 4 and got["nonesuch"].inconclusive_reason == got[None].inconclusive_reason == "unknown-panel"
    assert got["nonesuch"].ranked == [] and got["nonesuch"].category == "inconclusive" and got["nonesuch"].match_delta_e is None
    refused = {r.panel_id: r.label for r in classify.rejected_result(df.withColumn("reason", F.lit("dark"))).collect()}
    assert len(refused) == 4 and refused[None] == "Inconclusive, capture rejected: dark"


def test_every_model_and_null_readings(spark):
    """Three models against numpy's least squares; patches without a colour do not count."""
    rng = np.random.default_rng(11)
    noise = {p[0]: rng.normal(0, 0.01, 3) for p in card.patch_rows()}
    readings = _readings(spark, lambda p: [0.8 * c + 0.03 + e for c, e in zip(p[15:18], noise[p[0]], strict=True)])
    lost = readings.withColumn("g", F.when(F.col("slot") != 4, F.col("g")))
    for df, rows in ((readings, card.patch_rows()), (lost, [p for p in card.patch_rows() if p[3] != 4])):
        x = np.array([[0.8 * c + 0.03 + e for c, e in zip(p[15:18], noise[p[0]], strict=True)] for p in rows])
        y = np.array([p[15:18] for p in rows])
        for model in ("linear3x3", "affine3x4"):
            got = correction.fit_corrections(df, model, spatial=False).first()
            a = np.hstack([x, np.ones((len(x), 1))]) if model == "affine3x4" else x
            want = np.linalg.lstsq(a, y, rcond=None)[0].T
            assert np.array(got.matrix)[:, : want.shape[1]] == pytest.approx(want, rel=1e-6)
            assert got.patches_used == len(rows) and got.residual_linear == pytest.approx(np.sqrt(((a @ want.T - y) ** 2).sum(1).mean() / 3))
        got = correction.fit_corrections(df, "diagonal", spatial=False).first()
        assert [got.matrix[i][i] for i in range(3)] == pytest.approx(((x * y).sum(0) / (x * x).sum(0)).tolist())


def test_photographs_and_exports_come_back(spark, tmp_path):
    import struct
    import zlib

    def png(pixels_):
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + bytes(row.ravel().tolist()) for row in pixels_)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels_.shape[1], pixels_.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    (tmp_path / "photos").mkdir()
    (tmp_path / "photos" / "a.png").write_bytes(png(image))
    (tmp_path / "photos" / "b.png").write_bytes(b"no photograph")
    found = io.read_frames(spark, str(tmp_path / "photos"))
    assert sorted((r.width, r.height) for r in found.collect()) == [(-1, -1), (4, 2)]
    rgb = {r.error: r for r in io.rgb_frames(found).collect()}
    assert bytes(rgb[None].data) == image.tobytes() and rgb["image-size-invalid"].data is None and len(rgb) == 2
    assert sorted(r.length for r in io.read_image_bytes(spark, str(tmp_path / "photos")).collect()) == sorted(f.stat().st_size for f in (tmp_path / "photos").iterdir())
    records = spark.createDataFrame([(1, i, f'{{"b":{i},"a":"x"}}', f"2026-01-0{i + 1}T00:00:00.000Z", f"r{i}", i * 0.5) for i in range(5)], "device_id long, chain_index long, record_json string, captured_at string, record_id string, match_delta_e double")
    io.export_json(records, str(tmp_path / "json"), "now", "a note")
    back = io.read_export(spark, str(tmp_path / "json")).collect()
    assert sorted((r.record_json, r.exported_at) for r in back) == [(f'{{"a":"x","b":{i}}}', "now") for i in range(5)]
    io.export_csv(records, str(tmp_path / "csv"))
    lines = [r.value for r in spark.read.text([str(tmp_path / "csv" / "1-lines")]).collect()]
    assert sorted(lines)[0].startswith("0,r0,2026-01-01T00:00:00.000Z,") and len(lines) == 5
    io.write_records(records, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).filter("capture_date = '2026-01-03'").first().record_id == "r2"


def test_the_library_does_not_need_the_text_operators():
    import pathlib

    root = pathlib.Path(canonical.__file__).parents[1]
    for f in root.rglob("*.py"):
        assert f.is_relative_to(root / "llm") or "llm" not in f.read_text(), f


def test_bad_frames_and_exports(spark, tmp_path):
    frames = spark.createDataFrame([("a", 2, 1, 3, bytearray([1, 2, 3, 4, 5, 6])), ("b", 2, 2, 3, bytearray([1]))], "origin string, width int, height int, channels int, data binary")
    got = [tuple(r) for r in io.frames_to_pixels(frames).orderBy("origin", "x").collect()]
    assert got[:2] == [("a", 0, 0, 3, 2, 1, None), ("a", 1, 0, 6, 5, 4, None)]
    assert got[2][-1] == "image-data-misfit"
    (tmp_path / "x.json").write_text('{"exportedAt":"now","records":[{"b":1,"a":null},{"c":2}]}')
    assert [r.record_json for r in io.read_records(spark, str(tmp_path / "x.json")).orderBy("pos").collect()] == ['{"a":null,"b":1}', '{"c":2}']


def test_ramp_forms_agree(spark):
    """Inversions counted by a window and by the metrics' arrays."""
    from capturelake.operators import quality

    rng = np.random.default_rng(13)
    parts = [_readings(spark, lambda p: rng.uniform(0, 1, 3), n) for n in range(1, 6)]
    readings = parts[0]
    for more in parts[1:]:
        readings = readings.unionByName(more)
    readings = readings.withColumns({f"{k}_{c}": F.lit(0.5) for k in ("raw", "std") for c in "rgb"})
    captures = readings.select("capture_id").distinct().withColumns({f"sample_{k}_{c}": F.lit(0.5) for k in ("raw", "std") for c in "rgb"})
    metrics = quality.quality_metrics(readings, captures, correction.fit_corrections(readings))
    want = {r.capture_id: r.grey_ramp_inversions for r in quality.grey_ramp_inversions(readings).collect()}
    assert {r.capture_id: r.grey_ramp_inversions for r in metrics.collect()} == want and len(set(want.values())) > 1


def test_provenance_lookups_and_luma(spark):
    from capturelake.functions import panels
    from capturelake.operators import calibrate, log

    rows = [("p", 0, "lab-verified"), ("p", 1, "placeholder"), ("q", 0, "lab-verified"), ("r", 0, "literature")]
    df = spark.createDataFrame(rows, "panel_id string, outcome_pos int, provenance string")
    got = {r.panel_id: (r.provenance, r.needs_verification) for r in panels.panel_provenance(df).collect()}
    assert got["p"] == ("placeholder", True) and got["q"] == ("lab-verified", False) and got["r"][1]
    records = spark.createDataFrame([("a", 1), ("b", 2)], "record_id string, n int")
    assert [r.n for r in log.get(records, "b").collect()] == [2]
    assert [r.n for r in chain.verify_one(records, "a").collect()] == [1]
    level = spark.createDataFrame([(255.0, 255.0, 255.0), (100.0, 0.0, 0.0)], "r double, g double, b double").select(pixels.luma(*map(F.col, "rgb"))).collect()
    assert [x[0] for x in level] == pytest.approx([1.0, 21.26 / 255])
    frames = [(1, f, p[0], p[3], p[3], *[c + 0.001 * f for c in p[15:18]]) for f in range(3) for p in card.patch_rows()]
    readings = spark.createDataFrame(frames, "card_serial long, frame_id long, patch_id string, slot int, reading_pos int, r double, g double, b double")
    report, done = calibrate.calibration_report(readings).first(), calibrate.self_calibrate(readings).first()
    assert done.ok and report.frame_count == done.frame_count == 3
    assert (report.worst_agreement, report.mean_agreement) == (done.worst_agreement, done.mean_agreement)


def test_record_cores_leave_absent_members_out(spark):
    """A capture with the least context: null members are kept or absent as the format has it."""
    import json

    from capturelake.operators import analyse

    readings = _readings(spark, lambda p: p[15:18]).withColumns({f"{k}_{c}": F.lit(0.5) for k in ("raw", "std") for c in "rgb"})
    captures = spark.createDataFrame([(1, "d", None, 0.2, 0.2, 0.2, 100.0, 0.4, 1.8, 0.9, True, True, "r1", "t")], "capture_id int, device_id string, panel_id string, sample_r double, sample_g double, sample_b double, focus_score double, card_coverage double, quad_aspect double, orientation_contrast double, has_per_patch_references boolean, is_fully_measured boolean, record_id string, captured_at string")
    captures = captures.withColumns({f"sample_{k}_{c}": F.lit(0.1) for k in ("raw", "std") for c in "rgb"}).withColumn("long_note", F.lit("x"))
    done = analyse.analyse_captures(readings, captures)
    core = json.loads(analyse.build_record_cores(done).first().record_json)
    assert core["location"] is None and core["image"] is None and core["panelId"] is None and core["schemaVersion"] == "capture-record-1"
    assert not {"locationUnavailableReason", "rectifiedImage", "caseReference", "operatorNotes", "kitLotNumber", "cardSerial"} & set(core)
    assert core["chain"] == {"index": 0, "previousRecordHash": canonical.GENESIS} and core["operator"] == {"id": None} and core["calibrationProvenance"] == "nominal"
    rich = done.withColumns({"operator_notes": F.lit("é" * 1_200_000), "latitude": F.lit(1.5), "longitude": F.lit(-2.0), "location_unavailable_reason": F.lit("denied"), "rectified_sha256": F.lit("s"), "rectified_bytes": F.lit(3), "chain_index": F.lit(7), "previous_hash": F.lit("h")})
    core = json.loads(analyse.build_record_cores(rich).first().record_json)
    assert len(core["operatorNotes"]) == 1_200_000 and core["location"]["longitude"] == -2 and "locationUnavailableReason" not in core
    assert core["rectifiedImage"] == {"byteLength": 3, "height": None, "mimeType": None, "sha256": "s", "width": None} and core["chain"] == {"index": 7, "previousRecordHash": "h"}


def test_signatures_together(monkeypatch):
    """Both ways of checking many signatures against one at a time, and how many points one of many costs."""
    text = lambda *n: base64.urlsafe_b64encode(b"".join(x.to_bytes(32, "big") for x in n)).decode().rstrip("=")
    made = []

    def signed(secret, nonce, message):
        r = signature.point_times([(nonce, signature.G)])[0] % signature.N
        e = int.from_bytes(hashlib.sha256(message).digest(), "big")
        return r, pow(nonce, -1, signature.N) * (e + r * secret) % signature.N

    for secret, times in ((1, 3), (2, 30), (77777, 3), (signature.N - 1, 30), (5, 1)):  # the generator and its neighbours meet equal and opposite points
        key = signature.point_times([(secret, signature.G)])
        for i in range(times):
            message = f"{secret}-{i}".encode()
            r, s = signed(secret, 3 + i * i * 10**40 % signature.N, message)
            made += [(key, message, text(r, s)), (key, message + b"x", text(r, s)), (key, message, text(r, signature.N - s)), (signature.G, message, text(r, s))]
            made += [(key, message, x) for x in (text(s, r), text(0, s), text(r, signature.N), text(r + 1, s), text(r, s)[:80], "!", "é")]
    want = [signature.verify(*row) for row in made[::7]]
    assert any(want) and not all(want)
    assert signature.verify_many(made)[::7] == want
    monkeypatch.setattr(signature, "_library", lambda: None)
    assert signature.verify_many(made) == signature.verify_together(made)
    assert signature.verify_together(made)[::7] == want
    key, sums, plain = signature.point_times([(99, signature.G)]), [], signature.added
    rows = [(key, b"%d" % i, text(i + 1, i + 2)) for i in range(3000)]
    signature.verify_together(rows[:30])
    monkeypatch.setattr(signature, "added", lambda a, b: (sums.append(len(a)), plain(a, b))[1])
    signature.verify_together(rows)
    assert sum(sums) < 60 * len(rows)
    assert signature.verify_many([]) == []


def test_hashed_text_is_read_once(spark):
    """The sound text is a column of its own: its check stands once in the plan of the hashes."""
    df = spark.createDataFrame([("{",), ('{"a":1}',)], "record_json string")
    plan = canonical.with_hashes(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SchemaOfVariant") == 1


def test_halves_of_levels_round_up():
    from capturelake.operators import frames

    middle = [0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    for low in (0, 2, 100, 253):
        flat, there = frames._flat(np.array([[[low] * 3, [low + 1] * 3]], np.uint8), middle, (1, 1))
        assert flat.tolist() == [[[low + 1] * 3]] and there.all()


def test_backgrounds_make_no_marks():
    """Pictures without a card have no candidates, whatever their values; those of row 6354 of a larger table once made fourteen."""
    from capturelake.operators import photos
    from capturelake.plans import views

    real = [170, 170, 169, 170, 170, 170, 170, 169, 170, 169, 170, 170, 170, 169, 169, 169, 169, 170, 170, 170, 171, 170, 169, 170, 170, 170, 170, 170, 170, 170, 170, 169]
    real += [171, 170, 170, 171, 170, 170, 171, 171, 170, 170, 170, 170, 169, 170, 170, 171, 170, 169, 171, 170, 170, 170, 170, 170, 170, 170, 170, 170, 169, 170, 169, 170]
    rng = np.random.default_rng(5)
    for values in ([(x - 170) / 4 for x in real], *(rng.normal(0, s, 64).tolist() for s in (0.05, 0.13, 0.3, 1.0))):
        assert photos.find_card(views._draw(6354, values)[2])[:2] == ("too-few-marker-candidates", 0)


def test_fours_and_labels_against_plain_versions(spark):
    """Best fours of captures of 0 to 9 candidates against each four by itself, without joins; labels against flood fill."""
    import math
    from itertools import combinations

    rng = np.random.default_rng(11)
    rows, want = [], {}
    for capture in range(60):
        own = [(capture, i + 1, int(a), float(x), float(y), 0.5) for i, (a, x, y) in enumerate(zip(*(rng.integers(lo, hi, capture % 10) for lo, hi in ((20, 60), (0, 60), (0, 40))), strict=True))]
        rows += own
        for four in combinations(own, 4):
            p = [(x * 2, y * 2, i, a * 4.0) for _, i, a, x, y, _ in four]
            mx, my = sum(c[0] for c in p) / 4, sum(c[1] for c in p) / 4
            p.sort(key=lambda c: (math.atan2(c[1] - my, c[0] - mx), c[0], c[1], c[2]))
            d = [(p[(k + 1) % 4][0] - p[k][0], p[(k + 1) % 4][1] - p[k][1]) for k in range(4)]
            turn = [d[k][0] * d[(k + 1) % 4][1] - d[k][1] * d[(k + 1) % 4][0] for k in range(4)]
            s, areas = [math.hypot(*x) for x in d], [c[3] for c in p]
            far, near = max(s[0] + s[2], s[1] + s[3]) / 2, min(s[0] + s[2], s[1] + s[3]) / 2
            if (max(turn) >= 1e-9) != (min(turn) <= -1e-9) and max(areas) <= 4 * min(areas) and near > 0 and 0.9 <= far / near <= 3.6:
                score = 3 * abs(math.log(far / near / detect.MARKER_ASPECT)) + 2 * (abs(s[0] - s[2]) + abs(s[1] - s[3])) / far + math.log(max(areas) / min(areas)) - 0.35 * math.log(far * near)
                want.setdefault(capture, []).append((score, [c[2] for c in p]))
    df = spark.createDataFrame(rows, "capture_id long, i int, area long, cx double, cy double, scale double").repartition(3)
    done = detect.candidate_quads(df)
    assert "Join" not in done._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(done.collect()):
        got.setdefault(r.capture_id, []).append((r.score, [c.i for c in r.corners]))
    assert got.keys() == want.keys() and max(map(len, want.values())) > 40
    for capture, fours in want.items():
        fours = sorted(fours)[:40]
        assert [s for s, _ in got[capture]] == pytest.approx([s for s, _ in fours]) and got[capture][0][1] == fours[0][1]
    for k in range(60):
        mask = rng.random(rng.integers(1, 25, 2)) < k / 60
        y, x = np.nonzero(mask)
        label = dict(zip(zip(y.tolist(), x.tolist(), strict=True), detect.labels(x, y).tolist(), strict=True))
        seen, parts = set(), []
        for start in label:
            stack = [] if start in seen else [start]
            seen.update(stack)
            parts += [label[start]] if stack else []
            while stack:
                a, b = stack.pop()
                assert label[a, b] == label[start]
                more = [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (a + i, b + j) in label and (a + i, b + j) not in seen]
                seen.update(more)
                stack += more
        assert parts == sorted(set(parts))


def test_pictures_are_made_by_many_tasks(spark):
    from capturelake.plans import views
    from tests.conftest import SF

    for frames in (views.v_frames(spark, SF), views.v_order_frames(spark, SF)):
        assert frames.select(F.spark_partition_id()).distinct().count() > 1
    places = {r.capture_id: r for r in views.v_places(spark, SF).collect()}
    drawn = views.v_frames(spark, SF).drop("data").collect()
    assert len(drawn) == len(places) and all(r == places[r.capture_id] for r in drawn)


def test_readings_are_made_by_many_tasks(spark):
    """Readings lie by capture where they are made: they are dealt once, as events, and the fit aggregates them there."""
    from capturelake.plans import views
    from tests.conftest import SF

    readings = views.v_readings(spark, SF)
    assert readings.select(F.spark_partition_id()).distinct().count() > 1
    plan = correction.fit_corrections(readings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(event_id" in plan
