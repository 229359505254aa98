"""Registered queries over the derived views, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.functions import canonical, card, colour, geometry, panels, signature
from capturelake.operators import analyse, audit, calibrate, chain, classify, correction, detect, frames, log, photos, pixels, quality
from capturelake.plans import sql, views
from capturelake.shared import kept, shared_folder
from capturelake.sources import io
from capturelake.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c, name: str):
    """A measure to six places, without a negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def hashed(*cells):
    return F.sha2(F.concat_ws("|", *cells), 256)


# Colour


@query(f"""
with c as (select l_orderkey, l_linenumber, ((l_partkey*37+l_linenumber*11)%256)::double as r8, ((l_suppkey*53+l_linenumber*7)%256)::double as g8, (l_orderkey%256)::double as b8 from lineitem),
l as (select *, {sql.linear_of("(r8/255)")} as r, {sql.linear_of("(g8/255)")} as g, {sql.linear_of("(b8/255)")} as b from c),
x as (select l_orderkey, l_linenumber, r8, g8, b8, r, g, b, {sql.xyz_of("r", "g", "b", "q")} from l),
s as (select *, {sql.lab_of("qx", "qy", "qz", "w")} from x)
select l_orderkey, l_linenumber, {sql.r6("wl", "lab_l")}, {sql.r6("wa", "lab_a")}, {sql.r6("wb", "lab_b")}, {sql.r6("sqrt(wa*wa+wb*wb)", "chroma")},
       {sql.r6("0.2126*r+0.7152*g+0.0722*b", "luminance")}, printf('#%02x%02x%02x', r8::int, g8::int, b8::int) as hex from s
""")
def colour_conversions(spark, sf_dir):
    df = views.v_colours(spark, sf_dir)
    rgb = tuple(colour.rgb8_to_rgb(F.col(c)) for c in ("r8", "g8", "b8"))
    df = df.withColumns({c: colour.srgb_to_linear(x) for c, x in zip("rgb", rgb, strict=True)})
    linear = tuple(map(F.col, "rgb"))
    df = df.withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), colour.linear_rgb_to_lab(linear), strict=True)))
    lch = colour.lab_to_lch((F.col("lab_l"), F.col("lab_a"), F.col("lab_b")))
    return df.select("l_orderkey", "l_linenumber", *(r6(F.col(c), c) for c in ("lab_l", "lab_a", "lab_b")), r6(lch[1], "chroma"), r6(colour.relative_luminance(linear), "luminance"), colour.rgb_to_hex(rgb).alias("hex"))


@query("""
select l_orderkey, l_linenumber, (l_partkey*37+l_linenumber*11)%256 as r8, (l_suppkey*53+l_linenumber*7)%256 as g8, l_orderkey%256 as b8,
       1 as adapted_back from lineitem
""")
def colour_round_trips(spark, sf_dir):
    """sRGB to Lab, LCh, D50 and back again gives the same 8-bit levels."""
    df = views.v_colours(spark, sf_dir)
    lab = colour.srgb_to_lab(tuple(colour.rgb8_to_rgb(F.col(c)) for c in ("r8", "g8", "b8")))
    df = df.withColumns(dict(zip(("L", "a", "b"), colour.lch_to_lab(colour.lab_to_lch(lab)), strict=True)))
    xyz = colour.lab_to_xyz(tuple(map(F.col, ("L", "a", "b"))))
    back = colour.adapt_xyz(colour.adapt_xyz(xyz, colour.D65, colour.D50), colour.D50, colour.D65)
    near = F.greatest(*(F.abs(x - y) for x, y in zip(xyz, back, strict=True))) < 1e-9
    out = colour.lab_to_srgb(tuple(map(F.col, ("L", "a", "b"))))
    return df.select("l_orderkey", "l_linenumber", *(colour.rgb_to_rgb8(c).cast("long").alias(n) for c, n in zip(out, ("r8", "g8", "b8"), strict=True)), near.cast("int").alias("adapted_back"))


@query(f"""
with p as (select event_id, (event_id*7%101)::double as l1, (event_id*13%161-80)::double as a1, (event_id*29%171-85)::double as b1,
           (event_id*11%101)::double as l2, (event_id*17%161-80)::double as a2, (event_id*31%171-85)::double as b2 from events),
d as (select *, sqrt(a1*a1+b1*b1) as k1, sqrt(a2*a2+b2*b2) as k2, {sql.de2000("l1", "a1", "b1", "l2", "a2", "b2", "de")} from p)
select event_id, {sql.r6("de", "de_2000")}, {sql.r6("sqrt(pow(l1-l2,2)+pow(a1-a2,2)+pow(b1-b2,2))", "de_76")},
       {sql.r6("sqrt(pow(l1-l2,2)+pow((k1-k2)/(1+0.045*k1),2)+greatest(0.0,pow(a1-a2,2)+pow(b1-b2,2)-pow(k1-k2,2))/pow(1+0.015*k1,2))", "de_94")},
       case when de < 1 then 'indistinguishable to the eye' when de < 2 then 'only visible on close comparison' when de < 5 then 'noticeable difference'
            when de < 10 then 'clearly different' else 'very different' end as words from d
""")
def colour_differences(spark, sf_dir):
    df = views.v_colour_pairs(spark, sf_dir)
    one, two = tuple(map(F.col, ("L1", "a1", "b1"))), tuple(map(F.col, ("L2", "a2", "b2")))
    df = colour.with_delta_e_2000(df, one, two, "de")
    return df.select("event_id", r6(F.col("de"), "de_2000"), r6(colour.delta_e_76(one, two), "de_76"), r6(colour.delta_e_94(one, two), "de_94"), colour.describe_delta_e(F.col("de")).alias("words"))


# Panels and verdicts


@query(f"""
with {sql.RANKED}
select panel_id, case when reason is null then c1 else 'inconclusive' end as category, count(*) as samples, {sql.r6("avg(match_delta_e)", "mean_match")} from verdicts group by 1, 2
""")
def verdict_counts(spark, sf_dir):
    done = classify.classify(views.v_samples(spark, sf_dir))
    return done.groupBy("panel_id", "category").agg(F.count("*").alias("samples"), r6(F.avg("match_delta_e"), "mean_match"))


@query(f"""
with {sql.RANKED}
select event_id, panel_id, case when reason is null then o1 end as outcome_id, case when reason is null then c1 else 'inconclusive' end as category,
       case when reason is not null then 'low' when match_delta_e <= 8 and separation_delta_e >= 20 then 'high' when match_delta_e <= 16 and separation_delta_e >= 12 then 'moderate' else 'low' end as confidence,
       {sql.r6("match_delta_e", "match_delta_e")}, {sql.r6("separation_delta_e", "separation_delta_e")}, reason as inconclusive_reason,
       case when reason = 'ambiguous-between-outcomes' then o1 || ',' || o2 end as between_outcomes from verdicts
""")
def classify_samples(spark, sf_dir):
    done = classify.classify(views.v_samples(spark, sf_dir))
    return done.select("event_id", "panel_id", "outcome_id", "category", "confidence", r6(F.col("match_delta_e"), "match_delta_e"), r6(F.col("separation_delta_e"), "separation_delta_e"), "inconclusive_reason", F.array_join("ambiguous_between", ",").alias("between_outcomes"))


@query(f"with {sql.RANKED} select event_id, outcome_id, rank, {sql.r6('d', 'delta_e')} from ranked")
def rank_outcomes(spark, sf_dir):
    done = classify.with_ranking(views.v_samples(spark, sf_dir)).select("event_id", F.posexplode("ranked").alias("p", "o"))
    return done.select("event_id", F.col("o.outcome_id").alias("outcome_id"), (F.col("p") + 1).cast("long").alias("rank"), r6(F.col("o.delta_e"), "delta_e"))


@query(f"""
with {sql.OUTCOMES}, pairs as (select a.panel_id, a.outcome_id as x, b.outcome_id as y, a.outcome_pos as i, b.outcome_pos as j, {sql.de2000("a.l", "a.a", "a.b", "b.l", "b.a", "b.b", "d")}
from outcomes a join outcomes b on a.panel_id = b.panel_id and a.outcome_pos < b.outcome_pos),
near as (select *, row_number() over (partition by panel_id order by d, i, j) as nth from pairs),
used as (select panel_id, count(*) as n from (select event_id, {sql.PANEL_LIST}[(user_id%4)::int+1] as panel_id from events) group by 1)
select n.panel_id, x as first, y as second, {sql.r6("d", "closest_delta_e")}, d > 8 as separable, true as sound, u.n as samples from near n join used u using (panel_id) where nth = 1
""")
def panel_separations(spark, sf_dir):
    """Separation and data checks of the panels that the samples use, with the number of those."""
    outcomes = panels.panel_outcomes(spark)
    used = views.v_samples(spark, sf_dir).groupBy("panel_id").agg(F.count("*").alias("samples"))
    checks = panels.panel_data_checks(outcomes).select("panel_id", (F.col("ids_unique") & F.col("one_negative") & F.col("accepts_apart")).alias("sound"))
    found = panels.panel_separation(outcomes).join(checks, "panel_id").join(used, "panel_id")
    return found.select("panel_id", "first", "second", r6(F.col("closest_delta_e"), "closest_delta_e"), "separable", "sound", "samples")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_counts(spark, sf_dir)


# Corrections and gates

READINGS = sql.readings(views.GAINS)
USABLE = "clipped_fraction <= 0.2"


def _sums(prefix: str, gain: str) -> str:
    x = {"r": f"(r/{gain})", "g": f"(g/{gain})", "b": f"(b/{gain})", "o": "1.0::double"}
    n = list(x)
    parts = [f"sum({x[p]}*{x[q]}) filter (where {USABLE}) as {prefix}_{p}{q}" for i, p in enumerate(n) for q in n[i:]]
    parts += [f"sum({x[p]}*ref_{t}) filter (where {USABLE}) as {prefix}_{p}y{t}" for p in n for t in "rgb"]
    return ", ".join(parts)


def _cell(prefix: str):
    n = "rgbo"
    return lambda i, j: f"{prefix}_{n[min(i, j)]}{n[max(i, j)]}"


def _fit_sql() -> str:
    lum = "(0.2126*ref_r+0.7152*ref_g+0.0722*ref_b)"
    terms = {"p": lum, "q": f"{lum}*u", "s": f"{lum}*v", "y": "(0.2126*r+0.7152*g+0.0722*b)"}
    names = list(terms)
    neutral = f"role = 'neutral' and {USABLE} and {lum} >= 0.02"
    field = ", ".join(f"sum({terms[a]}*{terms[b]}) filter (where {neutral}) as f_{a}{b}" for i, a in enumerate(names[:3]) for b in names[i:])
    fs, fdone = sql.solve("fs", 3, lambda i, j: f"f_{names[min(i, j)]}{names[max(i, j)]}", [lambda i: f"f_{names[i]}y"], "fsum")
    side = lambda p: [lambda i, t=t: f"{p}_{'rgbo'[i]}y{t}" for t in "rgb"]
    ps, pdone = sql.solve("ps", 4, _cell("p"), side("p"), "psum")
    ss, sdone = sql.solve("ss", 4, _cell("s"), side("s"), "ssum")
    m = lambda pre, gain: ", ".join(
        f"({pre}x{k}_0*r/{gain}+{pre}x{k}_1*g/{gain}+{pre}x{k}_2*b/{gain}+{pre}x{k}_3) as {pre}{c}" for k, c in enumerate("rgb")
    )
    lab = lambda pre: f"{sql.xyz_of(pre + 'r', pre + 'g', pre + 'b', pre + 'q')}, {sql.lab_of(pre + 'qx', pre + 'qy', pre + 'qz', pre + 'w')}"
    pick = lambda x: ", ".join(f"{x}x{k}_{i}" for k in range(3) for i in range(4))
    return f"""{READINGS},
fsum as (select capture_id, count(*) filter (where {neutral}) as fn, count(*) filter (where {USABLE}) as usable, {field} from readings group by 1), {fs},
fc as (select *, fsx0_0+0.5*fsx0_1+0.5*fsx0_2 as centre from {fdone}),
fields as (select capture_id, usable, fsx0_0 as c0, fsx0_1 as cu, fsx0_2 as cv, centre, (abs(fsx0_1)+abs(fsx0_2))/centre as strength,
    coalesce(fn >= 4 and centre > 1e-6 and (abs(fsx0_1)+abs(fsx0_2))/centre >= 0.04, false) as has_field, least(3, greatest(0.33, (fsx0_0+0.5*fsx0_1+26.5/54::double*fsx0_2)/centre)) as window_gain from fc),
rows1 as (select r.*, f.usable, f.strength, f.has_field, f.window_gain, case when f.has_field and f.strength <= 1 then least(3, greatest(0.33, (c0+cu*u+cv*v)/centre)) else 1.0 end as gain
    from readings r join fields f using (capture_id)),
psum as (select capture_id, {_sums("p", "1.0")} from rows1 group by 1), {ps},
ssum as (select capture_id, {_sums("s", "gain")} from rows1 group by 1), {ss},
rows2 as (select r.*, {pick("ps")}, {pick("ss")} from rows1 r join {pdone} p using (capture_id) join {sdone} s using (capture_id)),
rows3 as (select *, {m("ps", "1.0")}, {m("ss", "gain")}, {sql.xyz_of("ref_r", "ref_g", "ref_b", "tq")} from rows2),
rows4 as (select *, {lab("ps")}, {lab("ss")}, {sql.lab_of("tqx", "tqy", "tqz", "tw")} from rows3),
rows5 as (select *, {sql.de2000("twl", "twa", "twb", "pswl", "pswa", "pswb", "pd")}, {sql.de2000("twl", "twa", "twb", "sswl", "sswa", "sswb", "sd")} from rows4),
means as (select capture_id, avg(pd) filter (where {USABLE}) as pmean, avg(sd) filter (where {USABLE}) as smean from rows5 group by 1),
fits as (select r.*, pmean, smean, has_field and strength <= 1 and smean < pmean as used, case when has_field and strength <= 1 and smean < pmean then sd else pd end as delta_e,
    {", ".join(f"case when has_field and strength <= 1 and smean < pmean then ssx{k}_{i} else psx{k}_{i} end as m{k}{i}" for k in range(3) for i in range(4))}
    from rows5 r join means using (capture_id))"""


FITS = _fit_sql()


@query(f"""
with {FITS}
select capture_id, any_value(usable) as patches_used, {sql.r6(f"avg(delta_e) filter (where {USABLE})", "mean_delta_e")}, {sql.r6(f"max(delta_e) filter (where {USABLE})", "max_delta_e")},
       {sql.r6("any_value(m00)", "m00")}, {sql.r6("any_value(m11)", "m11")}, {sql.r6("any_value(m22)", "m22")}, {sql.r6("any_value(m03)", "m03")}, {sql.r6("any_value(case when used then strength end)", "strength")},
       any_value(case when has_field and not used then case when strength > 1 then 'implausible-magnitude' else 'did-not-improve-fit' end end) as rejected,
       {sql.r6("greatest(abs(any_value(m00)),abs(any_value(m11)),abs(any_value(m22)))/least(abs(any_value(m00)),abs(any_value(m11)),abs(any_value(m22)))", "cast_ratio")}
from fits group by capture_id
""")
def fit_corrections(spark, sf_dir):
    done = correction.fit_corrections(views.v_readings(spark, sf_dir))
    at = lambda i, j: F.get(F.get("matrix", F.lit(i)), F.lit(j))
    return done.select("capture_id", "patches_used", r6(F.col("mean_delta_e"), "mean_delta_e"), r6(F.col("max_delta_e"), "max_delta_e"), *(r6(at(i, j), f"m{i}{j}") for i, j in ((0, 0), (1, 1), (2, 2), (0, 3))), r6(F.col("field.strength"), "strength"), F.col("field_rejected.reason").alias("rejected"), r6(correction.cast_ratio(F.col("matrix")), "cast_ratio"))


@query(f"with {FITS} select capture_id, patch_id, {sql.r6('delta_e', 'delta_e')}, {USABLE} as used_in_fit from fits")
def fit_residuals(spark, sf_dir):
    done = correction.fit_corrections(views.v_readings(spark, sf_dir)).select("capture_id", F.explode("residuals").alias("x"))
    return done.select("capture_id", "x.patch_id", r6(F.col("x.delta_e"), "delta_e"), "x.used_in_fit")


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = views.v_samples(spark, sf_dir)
    linear = colour.lab_to_linear_rgb((F.col("L"), F.col("a"), F.col("b")))
    gain = [F.get(F.array(*(F.lit(g[i]) for g in views.GAINS)), (e % 5).cast("int")) for i in range(3)]
    return rows.select(
        e.alias("capture_id"), F.col("user_id").alias("device_id"), F.when(e % 89 == 0, "no-such-panel").otherwise(F.col("panel_id")).alias("panel_id"), *((c * g).alias(f"sample_{n}") for c, g, n in zip(linear, gain, "rgb", strict=True)),
        (e % 300 * 1.0 + 2).alias("focus_score"), ((e % 97) / 200.0).alias("card_coverage"), (1.1 + (e % 19) / 10.0).alias("quad_aspect"), ((e % 11) / 12.0).alias("orientation_contrast"),
        *(F.lit(0.5).alias(f"sample_raw_{c}") for c in "rgb"), *(((e % 29) / 60.0).alias(f"sample_std_{c}") for c in "rgb"),
        (e % 3 == 0).alias("has_per_patch_references"), (e % 6 == 0).alias("is_fully_measured"), (e % 101 != 0).alias("detection_ok"),
        F.concat(F.lit("rec-"), e.cast("string")).alias("record_id"), F.lit("2026-01-01T00:00:00.000Z").alias("captured_at"), F.when(e % 4 == 0, F.concat(F.lit("case "), e.cast("string"))).alias("case_reference"),
        F.lit("no-card").alias("detection_reason"), F.concat(F.lit("op-"), (F.col("user_id") % 9).cast("string")).alias("operator_id"), F.when(e % 5 == 0, F.concat(F.lit('Op "'), F.col("user_id").cast("string"), F.lit('"'))).alias("operator_name"),
        F.lit("web").alias("platform"), F.lit(330).alias("utc_offset_minutes"), F.when(e % 3 == 0, 12.0).alias("latitude"), F.when(e % 3 == 0, e.cast("double")).alias("longitude"), F.when(e % 3 == 0, 2.5).alias("accuracy_m"),
        F.lit("denied").alias("location_unavailable_reason"), F.col("user_id").alias("card_serial"), F.sha2(e.cast("string"), 256).alias("image_sha256"), e.alias("image_bytes"), F.lit("image/png").alias("image_type"),
        F.lit(1200).alias("image_width"), F.lit(800).alias("image_height"),
    )


def _quality_readings(spark, sf_dir):
    e, slot = F.col("capture_id"), F.col("slot")
    spread = ((e * 3 + slot) % 40) / 80.0
    return views.v_readings(spark, sf_dir).withColumns({f"raw_{c}": F.lit(1.0) for c in "rgb"} | {f"std_{c}": spread for c in "rgb"})


QUALITY = f"""lum as (select *, 0.2126*r+0.7152*g+0.0722*b as y from fits),
ramp as (select capture_id, y > lag(y) over (partition by capture_id order by ramp_pos) + 0.006 as up from lum where ramp_pos is not null),
inv as (select capture_id, count(*) filter (where up) as n from ramp group by 1),
met as (select capture_id, avg(clipped_fraction) as mc, max(clipped_fraction) as xc, max(y) filter (where ramp_pos is not null) as white, min(y) filter (where ramp_pos is not null) as black, max(((capture_id*3+slot)%40)/80.0) as spread,
    avg(delta_e) filter (where {USABLE}) as md, max(delta_e) filter (where {USABLE}) as xd, any_value(case when used then strength end) as grad, any_value(has_field and not used) as rej, any_value(strength) as st,
    greatest(abs(any_value(m00)),abs(any_value(m11)),abs(any_value(m22)))/least(abs(any_value(m00)),abs(any_value(m11)),abs(any_value(m22))) as cast_r from lum group by 1),
g as (select m.*, i.n as inversions, m.capture_id%300*1.0+2 as focus, (m.capture_id%97)/200.0 as cov, 1.1+(m.capture_id%19)/10.0 as asp, (m.capture_id%11)/12.0 as oc, ((m.capture_id%29)/60.0)/0.5 as sspread,
    case when m.capture_id%3=0 then 4 else 8 end as ml, case when m.capture_id%3=0 then 9 else 16 end as xl from met m join inv i using (capture_id)),
codes as (select capture_id, focus, cov, grad, xd, mc, white, inversions, md, cast_r, list_filter([
    case when focus < 8 then 'out-of-focus!' end, case when cov < 0.06 then 'card-too-small!' end, case when mc > 0.12 or xc > 0.6 then 'overexposed!' end, case when white < 0.06 then 'underexposed!' end,
    case when spread > 0.45 then 'uneven-patch-illumination' end, case when asp < 1.15 or asp > 2.9 then 'card-too-oblique!' end, case when oc < 0.3 then 'weak-orientation-marker' end, case when inversions > 0 then 'grey-ramp-out-of-order!' end,
    case when md > ml or xd > xl then 'correction-poor-fit' end, case when md <= ml and xd > 2*md and xd > 8 then 'patch-fits-poorly' end, case when cast_r > 2.5 then 'extreme-colour-cast' end,
    case when rej then 'illumination-fit-discarded' end, case when not rej and grad > 0.35 then 'uneven-lighting-across-card' end, case when sspread > 0.45 then 'sample-area-not-uniform' end, case when capture_id%6<>0 then 'calibration-not-measured' end], lambda x: x is not null) as found from g)"""


@query(f"""
with {FITS}, {QUALITY}
select capture_id, array_to_string(found, ',') as issues, len(list_filter(found, lambda x: x like '%!')) = 0 as capture_ok, replace(list_filter(found, lambda x: x like '%!')[1], '!', '') as primary_rejection,
       {sql.r6("mc", "mean_patch_clipping")}, {sql.r6("white", "brightest_neutral")}, inversions as grey_ramp_inversions, {sql.r6("cast_r", "cast_ratio")} from codes
""")
def quality_gates(spark, sf_dir):
    readings = _quality_readings(spark, sf_dir)
    fits = correction.fit_corrections(readings)
    done = quality.quality_issues(quality.quality_metrics(readings, _captures(spark, sf_dir), fits))
    codes = F.array_join(F.transform("issues", lambda x: F.concat(x["code"], F.when(x["severity"] == "reject", "!").otherwise(""))), ",")
    return done.select("capture_id", codes.alias("issues"), "capture_ok", "primary_rejection", r6(F.col("mean_patch_clipping"), "mean_patch_clipping"), r6(F.col("brightest_neutral"), "brightest_neutral"), F.col("grey_ramp_inversions").cast("long").alias("grey_ramp_inversions"), r6(F.col("cast_ratio"), "cast_ratio"))


PANELS_OF = f"(select distinct panel_id, panel_name from (values {', '.join(f'({sql.text(o[0])}, {sql.text(o[1])})' for o in dict.fromkeys((x[0], x[1]) for x in panels.OUTCOMES))}) t(panel_id, panel_name))"
ANALYSED = f"""{FITS}, {QUALITY}, {sql.SAMPLES},
mats as (select capture_id, any_value(case when used then window_gain else 1.0 end) as wg, {", ".join(f"any_value(m{k}{i}) as m{k}{i}" for k in range(3) for i in range(4))} from fits group by 1),
light as (select event_id, user_id, case when event_id%89=0 then 'no-such-panel' else panel_id end as panel_id, {sql.linear_of_lab("l", "a", "b", "q")} from samples),
seen as (select e.*, {", ".join(f"(m{k}0*qr*{sql.GAIN(0, views.GAINS)}+m{k}1*qg*{sql.GAIN(1, views.GAINS)}+m{k}2*qb*{sql.GAIN(2, views.GAINS)})/wg+m{k}3 as s{c}" for k, c in enumerate("rgb"))} from light e join mats m on m.capture_id = e.event_id),
labs0 as (select event_id, user_id, panel_id, {sql.xyz_of("sr", "sg", "sb", "v")} from seen), labs as (select *, {sql.lab_of("vx", "vy", "vz", "z")} from labs0),
near0 as (select s.event_id, o.outcome_id, o.outcome_pos, o.label, o.category, o.max_match, o.min_separation, {sql.de2000("o.l", "o.a", "o.b", "s.zl", "s.za", "s.zb", "nd")} from labs s join outcomes o using (panel_id)),
near as (select *, row_number() over (partition by event_id order by nd, outcome_pos) as nth from near0),
tops as (select event_id, min(max_match) as mm, min(min_separation) as ms, min(nd) filter (where nth=1) as d1, min(nd) filter (where nth=2) as d2, min(outcome_id) filter (where nth=1) as o1,
    min(category) filter (where nth=1) as c1, min(label) filter (where nth=1) as l1 from near group by 1),
judged as (select s.event_id, s.user_id, s.panel_id, zl, za, zb, d1, d2-d1 as gap, case when d1 is null then 'unknown-panel' when d1 > mm then 'no-reference-match' when d2-d1 < ms then 'ambiguous-between-outcomes' end as why, o1, c1, l1,
    k.found, focus, cov, grad, cast_r, md, xd, replace(list_filter(found, lambda x: x like '%!')[1], '!', '') as gate,
    case when s.event_id%101=0 then 'detection' when len(list_filter(found, lambda x: x like '%!')) > 0 then 'quality' else 'complete' end as stage
    from labs s left join tops t using (event_id) join codes k on k.capture_id = s.event_id),
analysed as (select *, stage = 'complete' as accepted, case when stage = 'complete' and why is null then c1 else 'inconclusive' end as final_category, case when stage = 'complete' and why is null then o1 end as final_outcome,
    case when stage <> 'complete' or why is not null then 'low' when d1 <= 8 and gap >= 20 then 'high' when d1 <= 16 and gap >= 12 then 'moderate' else 'low' end as final_confidence,
    case when stage = 'detection' then 'no-card' when stage = 'quality' then gate end as rejection,
    case when stage <> 'complete' then 'capture-rejected' else why end as final_reason,
    case when stage <> 'complete' then 'Inconclusive, capture rejected: ' || case when stage = 'detection' then 'no-card' else gate end when why is null then l1
        when why = 'unknown-panel' then 'Inconclusive: no such reagent panel' when why = 'no-reference-match' then 'Inconclusive: colour does not match any reference for this reagent' else 'Inconclusive: colour falls between two reference outcomes' end as final_label
    from judged)"""


@query(f"""
with {ANALYSED} select event_id as capture_id, stage, accepted, final_category as category, final_outcome as outcome_id, final_confidence as confidence, final_label as label, {sql.r6("case when accepted then d1 end", "match_delta_e")} from analysed
""")
def analyse_captures(spark, sf_dir):
    done = analyse.analyse_captures(_quality_readings(spark, sf_dir), _captures(spark, sf_dir))
    return done.select("capture_id", "stage", "accepted", "category", "outcome_id", "confidence", "label", r6(F.when(F.col("accepted"), F.col("match_delta_e")), "match_delta_e"))


def _json(*members) -> str:
    """SQL text of a JSON object: (name, SQL of its JSON text, keep nulls), in order."""
    parts = [f"coalesce('\"{n}\":' || {v}, {sql.text(chr(34) + n + chr(34) + ':null') if keep else 'null'})" for n, v, keep in sorted(members)]
    return "('{' || array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x is not null), ',') || '}')"


def _quoted(v: str) -> str:
    return f"('\"' || replace({v}, '\"', '\\\"') || '\"')"


def _measure(v: str, places: int) -> str:
    whole = f"(floor(({v})*1e{places}+0.5)/1e{places})"
    return f"(case when isfinite({v}) then regexp_replace(({whole}+0.0)::double::varchar, '\\.0$', '') end)"


_RESULT = _json(
    ("category", _quoted("final_category"), True), ("outcomeId", _quoted("final_outcome"), True), ("label", _quoted("final_label"), True), ("confidence", _quoted("final_confidence"), True),
    ("matchDeltaE", _measure("case when accepted then d1 end", 4), True), ("separationDeltaE", _measure("case when accepted then gap end", 4), True), ("inconclusiveReason", _quoted("final_reason"), False),
    ("referenceProvenance", "case when panel_name is not null then '\"placeholder\"' end", True), ("referenceNeedsVerification", "case when panel_name is not null then 'true' end", True), ("requiresLaboratoryConfirmation", "'true'", True),
)
_MEASUREMENT = _json(
    ("sampleLab", _json(("L", _measure("zl", 4), True), ("a", _measure("za", 4), True), ("b", _measure("zb", 4), True)), True), ("correctionModel", "'\"affine3x4\"'", True), ("correctionMeanDeltaE", _measure("md", 4), True),
    ("correctionMaxDeltaE", _measure("xd", 4), True), ("focusScore", _measure("focus", 3), True), ("cardCoverage", _measure("cov", 5), True), ("illuminationGradientStrength", _measure("grad", 4), True), ("colourCastRatio", _measure("cast_r", 4), True),
)
_CORE = _json(
    ("schemaVersion", "'\"capture-record-1\"'", True), ("recordId", _quoted("'rec-' || event_id"), True), ("capturedAt", "'\"2026-01-01T00:00:00.000Z\"'", True), ("utcOffsetMinutes", "'330'", True),
    ("operator", _json(("id", _quoted("'op-' || user_id%9"), True), ("displayName", _quoted("case when event_id%5=0 then 'Op \"' || user_id || '\"' end"), False)), True),
    ("device", _json(("id", _quoted("user_id::varchar"), True), ("publicKeyFingerprint", "'null'", True), ("platform", "'\"web\"'", False)), True),
    ("location", f"case when event_id%3=0 then {_json(('latitude', chr(39) + '12' + chr(39), True), ('longitude', _measure('event_id', 0), True), ('accuracyMetres', chr(39) + '2.5' + chr(39), True), ('altitudeMetres', chr(39) + 'null' + chr(39), True), ('fixedAt', chr(39) + 'null' + chr(39), True))} end", True),
    ("locationUnavailableReason", "case when event_id%3<>0 then '\"denied\"' end", False), ("panelId", _quoted("panel_id"), True), ("panelName", _quoted("panel_name"), True),
    ("caseReference", _quoted("case when event_id%4=0 then 'case ' || event_id end"), False), ("cardSpecVersion", "'\"card-3\"'", True), ("cardSerial", _quoted("user_id::varchar"), False), ("calibrationProvenance", "'\"nominal\"'", True),
    ("captureAccepted", "accepted::varchar", True), ("rejectionReason", _quoted("rejection"), False), ("result", _RESULT, True), ("measurement", _MEASUREMENT, True),
    ("qualityIssues", """('[' || array_to_string(list_transform(found, lambda x: '{"code":"' || replace(x, '!', '') || '","severity":"' || case when x like '%!' then 'reject' else 'warn' end || '"}'), ',') || ']')""", True),
    ("image", _json(("sha256", _quoted("sha256(event_id::varchar)"), True), ("byteLength", _measure("event_id", 0), True), ("mimeType", "'\"image/png\"'", True), ("width", "'1200'", True), ("height", "'800'", True)), True),
    ("chain", f"'{{\"index\":0,\"previousRecordHash\":\"{'0' * 64}\"}}'", True),
)


@query(f"""
with {ANALYSED} select event_id as capture_id, user_id as device_id, 'rec-' || event_id as record_id, {_CORE} as record_json, sha256({_CORE}) as core_hash from analysed left join {PANELS_OF} using (panel_id)
""")
def record_cores(spark, sf_dir):
    done = analyse.build_record_cores(analyse.analyse_captures(_quality_readings(spark, sf_dir), _captures(spark, sf_dir)))
    return done.select("capture_id", "device_id", "record_id", "record_json", canonical.sha256_hex(F.col("record_json")).alias("core_hash"))


@query(f"""
with {FITS}, lit as (select *, {", ".join(f"least(1.0, greatest(0.0, m{k}0*r/g0+m{k}1*g/g0+m{k}2*b/g0+m{k}3)) as c{c}" for k, c in enumerate("rgb"))} from (select *, case when used then gain else 1.0 end as g0 from fits)),
enc as (select *, {", ".join(f"floor(least(1.0, greatest(0.0, case when c{c} <= 0.0031308 then c{c}*12.92 else 1.055*pow(c{c}, 1/2.4::double)-0.055 end))*255+0.5)::int as e{c}" for c in "rgb")} from lit)
select capture_id, patch_id, printf('#%02x%02x%02x', er, eg, eb) as corrected_hex, {sql.r6("delta_e", "delta_e")}, {sql.r6("((capture_id*3+slot)%40)/80.0::double", "variation")}, ((capture_id*3+slot)%40)/80.0 > 0.45 as over_limit, {sql.r6("clipped_fraction::double*100", "clipped_percent")} from enc
""")
def patch_diagnostics(spark, sf_dir):
    """Per patch: corrected colour, Delta E, variation and clipping."""
    readings = _quality_readings(spark, sf_dir)
    fits = correction.fit_corrections(readings).select("capture_id", "matrix", "field", "residuals")
    rows = readings.join(fits, "capture_id")
    rgb = correction.apply_correction(F.col("matrix"), F.col("field"), tuple(map(F.col, "rgb")), F.col("u"), F.col("v"))
    own = F.get(F.filter("residuals", lambda x: x["slot"] == F.col("slot")), F.lit(0))["delta_e"]
    hexes = colour.rgb_to_hex(tuple(colour.linear_to_srgb(c) for c in rgb))
    spread = quality.region_non_uniformity(tuple(F.col(f"raw_{c}") for c in "rgb"), tuple(F.col(f"std_{c}") for c in "rgb"))
    return rows.select("capture_id", "patch_id", hexes.alias("corrected_hex"), r6(own, "delta_e"), r6(spread, "variation"), (spread > quality.PATCH_SPREAD).alias("over_limit"), r6(F.col("clipped_fraction") * 100, "clipped_percent"))


# Calibration

CALIBRATION = f"""{sql.PATCHES}, cal as (
    select e.user_id as card_serial, e.event_id as frame_id, p.patch_id, p.slot, {", ".join(f"p.ref_{c} + ((e.event_id*13+p.slot*7)%11)*0.002::double + case when e.user_id%5=0 and e.event_id%2=0 then 0.25 else 0.0 end as {c}" for c in "rgb")}
    from events e cross join patches p where not (e.user_id%7=0 and p.slot=11 and e.event_id%4=0)),
lab0 as (select card_serial, frame_id, patch_id, slot, {sql.xyz_of("r", "g", "b", "q")} from cal), lab as (select *, {sql.lab_of("qx", "qy", "qz", "w")} from lab0),
med as (select card_serial, patch_id, median(wl) as ml, median(wa) as ma, median(wb) as mb from lab group by 1, 2),
far as (select lab.*, ml, ma, mb, {sql.de2000("ml", "ma", "mb", "wl", "wa", "wb", "d")} from lab join med using (card_serial, patch_id)),
agree as (select card_serial, patch_id, slot, ml, ma, mb, count(*) as n, avg(d) as agreement from far group by all),
frames as (select user_id as card_serial, count(distinct event_id) as frame_count from events group by 1),
cards as (select a.card_serial, any_value(frame_count) as frame_count, count(*) filter (where n = frame_count) as whole, min(slot) filter (where n <> frame_count) as short, max(agreement) as worst, avg(agreement) as mean, arg_max(patch_id, (agreement, slot)) as worst_patch
    from agree a join frames using (card_serial) group by 1),
verdict as (select *, case when frame_count < 3 then 'too-few-frames' when whole < 12 then 'incomplete-patch-coverage' when worst > 6 then 'frames-disagree' end as reason from cards)"""


@query(f"""
with {CALIBRATION}
select card_serial, frame_count, reason is null as ok, reason, case when reason = 'frames-disagree' then worst_patch end as worst_patch,
       case when reason is null or reason = 'frames-disagree' then round(worst, 6) + 0.0 end as worst_agreement, case when reason is null or reason = 'frames-disagree' then round(mean, 6) + 0.0 end as mean_agreement from verdict
""")
def self_calibrate(spark, sf_dir):
    done = calibrate.self_calibrate(views.v_calibration(spark, sf_dir))
    return done.select("card_serial", "frame_count", "ok", "reason", "worst_patch", r6(F.col("worst_agreement"), "worst_agreement"), r6(F.col("mean_agreement"), "mean_agreement"))


@query(f"""
with {CALIBRATION}, own as (select card_serial, patch_id, floor(ml*1e4+0.5)/1e4 as l, floor(ma*1e4+0.5)/1e4 as a, floor(mb*1e4+0.5)/1e4 as b from agree join verdict using (card_serial) where reason is null)
select c.card_serial, p.patch_id, {sql.r6("coalesce(o.l, p.l)", "lab_l")}, {sql.r6("coalesce(o.a, p.a)", "lab_a")}, {sql.r6("coalesce(o.b, p.b)", "lab_b")}, o.l is not null as is_measured
from (select distinct user_id as card_serial from events) c cross join patches p left join own o on o.card_serial = c.card_serial and o.patch_id = p.patch_id
""")
def reference_lab(spark, sf_dir):
    own = calibrate.calibration_patches(calibrate.self_calibrate(views.v_calibration(spark, sf_dir)))
    cards = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("card_serial"))
    done = card.reference_lab(card.card_patches(spark), cards, own)
    return done.select("card_serial", "patch_id", *(r6(F.col(c), f"lab_{c.lower()}") for c in "Lab"), "is_measured")


@query(f"""
with {CALIBRATION} select c.card_serial, case when v.reason is null and v.card_serial is not null then 'self-measured' else 'nominal' end as provenance,
    case when v.reason is null and v.card_serial is not null then 'Self-measured (camera)' else 'Nominal (print targets)' end as words,
    case when v.reason is null and v.card_serial is not null then 12 else 0 end as patches, false as is_fully_measured, coalesce(v.reason is null and v.card_serial is not null, false) as has_per_patch_references
from (select distinct user_id as card_serial from events) c left join verdict v using (card_serial)
""")
def calibration_status(spark, sf_dir):
    done = calibrate.self_calibrate(views.v_calibration(spark, sf_dir))
    cards = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("card_serial")).distinct()
    cards = cards.join(done.select("card_serial", "provenance"), "card_serial", "left").withColumn("provenance", F.coalesce("provenance", F.lit("nominal")))
    status = card.calibration_status(cards, calibrate.calibration_patches(done), card.card_patches(spark))
    return status.withColumn("words", card.describe_provenance(F.col("provenance")))


# Records and chains


def _chained(records: DataFrame) -> DataFrame:
    """Records of ``v_records`` with their links: previous_hash, record_hash and the canonical record text."""
    head = F.concat(F.lit('{"capturedAt":"'), "captured_at", F.lit('","category":"'), "category", F.lit('","chain":{"index":{index},"previousRecordHash":"'))
    tail = F.concat(F.lit('"},"operator":{"id":"'), "operator_id", F.lit('"},"recordId":"'), "record_id", F.lit('"}'))
    done = chain.chain_cores(records.withColumns({"pos": F.col("chain_index"), "prefix": head, "suffix": tail}))
    text = F.replace(F.concat(head, F.col("previous_hash"), tail), F.lit("{index}"), F.col("chain_index").cast("string"))
    return done.withColumn("record_json", text)


def _tampered(records: DataFrame) -> DataFrame:
    """The log as found: some records edited, some gone. Hashes are taken from the text."""
    left = records.filter(F.col("event_id") % 131 != 0)
    edited = F.when(F.col("event_id") % 97 == 0, F.replace("record_json", F.lit('"category":"'), F.lit('"category":"not '))).otherwise(F.col("record_json"))
    return left.withColumn("record_json", edited).withColumn("record_hash", canonical.record_hash(F.col("record_json")))


NUMBERED = f"""numbered as (
    select user_id as device_id, row_number() over (partition by user_id order by ts, event_id) - 1 as chain_index, event_id, 'rec-' || event_id as record_id,
           strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') as captured_at, ['positive', 'negative', 'inconclusive'][event_id%3+1] as category, 'op-' || user_id%9 as operator_id,
           {sql.PANEL_LIST}[event_id%4+1] as panel_id, case when event_id%4=0 then 'case "' || event_id%50 || '", x' end as case_reference, event_id%10 <> 0 as accepted,
           ['pending', 'synced', 'failed'][event_id%3+1] as sync_state, ((event_id*37)%2000)/100.0 as match_delta_e from events)"""
LINKS = f"""{NUMBERED}, links as (
    select device_id, chain_index, record_id, event_id, captured_at, category, operator_id, repeat('0', 64) as previous_hash,
           sha256('{{"capturedAt":"' || captured_at || '","category":"' || category || '","chain":{{"index":0,"previousRecordHash":"' || repeat('0', 64) || '"}},"operator":{{"id":"' || operator_id || '"}},"recordId":"' || record_id || '"}}') as record_hash
    from numbered where chain_index = 0
    union all
    select n.device_id, n.chain_index, n.record_id, n.event_id, n.captured_at, n.category, n.operator_id, l.record_hash,
           sha256('{{"capturedAt":"' || n.captured_at || '","category":"' || n.category || '","chain":{{"index":' || n.chain_index || ',"previousRecordHash":"' || l.record_hash || '"}},"operator":{{"id":"' || n.operator_id || '"}},"recordId":"' || n.record_id || '"}}')
    from links l join numbered n on n.device_id = l.device_id and n.chain_index = l.chain_index + 1)"""
FOUND = f"""{LINKS}, found as (
    select device_id, chain_index, record_id, previous_hash, case when event_id%97=0 then
        sha256('{{"capturedAt":"' || captured_at || '","category":"not ' || category || '","chain":{{"index":' || chain_index || ',"previousRecordHash":"' || previous_hash || '"}},"operator":{{"id":"' || operator_id || '"}},"recordId":"' || record_id || '"}}')
        else record_hash end as record_hash from links where event_id%131 <> 0),
checked as (select *, row_number() over w - 1 as pos, previous_hash <> coalesce(lag(record_hash) over w, repeat('0', 64)) as chain_broken, chain_index <> coalesce(lag(chain_index) over w + 1, 0) as index_mismatch
    from found window w as (partition by device_id order by chain_index, record_id))"""


@query(f"with recursive {LINKS} select device_id, record_id, chain_index, previous_hash, record_hash from links")
def chain_cores(spark, sf_dir):
    done = _chained(views.v_records(spark, sf_dir))
    return done.select("device_id", "record_id", "chain_index", "previous_hash", "record_hash")


@query("""
with recursive turns as (select conv_id as device_id, turn as pos, sha256(coalesce(text, '')) as body_hash from conversations),
links as (
    select device_id, pos, repeat('0', 64) as previous_hash, sha256('{"body":"' || body_hash || '","chain":{"index":0,"previousRecordHash":"' || repeat('0', 64) || '"}}') as record_hash from turns where pos = 0
    union all
    select t.device_id, t.pos, l.record_hash, sha256('{"body":"' || t.body_hash || '","chain":{"index":' || t.pos || ',"previousRecordHash":"' || l.record_hash || '"}}') from links l join turns t on t.device_id = l.device_id and t.pos = l.pos + 1)
select device_id, pos as chain_index, previous_hash, record_hash from links
""")
def chain_turns(spark, sf_dir):
    turns = views.v_turns(spark, sf_dir)
    prefix = F.concat(F.lit('{"body":"'), "body_hash", F.lit('","chain":{"index":{index},"previousRecordHash":"'))
    cores = turns.select("device_id", "pos", F.col("pos").cast("string").alias("record_id"), prefix.alias("prefix"), F.lit('"}}').alias("suffix"))
    return chain.chain_cores(cores).select("device_id", "chain_index", "previous_hash", "record_hash")


@query(f"with recursive {FOUND} select device_id, record_id, pos, chain_broken, index_mismatch from checked")
def verify_chains(spark, sf_dir):
    done = chain.verify_chains(_tampered(_chained(views.v_records(spark, sf_dir))))
    return done.select("device_id", "record_id", F.col("pos").cast("long").alias("pos"), "chain_broken", "index_mismatch")


@query(f"""
with recursive {FOUND} select device_id, min(pos) filter (where chain_broken or index_mismatch) is null as valid,
    coalesce(min(pos) filter (where chain_broken or index_mismatch), -1) as first_invalid, count(*) as records from checked group by 1
""")
def chain_summary(spark, sf_dir):
    return chain.chain_summary(chain.verify_chains(_tampered(_chained(views.v_records(spark, sf_dir)))))


@query(f"""
with recursive {FOUND}, last as (select *, row_number() over (partition by device_id order by chain_index desc, record_id desc) as nth from found)
select d.device_id, coalesce(l.chain_index + 1, 0) as next_index, coalesce(l.record_hash, repeat('0', 64)) as previous_hash
from (select distinct user_id as device_id from events) d left join last l on l.device_id = d.device_id and l.nth = 1
""")
def next_chain_positions(spark, sf_dir):
    devices = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("device_id"))
    return chain.next_chain_position(_tampered(_chained(views.v_records(spark, sf_dir))), devices)


@query(f"""
with recursive {LINKS}, gap as (select device_id, min(chain_index) as g from links where event_id%53=0 and chain_index > 0 group by 1)
select l.device_id, l.record_id, l.chain_index, l.chain_index < coalesce(g.g, 1000000000) as accepted, case when l.chain_index < coalesce(g.g, 1000000000) then 'pending' end as sync_state
from links l left join gap g using (device_id) where l.chain_index > 0 and l.event_id%53 <> 0
""")
def append_batch(spark, sf_dir):
    """Each device's first record is its log, the rest a batch; where the batch lacks one, all that follow are refused."""
    records = _chained(views.v_records(spark, sf_dir))
    heads = chain.next_chain_position(records.filter("chain_index = 0"))
    return chain.append(records.filter((F.col("chain_index") > 0) & (F.col("event_id") % 53 != 0)), heads)


@query("""
with o as (select *, case when event_id%24 < 6 then ['1e-7', '1e+21', '0.00001', '1234567890123456800', '5', '100000000000000000000'][event_id%24+1] else '7.25' end as odd from events)
select event_id, sha256('{"a":null,"id":' || event_id || ',"n":[3,1,{"x":0,"y":' || user_id || '}],"o":' || odd || ',"t":"' || event_type || ' é"}') as core_hash,
       sha256('{"a":null,"id":' || event_id || ',"n":[3,1,{"x":0,"y":' || user_id || '}],"o":' || odd || ',"signature":{"v":1},"t":"' || event_type || ' é"}') as record_hash,
       substring(sha256('P-256.x' || user_id || '.y' || event_id), 1, 32) as fingerprint from o
""")
def record_hashes(spark, sf_dir):
    """Canonical hashes of JSON with unsorted keys, spaces, nulls, -0, odd numbers and a signature."""
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = F.concat(F.lit('{ "t" : "'), "event_type", F.lit(' é", "o": '), F.coalesce(F.get(F.array(*(F.lit(x) for x in ("1e-7", "1E21", "0.00001", "1234567890123456789", "5.0", "1e20"))), (F.col("event_id") % 24).cast("int")), F.lit("7.25")), F.lit(', "signature":{"v":1.0}, "n":[3, 1, {"y":'), u, F.lit(',"x":-0}], "id":'), e, F.lit(', "a":null }'))
    rows = canonical.with_hashes(views.table(spark, sf_dir, "events").withColumn("record_json", text))
    finger = canonical.key_fingerprint(F.lit("P-256"), F.concat(F.lit("x"), u), F.concat(F.lit("y"), e))
    return rows.select("event_id", "core_hash", "record_hash", finger.alias("fingerprint"))


@query("select doc_id, sha256(coalesce(text, '')) as sha256, true as hex_back, true as base64url_back, doc_id%7=0 as mismatch from documents")
def image_hashes(spark, sf_dir):
    """Image bytes against the digests of their records, and both encodings there and back."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    there = {"hex_back": canonical.from_hex(canonical.to_hex(F.col("data"))) == F.col("data"), "base64url_back": canonical.from_base64url(canonical.to_base64url(F.col("data"))) == F.col("data")}
    rows = docs.select("doc_id", canonical.sha256_hex(F.col("data")).alias("image_hash"), *(c.alias(n) for n, c in there.items()))
    rows = rows.withColumns({"signed_image_hash": F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.col("image_hash")), "algorithm": F.lit("ECDSA-P256-SHA256"), "core_hash": F.lit("x"), "signed_core_hash": F.lit("x"), "key_ok": F.lit(True), "signature_ok": F.lit(True)})
    return chain.verify_records(rows).select("doc_id", F.col("image_hash").alias("sha256"), "hex_back", "base64url_back", F.array_contains("failures", "image-hash-mismatch").alias("mismatch"))


@query("""
select event_id, case when event_id%5=0 then 'unsupported-algorithm' else array_to_string(list_filter([case when event_id%3=0 then 'core-hash-mismatch' end,
    case when event_id%7=0 then 'malformed-public-key' end, case when event_id%7<>0 and event_id%11=0 then 'bad-signature' end, case when event_id%13=0 then 'image-hash-mismatch' end], lambda x: x is not null), ',') end as failures,
    event_id%2=0 as attributed from events
""")
def verify_records(spark, sf_dir):
    e = F.col("event_id")
    rows = views.table(spark, sf_dir, "events").withColumns(
        {
            "algorithm": F.when(e % 5 == 0, "RSA").otherwise("ECDSA-P256-SHA256"), "core_hash": canonical.sha256_hex(e.cast("string")),
            "signed_core_hash": canonical.sha256_hex((e + F.when(e % 3 == 0, 1).otherwise(0)).cast("string")), "key_ok": e % 7 != 0, "signature_ok": (e % 11 != 0) & (e % 7 != 0),
            "image_hash": F.when(e % 2 == 1, "h").otherwise(F.when(e % 13 == 0, "h")), "signed_image_hash": F.when(e % 13 == 0, "other").otherwise("h"),
            "signer_fingerprint": (e % 2).cast("string"), "device_fingerprint": F.lit("0"),
        }
    )
    rows = rows.withColumn("image_hash", F.when(e % 13 == 0, "h").otherwise(F.col("image_hash")))
    done = chain.attribution_check(chain.verify_records(rows))
    return done.select("event_id", F.array_join("failures", ",").alias("failures"), "attributed")


@query(f"""
with recursive {ANALYSED}, cores as (select user_id as device_id, 'rec-' || event_id as record_id, row_number() over (partition by user_id order by event_id) - 1 as chain_index, {_CORE} as core from analysed left join {PANELS_OF} using (panel_id)),
parts as (select *, split_part(core, '"chain":{{"index":0', 1) as head, split_part(core, '"chain":{{"index":0,"previousRecordHash":"' || repeat('0', 64) || '"}}', 2) as tail from cores),
links as (
    select device_id, record_id, chain_index, repeat('0', 64) as previous_hash, sha256(core) as record_hash from parts where chain_index = 0
    union all
    select p.device_id, p.record_id, p.chain_index, l.record_hash, sha256(p.head || '"chain":{{"index":' || p.chain_index || ',"previousRecordHash":"' || l.record_hash || '"}}' || p.tail)
    from links l join parts p on p.device_id = l.device_id and p.chain_index = l.chain_index + 1)
select device_id, record_id, chain_index, previous_hash, record_hash from links
""")
def chain_records(spark, sf_dir):
    """Record cores of analysed captures, chained by device, with the finished text's hash taken from the text."""
    cores = analyse.build_record_cores(analyse.analyse_captures(_quality_readings(spark, sf_dir), _captures(spark, sf_dir)))
    done = chain.chain_records(cores, order=("capture_id",)).drop("record_hash")
    return done.select("device_id", "record_id", "chain_index", "previous_hash", canonical.record_hash(F.col("record_json")).alias("record_hash"))


AUDITED = """log as (
    select event_id, user_id as device_id, 'rec-' || event_id as record_id, row_number() over (partition by user_id order by ts, event_id) - 1 as chain_index, event_id % 1500 as doc_id,
        case when event_id%97=0 then 'edit' when event_id%89=0 then 'algorithm' when event_id%83=0 then 'cut' when event_id%79=0 then 'signature' when event_id%73=0 then 'key' end as kind from events),
near as (
    select *, row_number() over w - 1 as pos, lag(chain_index) over w as before, lag(kind) over w as broken from log where event_id%131 <> 0 window w as (partition by device_id order by chain_index)),
facts as (
    select n.*, n.event_id%17=0 and n.event_id%19<>0 and d.doc_id is not null as image, case when pos = 0 then chain_index <> 0 else before <> chain_index - 1 or broken is not null end as unlinked,
        case when pos = 0 then chain_index <> 0 else before <> chain_index - 1 or coalesce(broken = 'cut', false) end as misplaced
    from near n left join documents d on d.doc_id = n.doc_id),
audited as (
    select device_id, record_id, pos, chain_index, case when kind = 'cut' then 'malformed-record' when kind = 'algorithm' then 'unsupported-algorithm' else array_to_string(list_filter([
        case when kind = 'edit' then 'core-hash-mismatch' end, case when kind = 'key' then 'malformed-public-key' end, case when kind in ('edit', 'signature') then 'bad-signature' end,
        case when image then 'image-hash-mismatch' end, case when unlinked then 'chain-broken' end, case when misplaced then 'chain-index-mismatch' end], lambda x: x is not null), ',') end as failures,
        device_id%7 <> 3 and coalesce(kind not in ('cut', 'key'), true) as attributed from facts)"""


def _audited(spark, sf_dir, long_chains: bool):
    docs = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), canonical.sha256_hex(F.coalesce("text", F.lit(""))).alias("sha256"))
    return audit.verify_log(views.v_signed_log(spark, sf_dir), docs, long_chains)


@query(f"with {AUDITED} select * from audited")
def audit_log(spark, sf_dir):
    """Every record of the signed logs: all that fails, by its text, signature, image and link."""
    done = _audited(spark, sf_dir, False)
    return done.select("device_id", "record_id", "pos", "chain_index", F.array_join("failures", ",").alias("failures"), "attributed")


@query(f"with {AUDITED} select device_id, count(*) filter (where failures <> '') = 0 as valid, coalesce(min(pos) filter (where failures <> ''), -1) as first_invalid, count(*) as records, count(*) filter (where failures <> '') as failed from audited group by 1")
def audit_verdicts(spark, sf_dir):
    """The logs' verdicts, their chains checked in ranges."""
    return audit.log_verdicts(_audited(spark, sf_dir, True))


# The log


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.v_records(spark, sf_dir).withColumnRenamed("accepted", "capture_accepted")


@query(f"""
with {NUMBERED} select device_id, chain_index, record_id from numbered where accepted and category = 'positive' and captured_at >= '2024' and panel_id = 'marquis' and lower(coalesce(case_reference || ' ', '') || operator_id) like '%x op-%'
""")
def search_log(spark, sf_dir):
    return log.search(_log(spark, sf_dir), category="positive", panel_id="marquis", since="2024", text="  X op-").select("device_id", "chain_index", "record_id")


@query(f"with {NUMBERED} select device_id, max(chain_index) as chain_index, arg_max(record_id, (chain_index, record_id)) as record_id from numbered group by 1")
def latest_records(spark, sf_dir):
    return log.latest(_log(spark, sf_dir)).select("device_id", "chain_index", "record_id")


@query(f"""
with {NUMBERED} select device_id, count(*) as total, count(*) filter (where accepted) as shown, count(*) filter (where not accepted) as refused,
    count(*) filter (where (case when event_id%4=0 then (case when event_id%8=0 then 'failed' else 'synced' end) else sync_state end) <> 'synced') as unsynced from numbered group by 1
""")
def log_summary(spark, sf_dir):
    """Sync states after two rounds of updates, of which the last counts, then counts by device."""
    records = _log(spark, sf_dir)
    old = records.filter("event_id % 4 = 0").select("record_id", F.lit("synced").alias("sync_state"), F.lit(1).alias("update_pos"))
    new = records.filter("event_id % 8 = 0").select("record_id", F.lit("failed").alias("sync_state"), F.lit(2).alias("update_pos"))
    return log.log_summary(log.update_sync_state(records, old.unionByName(new)))


@query(f"""
with {NUMBERED}, names as (select * from (values {", ".join(f"({sql.text(o[0])}, {sql.text(o[1])})" for o in dict.fromkeys((x[0], x[1]) for x in panels.OUTCOMES))}) t(panel_id, panel_name))
select device_id, chain_index, chain_index || ',' || record_id || ',' || captured_at || ',' || operator_id || ',' ||
    coalesce('"' || replace(case_reference, '"', '""') || '"', '') || ',' || panel_name || ',' || accepted || ',' || category || ',,,' ||
    case when event_id*37%2000*8%1000 = 0 then printf('%.2f', floor((event_id*37%2000)/10.0::double+0.5)/100) else printf('%.2f', (event_id*37%2000)/1000.0::double) end || ',' ||
    case event_id%6 when 0 then '12' when 1 then '-0.5' when 2 then '0.00005' when 3 then '1e-7' when 4 then '1e+21' else '' end || ',' || event_id || ',' ||
    case event_id%3 when 0 then '12345678.25' when 1 then '-3' else '0.1' end || ',,yes,' || sync_state as line
from numbered join names using (panel_id)
""")
def csv_export(spark, sf_dir):
    """Lines of all records, with distances on the border of two roundings and whole, small and large coordinates."""
    e = F.col("event_id")
    odd = lambda values, n: F.get(F.array(*(F.lit(v) for v in values)), (e % n).cast("int"))
    rows = _log(spark, sf_dir).withColumns(
        {"match_delta_e": (e * 37 % 2000) / F.lit(1000.0), "latitude": odd((12.0, -0.5, 0.00005, 1e-7, 1e21, None), 6), "longitude": e.cast("double"), "accuracy_m": odd((12345678.25, -3.0, 0.1), 3)}
    )
    return log.csv_lines(rows)


@query(f"with {NUMBERED} select record_id, case when event_id%3=0 then 'new' else sync_state end as sync_state from numbered where case when event_id%3=0 then true else sync_state = 'pending' end")
def upsert_and_pending(spark, sf_dir):
    """Newest of each record wins; then the records yet to be sent."""
    records = _log(spark, sf_dir).select("record_id", "event_id", "sync_state", F.lit(1).alias("version"))
    updates = records.filter("event_id % 3 = 0").withColumns({"sync_state": F.lit("new"), "version": F.lit(2)})
    done = log.upsert(records, updates, "version")
    return log.pending_sync(done).select("record_id", "sync_state").unionByName(done.filter("sync_state = 'new'").select("record_id", "sync_state"))


@query(f"""
with {NUMBERED}, mixed as (select *, case when event_id%5=0 then 'synced' else sync_state end as last_state from numbered)
select device_id, chain_index, record_id, last_state as sync_state, substring(captured_at, 1, 10) as capture_date from mixed
where accepted and captured_at >= '2024-01-03T12' and captured_at <= '2024-01-09T23:59:59.999Z' and last_state = 'synced'
""")
def stored_log(spark, sf_dir):
    """A log stored by days in two batches, updated in place, and searched by time and state."""
    import uuid

    at = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    records = _log(spark, sf_dir).select("device_id", "chain_index", "record_id", "captured_at", "capture_accepted", "sync_state", "event_id", F.lit(1).alias("version"))
    io.upsert_records(records.filter("event_id % 2 = 0"), at)
    io.upsert_records(records.filter("event_id % 2 = 1"), at)
    io.upsert_records(records.filter("event_id % 5 = 0").withColumns({"sync_state": F.lit("synced"), "version": F.lit(2)}), at)
    found = log.search(io.read_log(spark, at), sync_state="synced", since="2024-01-03T12", until="2024-01-09T23:59:59.999Z")
    return found.select("device_id", "chain_index", "record_id", "sync_state", "capture_date")


@query("""
with d as (select distinct cast(ts as date) as day from events)
select strftime(day, '%Y-%m-%d') as day, strftime(day + interval 5 hour, '%Y-%m-%dT%H:%M:%S.000Z') as since, strftime(day + interval 29 hour - interval 1 second, '%Y-%m-%dT%H:%M:%S') || '.999Z' as until from d
""")
def day_bounds(spark, sf_dir):
    days = views.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    since, until = log.day_bounds(F.col("day"), "-05:00")
    return days.select(F.col("day").cast("string").alias("day"), since.alias("since"), until.alias("until"))


# Pixels

FRAMES = "frames as (select vec_id as capture_id, i%8 as x, i//8 as y, least(1.0, greatest(0.0, 0.5+e::double)) as luma from (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as i from embeddings))"
OTSU = """bins as (select capture_id, least(255, floor(luma*255+0.5))::int as bin, count(*) as n from frames group by 1, 2),
cum as (select *, sum(n) over w as w0, sum(n*bin) over w as s0, sum(n) over (partition by capture_id) as w, sum(n*bin) over (partition by capture_id) as s from bins window w as (partition by capture_id order by bin)),
part as (select *, (w0*(w-w0))*pow(s0/w0-(s-s0)/(w-w0), 2) as score, (s0/w0+(s-s0)/(w-w0))/2/255 as mid from cum where w > w0),
cut as (select f.capture_id, coalesce(p.mid, 0.5) as threshold from (select distinct capture_id from frames) f left join (select capture_id, arg_max(mid, (score, -bin)) as mid from part group by 1) p using (capture_id))"""


@query(f"with {FRAMES}, {OTSU} select capture_id, {sql.r6('threshold', 'threshold')} from cut")
def otsu_thresholds(spark, sf_dir):
    return pixels.otsu(views.v_mini_frames(spark, sf_dir)).select("capture_id", r6(F.col("threshold"), "threshold"))


@query(f"""
with {FRAMES}, l as (select c.capture_id, 4*c.luma-a.luma-b.luma-u.luma-d.luma as v from frames c join frames a on a.capture_id=c.capture_id and a.y=c.y and a.x=c.x-1
    join frames b on b.capture_id=c.capture_id and b.y=c.y and b.x=c.x+1 join frames u on u.capture_id=c.capture_id and u.x=c.x and u.y=c.y-1 join frames d on d.capture_id=c.capture_id and d.x=c.x and d.y=c.y+1)
select capture_id, {sql.r6("var_pop(v)*1e4", "focus_score")} from l group by 1
""")
def focus_scores(spark, sf_dir):
    return pixels.focus_score(views.v_row_frames(spark, sf_dir)).select("capture_id", r6(F.col("focus_score"), "focus_score"))


@query(f"""
with {FRAMES}, lv as (select capture_id, x, y, floor(luma*255+0.5)::int as r, (floor(luma*255+0.5)::int * 7) % 256 as g, 255 - floor(luma*255+0.5)::int as b from frames)
select capture_id, x//3 as x, y//3 as y, {", ".join(f"round_even(avg({c}), 0)::int as {c}" for c in "rgb")} from lv where x < 6 and y < 6 group by all
""")
def downscaled(spark, sf_dir):
    level = F.floor(F.col("luma") * 255 + 0.5).cast("int")
    rows = views.v_mini_frames(spark, sf_dir).withColumns({"r": level, "g": level * 7 % 256, "b": 255 - level})
    return pixels.downscale(rows, 3).select("capture_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "r", "g", "b")


@query(f"""
with recursive {FRAMES}, {OTSU}, dark as (select f.capture_id, x, y, y*8+x as p from frames f join cut using (capture_id) where luma <= threshold),
reach as (select capture_id, p, p as q from dark union select r.capture_id, r.p, d.p from reach r join dark o on o.capture_id = r.capture_id and o.p = r.q join dark d on d.capture_id = o.capture_id and abs(d.x-o.x) <= 1 and abs(d.y-o.y) <= 1),
lab as (select capture_id, p, min(q) as blob from reach group by 1, 2),
mom as (select d.capture_id, l.blob, count(*) as area, avg(x) as cx, avg(y) as cy, avg(x*x)-avg(x)*avg(x)+1/12.0 as a, avg(y*y)-avg(y)*avg(y)+1/12.0 as b, avg(x*y)-avg(x)*avg(y) as c from dark d join lab l on l.capture_id=d.capture_id and l.p=d.p group by 1, 2)
select capture_id, area, {sql.r6("cx", "cx")}, {sql.r6("cy", "cy")}, {sql.r6("area/(12*sqrt(greatest(a*b-c*c, 1e-12)))", "solidity")} from mom
""")
def blob_moments(spark, sf_dir):
    """Dark blobs of every frame and their moments."""
    frames = views.v_mini_frames(spark, sf_dir)
    done = detect.blob_moments(detect.dark_blobs(frames, pixels.otsu(frames)))
    return done.select("capture_id", "area", r6(F.col("cx"), "cx"), r6(F.col("cy"), "cy"), r6(F.col("solidity"), "solidity"))


@query("select vec_id as capture_id, 4 as candidates, true as close from embeddings where vec_id%8 in (0, 4, 5, 7)")
def candidate_quads(spark, sf_dir):
    """The best four marker candidates of every photograph that has such, against where the markers were drawn."""
    places = views.v_places(spark, sf_dir)
    found = kept(detect.best_markers(frames.frame_blobs(views.v_frames(spark, sf_dir))), "markers")
    counts = found.groupBy("capture_id").agg(F.count("*").cast("int").alias("candidates"))
    quads = detect.candidate_quads(found).filter("rank = 1").join(places.select("capture_id", "width", "h"), "capture_id").join(counts, "capture_id")
    return quads.select("capture_id", "candidates", (_worst_marker(F.col("h"), F.col("corners")) < F.col("width") / 120).alias("close"))


def _worst_marker(h, corners):
    """Largest distance of a marker centre under ``h`` to the nearest of some corners."""
    spots = [geometry.apply_homography(h, F.lit(x), F.lit(y)) for x, y in card.MARKERS]
    nearest = lambda px, py: F.array_min(F.transform(corners, lambda c: F.hypot(c["x"] - px, c["y"] - py)))
    return F.greatest(*(nearest(*spot) for spot in spots))


@query("""
select vec_id as capture_id, vec_id%8 in (0, 7) as ok, case vec_id%8 when 1 then 'image-too-small' when 2 then 'too-few-marker-candidates' when 3 then 'too-few-marker-candidates'
    when 4 then 'orientation-key-not-found' when 5 then 'marker-size-implausible' when 6 then 'no-plausible-quad' end as reason, case when vec_id%8 in (0, 7) then true end as close from embeddings
""")
def detect_cards(spark, sf_dir):
    """Cards sought in every photograph; where one is found, its homography against that by which it was drawn."""
    places = views.v_places(spark, sf_dir)
    done = frames.detect_frames(views.v_frames(spark, sf_dir), sizes=places).join(places.select("capture_id", "width", "h"), "capture_id")
    corners = F.array(*(F.struct(*(c.alias(n) for c, n in zip(geometry.apply_homography(F.col("card_to_image"), F.lit(x), F.lit(y)), "xy", strict=True))) for x, y in card.MARKERS))
    return done.select("capture_id", "ok", "reason", F.when(F.col("ok"), _worst_marker(F.col("h"), corners) < F.col("width") / 120).alias("close"))


@query(f"""
with {FRAMES}, p as (select vec_id as capture_id, (vec_id%61)/10.0 as px, (vec_id%73)/9.0::double as py from embeddings), q as (select *, floor(px)::int as x0, floor(py)::int as y0, px-floor(px) as fx, py-floor(py) as fy from p)
select q.capture_id, case when px > 7 or py > 7 then null else round(a.luma*(1-fx)*(1-fy)+coalesce(b.luma*fx*(1-fy),0)+coalesce(c.luma*(1-fx)*fy,0)+coalesce(d.luma*fx*fy,0), 6) + 0.0 end as luma
from q left join frames a on a.capture_id=q.capture_id and a.x=x0 and a.y=y0 left join frames b on b.capture_id=q.capture_id and b.x=x0+1 and b.y=y0
left join frames c on c.capture_id=q.capture_id and c.x=x0 and c.y=y0+1 left join frames d on d.capture_id=q.capture_id and d.x=x0+1 and d.y=y0+1
""")
def bilinear_probes(spark, sf_dir):
    frames = views.v_mini_frames(spark, sf_dir)
    v = F.col("capture_id")
    points = frames.select("capture_id").distinct().select("capture_id", F.lit(0).alias("point_id"), ((v % 61) / 10.0).alias("px"), ((v % 73) / F.lit(9.0)).alias("py"))
    return pixels.bilinear_probe(points, frames).select("capture_id", r6(F.col("luma"), "luma"))


@query(f"""
with {FRAMES}, o as (select *, row_number() over (partition by capture_id order by luma) as nth, count(*) over (partition by capture_id) as n from frames)
select capture_id, {sql.r6("avg(luma) filter (where nth > floor(n*0.1) and nth <= n - floor(n*0.1))", "mean")}, {sql.r6("avg(luma)", "raw_mean")}, {sql.r6("stddev_pop(luma)", "deviation")}, count(*) as n from o group by 1
""")
def trimmed_means(spark, sf_dir):
    done = pixels.trimmed_mean(views.v_mini_frames(spark, sf_dir), ["capture_id"], "luma")
    return done.select("capture_id", *(r6(F.col(c), c) for c in ("mean", "raw_mean", "deviation")), "n")


DRAWN = f"""{sql.PATCHES}, drawn as (select vec_id as capture_id, patch_id, {", ".join(f"('0x' || substr(hex, {i}, 2))::int * (200 + vec_id%50) // 250 as {c}8" for c, i in (("r", 2), ("g", 4), ("b", 6)))}
    from embeddings cross join patches where vec_id%8 not in (2, 6))"""


@query(f"""
with {DRAWN} select capture_id, patch_id as region_id, {", ".join(sql.r6(sql.linear_of(f"({c}8/255.0::double)"), c) for c in "rgb")}, {", ".join(sql.r6(sql.linear_of(f"({c}8/255.0::double)"), f"raw_{c}") for c in "rgb")},
    0.0::double as std_r, 0.0::double as clipped_fraction, 0.0::double as out_fraction, 384 as count from drawn
""")
def region_samples(spark, sf_dir):
    """The card's patches read off every photograph of a card, under the homography by which it was drawn."""
    done = frames.sample_regions(views.v_frames(spark, sf_dir), card.sample_rows())
    return done.select("capture_id", "region_id", *(r6(F.col(c), c) for c in ("r", "g", "b", "raw_r", "raw_g", "raw_b", "std_r", "clipped_fraction", "out_fraction")), "count")


@query(f"with {DRAWN} select capture_id, patch_id, printf('#%02x%02x%02x', r8, g8, b8) as hex, 1.0::double as inside from drawn")
def rectified_cards(spark, sf_dir):
    """Every card flattened, and the colour at the centre of each of its patches."""
    done = frames.rectify(views.v_frames(spark, sf_dir))
    spots = F.array(*(F.struct(F.lit(p).alias("patch_id"), F.lit(x).alias("x"), F.lit(y).alias("y")) for p, x, y in ((r[0], int(r[9] * 445), int(r[10] * 270)) for r in card.patch_rows())))
    level = lambda s: F.lower(F.hex(F.substring("data", 3 * (s["y"] * F.col("width") + s["x"]) + 1, F.lit(3))))
    rows = done.select("capture_id", "inside", F.explode(F.transform(spots, lambda s: F.struct(s["patch_id"].alias("patch_id"), level(s).alias("level")))).alias("s"))
    return rows.select("capture_id", "s.patch_id", F.concat(F.lit("#"), "s.level").alias("hex"), "inside")


ORDER_SQUARES = """squares as (
    select o_custkey as capture_id, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) - 1 as r, count(*) over (partition by o_custkey) as n, floor(o_totalprice)::bigint as p from orders),
blobs as (select capture_id, 40*(r%6)+4+k%5 as x, 40*(r//6)+4+k%7 as y, 9+2*(p%10) as w, 9+2*((p//10)%10) as h, 240*greatest(120, 40*((n+5)//6)) as frame from squares),
marks as (
    select capture_id, x+(w-1)/2.0::double as x, y+(h-1)/2.0::double as y, (w*h)::double as area, row_number() over (partition by capture_id order by w*h desc, y, x) as i
    from blobs where w*h >= 0.0002*frame and w*h <= 0.06*frame and greatest(w, h) < 1.5*least(w, h) qualify i <= 14),
fours as (
    select a.capture_id, (a.x+b.x+c.x+d.x)/4 as mx, (a.y+b.y+c.y+d.y)/4 as my, a.x as xa, a.y as ya, a.area as aa, a.i as ia, b.x as xb, b.y as yb, b.area as ab, b.i as ib, c.x as xc, c.y as yc, c.area as ac, c.i as ic, d.x as xd, d.y as yd, d.area as ad, d.i as id
    from marks a join marks b on b.capture_id=a.capture_id and b.i>a.i join marks c on c.capture_id=a.capture_id and c.i>b.i join marks d on d.capture_id=a.capture_id and d.i>c.i),
rings as (
    select capture_id, greatest(aa, ab, ac, ad)/least(aa, ab, ac, ad) as ratio, list_sort([{'t': atan2(ya-my, xa-mx), 'x': xa, 'y': ya, 'i': ia}, {'t': atan2(yb-my, xb-mx), 'x': xb, 'y': yb, 'i': ib},
        {'t': atan2(yc-my, xc-mx), 'x': xc, 'y': yc, 'i': ic}, {'t': atan2(yd-my, xd-mx), 'x': xd, 'y': yd, 'i': id}]) as q from fours),
turned as (
    select *, list_transform([0, 1, 2, 3], lambda n: sqrt(pow(q[(n+1)%4+1].x-q[n+1].x, 2)+pow(q[(n+1)%4+1].y-q[n+1].y, 2))) as s,
        list_transform([0, 1, 2, 3], lambda n: (q[(n+1)%4+1].x-q[n+1].x)*(q[(n+2)%4+1].y-q[(n+1)%4+1].y)-(q[(n+1)%4+1].y-q[n+1].y)*(q[(n+2)%4+1].x-q[(n+1)%4+1].x)) as turns from rings),
sided as (select *, greatest(s[1]+s[3], s[2]+s[4])/2 as far, least(s[1]+s[3], s[2]+s[4])/2 as near from turned where ratio <= 4 and (list_max(turns) >= 1e-9) <> (list_min(turns) <= -1e-9)),
scored as (
    select *, 3*abs(ln(far/near/(75.9/41::double))) + 2*(abs(s[1]-s[3])+abs(s[2]-s[4]))/far + ln(ratio) - 0.35*ln(far*near) as score from sided where near > 0 and far/near <= 3.6),
best as (select *, row_number() over (partition by capture_id order by score, list_transform(q, lambda c: c.i)) as nth from scored qualify nth <= 40)"""


@query(f"with {ORDER_SQUARES} select capture_id, count(*)::int as quads, {sql.r6('min(score)', 'best_score')}, {sql.r6('max(score)', 'last_score')}, {sql.r6('avg(score)', 'mean_score')} from best group by 1")
def order_quads(spark, sf_dir):
    """The best fours among the rectangles of each customer's picture, found in its pixels."""
    quads = detect.candidate_quads(detect.best_markers(frames.frame_blobs(views.v_order_frames(spark, sf_dir))))
    return quads.groupBy("capture_id").agg(F.count("*").cast("int").alias("quads"), *(r6(f("score"), n) for f, n in ((F.min, "best_score"), (F.max, "last_score"), (F.avg, "mean_score"))))


@query(f"""
with {ORDER_SQUARES}, counted as (select capture_id, count(*) as n from marks group by 1)
select c.c_custkey as capture_id, case when o.o_custkey is null then 'no-image-data' when coalesce(m.n, 0) < 4 then 'too-few-marker-candidates' when b.capture_id is null then 'no-plausible-quad' else 'orientation-key-not-found' end as reason,
    case when o.o_custkey is not null then coalesce(m.n, 0)::int end as candidates
from customer c left join (select distinct o_custkey from orders) o on o.o_custkey = c.c_custkey left join counted m on m.capture_id = c.c_custkey left join (select distinct capture_id from best) b on b.capture_id = c.c_custkey
""")
def order_cards(spark, sf_dir):
    """Every customer's picture read in one pass: none shows a card, and why; without a picture, that."""
    done = photos.read_cards(views.v_order_frames(spark, sf_dir))
    return done.select("capture_id", F.col("detection_reason").alias("reason"), "candidates")


@query("""
select e.event_id as capture_id, case when c.c_custkey is null then 'no-photograph' when c.n = 0 then 'no-image-data' end as missing, 'detection' as stage, false as accepted, 'inconclusive' as category
from (select event_id, user_id from events) e left join (select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1) c on c.c_custkey = e.event_id
""")
def photographed_captures(spark, sf_dir):
    """Events as captures, with the customers' pictures as their photographs: none has a card, so each keeps its row as refused."""
    samples = views.v_samples(spark, sf_dir)
    captures = samples.select(F.col("event_id").alias("capture_id"), "panel_id", F.col("user_id").alias("card_serial"))
    done = photos.analyse_frames(views.v_order_frames(spark, sf_dir), captures)
    reason = F.when(F.col("rejection_reason").isin("no-photograph", "no-image-data"), F.col("rejection_reason"))
    return done.select("capture_id", reason.alias("missing"), "stage", "accepted", "category")


SMALL_PHOTOS = f"""levels as (select capture_id, x, y, floor(luma*255+0.5)::int as level from frames),
places as (
    select *, sx*(0.07::double+0.005*(v%4)) + 0.001*sy + 0.1*(v%5) as nx, 0.13*sy + 0.05*(v%3) as ny, 1 + 0.0005*(v%4)*sx as w from spots),
probes as (select *, nx/w as px, ny/w as py, floor(nx/w)::int as x0, floor(ny/w)::int as y0, nx/w >= 0 and ny/w >= 0 and nx/w <= 7 and ny/w <= 7 as inside from places),
lit as (
    select q.*, case when inside then (a.level*(1-(px-x0))*(1-(py-y0)) + coalesce(b.level, 0)*(px-x0)*(1-(py-y0)) + coalesce(c.level, 0)*(1-(px-x0))*(py-y0) + coalesce(d.level, 0)*(px-x0)*(py-y0))/255 end as e
    from probes q left join levels a on inside and a.capture_id=v and a.x=x0 and a.y=y0 left join levels b on inside and b.capture_id=v and b.x=x0+1 and b.y=y0
    left join levels c on inside and c.capture_id=v and c.x=x0 and c.y=y0+1 left join levels d on inside and d.capture_id=v and d.x=x0+1 and d.y=y0+1)"""


@query(f"""
with {FRAMES}, rects as (select * from (values {", ".join(str(r) for r in [*card.sample_rows(), card.window_row()])}) t(region_id, rx, ry, rw, rh)),
spots as (select vec_id as v, region_id, rx+(i+0.5)/6*rw as sx, ry+(j+0.5)/4*rh as sy from embeddings cross join rects cross join range(6) t(i) cross join range(4) u(j)), {SMALL_PHOTOS},
ranked as (select *, {sql.linear_of("e")} as light, row_number() over (partition by v, region_id order by e) as nth, count(*) over (partition by v, region_id) as n from lit where e is not null),
found as (select v, region_id, count(*) as count, avg(light) filter (where nth > floor(n*0.1) and nth <= n - floor(n*0.1)) as g, avg(light) as raw_g, stddev_pop(light) as std_g, avg((e <= 0.5/255 or e >= 254.5/255)::int) as clipped from ranked group by 1, 2)
select s.vec_id as capture_id, r.region_id, {sql.r6("coalesce(g, 0)", "g")}, {sql.r6("coalesce(raw_g, 0)", "raw_g")}, {sql.r6("coalesce(std_g, 0)", "std_g")}, {sql.r6("coalesce(clipped, 1)", "clipped_fraction")},
    {sql.r6("1 - coalesce(count, 0)/24::double", "out_fraction")}, coalesce(count, 0) as count from embeddings s cross join rects r left join found f on f.v = s.vec_id and f.region_id = r.region_id
""")
def small_regions(spark, sf_dir):
    """The regions of the card read off photographs made of the embeddings' values, partly outside of them."""
    done = frames.sample_regions(views.v_small_photos(spark, sf_dir), [*card.sample_rows(), card.window_row()], 6, 4)
    return done.select("capture_id", "region_id", *(r6(F.col(c), c) for c in ("g", "raw_g", "std_g", "clipped_fraction", "out_fraction")), "count")


@query(f"""
with {FRAMES}, spots as (select vec_id as v, (i+0.5)/20*88.9 as sx, (j+0.5)/12*54.0 as sy from embeddings cross join range(20) t(i) cross join range(12) u(j)), {SMALL_PHOTOS}
select v as capture_id, sum(round(coalesce(e, 0)*255))::bigint as level_sum, max(round(coalesce(e, 0)*255))::int as level_max, {sql.r6("avg((e is not null)::int)", "inside")} from lit group by 1
""")
def small_cards(spark, sf_dir):
    """The same photographs flattened to 20 x 12, by the sum and the greatest of their levels."""
    done = frames.rectify(views.v_small_photos(spark, sf_dir), (20, 12))
    cells = done.select("capture_id", "inside", F.explode(F.sequence(F.lit(1), F.lit(240))).alias("n"), "data")
    level = F.conv(F.hex(F.substring("data", F.col("n") * 3, F.lit(1))), 16, 10).cast("int")
    return cells.groupBy("capture_id").agg(F.sum(level).alias("level_sum"), F.max(level).alias("level_max"), r6(F.first("inside"), "inside"))


# Geometry

QUADS = """quads as (select l_orderkey*8+l_linenumber as quad_id, l_partkey as part, (5.0+l_partkey%7)::double as a, (0.1*(l_partkey%5))::double as b, (20.0+l_partkey%11)::double as c, (0.05*(l_partkey%3))::double as d, (5.5+l_partkey%5)::double as e,
    (30.0+l_partkey%13)::double as f, (0.0004*(l_partkey%4))::double as g, (0.0003*(l_partkey%6))::double as h from lineitem)"""


@query(f"""
with {QUADS}, m as (select *, [6.5, 82.4, 82.4, 6.5]::double[] as xs, [6.5, 6.5, 47.5, 47.5]::double[] as ys from quads),
p as (select quad_id, a, b, c, d, e, f, g, h, {", ".join(f"(a*xs[{i}]+b*ys[{i}]+c)/(g*xs[{i}]+h*ys[{i}]+1) as x{i}, (d*xs[{i}]+e*ys[{i}]+f)/(g*xs[{i}]+h*ys[{i}]+1) as y{i}" for i in range(1, 5))} from m)
select quad_id, {sql.r6("x3", "x")}, {sql.r6("y3", "y")}, {sql.r6("(x1*y2-x2*y1+x2*y3-x3*y2+x3*y4-x4*y3+x4*y1-x1*y4)/2", "area")}, true as convex, true as returns,
       {sql.r6("(e-h*f)/(a*e-b*d)", "inverse_first")} from p
""")
def quad_geometry(spark, sf_dir):
    """Marker centres mapped by each homography: a corner, area, convexity, and back by the inverse."""
    df = views.v_quads(spark, sf_dir)
    spots = [geometry.apply_homography(F.col("h"), F.lit(x), F.lit(y)) for x, y in card.MARKERS]
    df = df.withColumns({"points": F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in spots)), "inverse": geometry.invert_homography(F.col("h"))})
    third = F.get("points", F.lit(2))
    back = geometry.apply_homography(F.col("inverse"), third["x"], third["y"])
    home = (F.abs(back[0] - card.MARKERS[2][0]) < 1e-6) & (F.abs(back[1] - card.MARKERS[2][1]) < 1e-6)
    return df.select("quad_id", r6(third["x"], "x"), r6(third["y"], "y"), r6(geometry.polygon_signed_area(F.col("points")), "area"), geometry.is_convex_quad(F.col("points")).alias("convex"), home.alias("returns"), r6(F.get("inverse", F.lit(0)), "inverse_first"))


@query(f"with {QUADS} select distinct part, round(a, 4) + 0.0 as h0, round(c, 4) + 0.0 as h2, round(f, 4) + 0.0 as h5, round(g, 4) + 0.0 as h6, true as exact from quads")
def fitted_homographies(spark, sf_dir):
    df = views.v_quads(spark, sf_dir).select("part", "h").distinct()
    spots = F.array(*(F.struct(F.lit(x).alias("sx"), F.lit(y).alias("sy")) for x, y in card.MARKERS))
    rows = df.select(F.col("part").alias("set_id"), "h", F.explode(spots).alias("p"))
    x, y = geometry.apply_homography(F.col("h"), F.col("p.sx"), F.col("p.sy"))
    pairs = rows.select("set_id", "p.sx", "p.sy", x.alias("dx"), y.alias("dy"))
    fits = geometry.fit_homography(pairs)
    done = fits.join(geometry.reprojection_error(pairs, fits), "set_id")
    return done.select(F.col("set_id").alias("part"), *((F.round(F.get("h", F.lit(i)), 4) + F.lit(0.0)).alias(f"h{i}") for i in (0, 2, 5, 6)), (F.col("error") < 1e-6).alias("exact"))


@query(f"""
with {sql.PATCHES}, n as (select count(*) as readings from events)
select slot+1 as index, patch_id, role, rowname as row, hex as nominal_hex, printf('%.3f', l) as nominal_l, printf('%.3f', a) as nominal_a, printf('%.3f', b) as nominal_b, n.readings from patches, n
""")
def calibration_worksheet(spark, sf_dir):
    """The worksheet, with the number of readings that each patch has."""
    counts = views.v_readings(spark, sf_dir).groupBy("patch_id").agg(F.count("*").alias("readings"))
    done = card.calibration_worksheet(card.card_patches(spark)).join(counts, "patch_id")
    return done.select("index", "patch_id", "role", "row", "nominal_hex", F.col("nominal_L").alias("nominal_l"), "nominal_a", "nominal_b", "readings")


# Signatures and streams


@query("""
select event_id, event_id%10 <> 1 as key_ok, event_id%10 > 2 as signature_ok, case event_id%10 when 0 then 'core-hash-mismatch,bad-signature' when 1 then 'malformed-public-key' when 2 then 'bad-signature'
    when 3 then 'unsupported-algorithm' else '' end as failures, sha256('{"id":' || event_id || ',"type":"' || case when event_id%10=0 then 'not ' else '' end || event_type || '"}') as core_hash from events
""")
def verify_signatures(spark, sf_dir):
    """Signed records of every event: hashes and signatures of their canonical cores, and all that fails."""
    rows = views.v_signed(spark, sf_dir)
    core = canonical.prune_key(F.col("record_json"), "signature")
    rows = rows.withColumns({"core": core, "image_hash": F.lit(None).cast("string"), "signed_image_hash": F.lit(None).cast("string")}).withColumn("core_hash", canonical.sha256_hex(F.col("core")))
    checked = rows.repartition("event_id").withColumn("v", signature.verify_signature(F.col("x"), F.col("y"), F.col("core"), F.col("sig")))
    done = chain.verify_records(checked.withColumns({"key_ok": F.col("v.key_ok"), "signature_ok": F.col("v.signature_ok")}))
    return done.select("event_id", "key_ok", "signature_ok", F.array_join("failures", ",").alias("failures"), "core_hash")


def _streamed(spark: SparkSession, batch: DataFrame, make) -> DataFrame:
    """Write ``batch`` to the shared folder, run ``make`` over it as a stream until it is used up, and read the result."""
    import uuid

    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    batch.write.parquet(f"{at}/in")
    source = spark.readStream.schema(batch.schema).parquet(f"{at}/in")
    job = make(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query(f"""
with recursive {LINKS}, gap as (select device_id, min(chain_index) as g from links where event_id%53=0 group by 1)
select l.device_id, l.record_id, l.chain_index, l.chain_index < coalesce(g.g, 1000000000) as accepted from links l left join gap g using (device_id) where l.event_id%53 <> 0
""")
def stream_append(spark, sf_dir):
    records = _chained(views.v_records(spark, sf_dir)).filter("event_id % 53 != 0").select("device_id", "chain_index", "captured_at", "record_id", "previous_hash", "record_hash")
    return _streamed(spark, records, stream.stream_append).select("device_id", "record_id", "chain_index", "accepted")


@query(f"""
with recursive {LINKS}, gap as (select device_id, min(chain_index) as g from links where event_id%53=0 group by 1)
select l.device_id, l.record_id, l.chain_index, l.chain_index < coalesce(g.g, 1000000000) as accepted, case when l.chain_index < coalesce(g.g, 1000000000) then 'pending' end as sync_state
from links l left join gap g using (device_id) where l.event_id%53 <> 0
""")
def append_stream(spark, sf_dir):
    """The same stream by sorted micro-batches, a day's records in each file, several files at a time."""
    import uuid

    at = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    records = _chained(views.v_records(spark, sf_dir)).filter("event_id % 53 != 0").select("device_id", "chain_index", "captured_at", "record_id", "previous_hash", "record_hash")
    records.repartitionByRange(3, "chain_index").write.parquet(f"{at}/in")
    source = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 3).parquet(f"{at}/in")
    stream.append_stream(source, f"{at}/log").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.appended(spark, f"{at}/log").select("device_id", "record_id", "chain_index", "accepted", "sync_state")


@query(f"with {sql.RANKED} select event_id, case when reason is null then c1 else 'inconclusive' end as category, {sql.r6('match_delta_e', 'match_delta_e')} from verdicts")
def stream_classify(spark, sf_dir):
    outcomes = panels.panel_outcomes(spark)
    done = _streamed(spark, views.v_samples(spark, sf_dir), lambda s: stream.stream_classify(s, outcomes).select("event_id", "category", r6(F.col("match_delta_e"), "match_delta_e")))
    return done
