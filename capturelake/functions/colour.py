"""Colour functions on columns. A colour is three columns; every function returns columns and nothing is shuffled.

Null components give null. sRGB and linear light are 0..1 (values beyond keep their sign), Lab is CIE Lab under D65
unless another white is given.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: CIE white points, sRGB and Bradford matrices, CIE constants.
D65 = (0.9504559270516716, 1.0, 1.0890577507598784)
D50 = (0.9642956764295677, 1.0, 0.8251046025104602)
RGB_TO_XYZ = (
    (0.4123907992659595, 0.35758433938387796, 0.1804807884018343),
    (0.21263900587151036, 0.7151686787677559, 0.07219231536073371),
    (0.01933081871559185, 0.11919477979462599, 0.9505321522496606),
)
XYZ_TO_RGB = (
    (3.2409699419045213, -1.5373831775700935, -0.4986107602930033),
    (-0.9692436362808798, 1.8759675015077206, 0.04155505740717561),
    (0.05563007969699361, -0.20397695888897657, 1.0569715142428786),
)
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
EPSILON = 216 / 24389
KAPPA = 24389 / 27
LUMINANCE = (0.2126, 0.7152, 0.0722)

Triple = tuple[Column, Column, Column]


def _times(matrix, triple: Triple) -> Triple:
    return tuple(sum((row[i] * triple[i] for i in range(1, 3)), row[0] * triple[0]) for row in matrix)


def srgb_to_linear(c: Column) -> Column:
    size = F.abs(c)
    return F.when(size <= 0.04045, c / 12.92).otherwise(F.signum(c) * F.pow((size + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    size = F.abs(c)
    return F.when(size <= 0.0031308, c * 12.92).otherwise(F.signum(c) * (1.055 * F.pow(size, F.lit(1 / 2.4)) - 0.055))


def linear_rgb_to_xyz(rgb: Triple) -> Triple:
    return _times(RGB_TO_XYZ, rgb)


def xyz_to_linear_rgb(xyz: Triple) -> Triple:
    return _times(XYZ_TO_RGB, xyz)


def xyz_to_lab(xyz: Triple, white=D65) -> Triple:
    def f(t: Column) -> Column:
        return F.when(t > EPSILON, F.cbrt(t)).otherwise((KAPPA * t + 16) / 116)

    x, y, z = (f(c / w) for c, w in zip(xyz, white, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def lab_to_xyz(lab: Triple, white=D65) -> Triple:
    level, a, b = lab
    y = (level + 16) / 116

    def inverse(t: Column) -> Column:
        cubed = t * t * t
        return F.when(cubed > EPSILON, cubed).otherwise((116 * t - 16) / KAPPA)

    return tuple(inverse(t) * w for t, w in zip((y + a / 500, y, y - b / 200), white, strict=True))


def linear_rgb_to_lab(rgb: Triple) -> Triple:
    return xyz_to_lab(linear_rgb_to_xyz(rgb))


def lab_to_linear_rgb(lab: Triple) -> Triple:
    return xyz_to_linear_rgb(lab_to_xyz(lab))


def srgb_to_lab(rgb: Triple) -> Triple:
    return linear_rgb_to_lab(tuple(srgb_to_linear(c) for c in rgb))


def lab_to_srgb(lab: Triple) -> Triple:
    return tuple(linear_to_srgb(c) for c in lab_to_linear_rgb(lab))


def lab_to_lch(lab: Triple) -> Triple:
    """Lightness, chroma, and hue in degrees, 0 <= hue < 360."""
    hue = F.degrees(F.atan2(lab[2], lab[1]))
    return lab[0], F.hypot(lab[1], lab[2]), F.when(hue < 0, hue + 360).otherwise(hue)


def lch_to_lab(lch: Triple) -> Triple:
    angle = F.radians(lch[2])
    return lch[0], lch[1] * F.cos(angle), lch[1] * F.sin(angle)


def rgb8_to_rgb(c: Column) -> Column:
    return c / F.lit(255.0)


def clamp01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def rgb_to_rgb8(c: Column) -> Column:
    """The nearest of 256 levels, half up, after clamping."""
    return F.floor(clamp01(c) * 255 + 0.5).cast("int")


def rgb_to_hex(rgb: Triple) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(rgb_to_rgb8(c)), 2, "0")) for c in rgb))


def hex_to_rgb(text: Column, strict: bool = True) -> Triple:
    """Six or three digits with an optional sign before them; anything else is an error, or null if not ``strict``."""
    digits = F.regexp_replace(F.trim(text), "^#", "")
    full = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    good = full.rlike("^[0-9a-fA-F]{6}$")
    bad = F.raise_error(F.concat(F.lit("not a colour: "), text)) if strict else F.lit(None)
    checked = F.when(text.isNull() | good, full).otherwise(bad.cast("string"))
    return tuple(F.conv(F.substring(checked, i, 2), 16, 10).cast("double") / 255 for i in (1, 3, 5))


def relative_luminance(rgb: Triple) -> Column:
    return LUMINANCE[0] * rgb[0] + LUMINANCE[1] * rgb[1] + LUMINANCE[2] * rgb[2]


def _inverse(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    rows = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(x / det for x in row) for row in rows)


def adapt_xyz(xyz: Triple, source, target) -> Triple:
    """Bradford chromatic adaptation from one white point to another."""
    cone = lambda w: tuple(sum(row[i] * w[i] for i in range(3)) for row in BRADFORD)
    gains = tuple(t / s for s, t in zip(cone(source), cone(target), strict=True))
    scaled = tuple(c * g for c, g in zip(_times(BRADFORD, xyz), gains, strict=True))
    return _times(_inverse(BRADFORD), scaled)


def delta_e_76(one: Triple, two: Triple) -> Column:
    return F.sqrt(sum((F.pow(x - y, F.lit(2)) for x, y in zip(one, two, strict=True)), F.lit(0.0)))


def delta_e_94(reference: Triple, sample: Triple) -> Column:
    """CIE 1994, graphic arts; differences are weighted by the reference's chroma."""
    c1, c2 = F.hypot(reference[1], reference[2]), F.hypot(sample[1], sample[2])
    dl, dc = reference[0] - sample[0], c1 - c2
    dh2 = F.greatest(F.lit(0.0), F.pow(reference[1] - sample[1], F.lit(2)) + F.pow(reference[2] - sample[2], F.lit(2)) - dc * dc)
    return F.sqrt(dl * dl + F.pow(dc / (1 + 0.045 * c1), F.lit(2)) + dh2 / F.pow(1 + 0.015 * c1, F.lit(2)))


Step = Callable[[Callable[[str], str]], dict[str, str]]


def each(items: str, *steps: Step, keep: tuple[str, ...]) -> str:
    """SQL of an array with further fields for every item, computed step by step: an array of structs of the fields ``keep``.
    A step is given a function from the name of a field (of a step before it, or "item") to its SQL, and returns SQL by name;
    what several later ones use is then evaluated once. Fields are carried only as far as they are used."""
    used: list[set[str]] = []
    made: list[dict[str, str]] = []
    for step in steps:
        own: set[str] = set()
        made.append(step(lambda n, own=own: own.add(n) or f"s.{n}"))
        used.append(own)
    out, known = f"transform({items}, x -> named_struct('item', x))", {"item"}
    for i, fields in enumerate(made):
        live = set(keep).union(*used[i + 1 :])
        parts = [*(f"'{n}', s.{n}" for n in sorted(known & live)), *(f"'{n}', {e}" for n, e in fields.items())]
        out = f"transform({out}, s -> named_struct({', '.join(parts)}))"
        known = known & live | set(fields)
    return out


def together(*sequences: list[Step]) -> list[Step]:
    """Steps of several sequences of one length, taken side by side."""
    return [lambda c, own=own: {n: e for step in own for n, e in step(c).items()} for own in zip(*sequences, strict=True)]


def lab_steps(rgb: Callable, out: str) -> list[Step]:
    """Steps for ``each``: linear light, given by ``rgb`` as a triple of SQL, to fields <out>L, <out>a and <out>b."""
    red, green, blue = (f"{out}_{c}" for c in ("r", "g", "b_"))
    xyz = [f"{out}_{c}" for c in "xyz"]
    edge = lambda t: f"case when {t} > {EPSILON!r}D then cbrt({t}) else ({KAPPA!r}D * {t} + 16) / 116 end"
    return [
        lambda c: dict(zip((red, green, blue), rgb(c), strict=True)),
        lambda c: {k: f"({m[0]!r}D * {c(red)} + {m[1]!r}D * {c(green)} + {m[2]!r}D * {c(blue)}) / {w!r}D" for k, m, w in zip(xyz, RGB_TO_XYZ, D65, strict=True)},
        lambda c: {f"{k}f": edge(c(k)) for k in xyz},
        lambda c: {f"{out}L": f"116 * {c(f'{out}_yf')} - 16", f"{out}a": f"500 * ({c(f'{out}_xf')} - {c(f'{out}_yf')})", f"{out}b": f"200 * ({c(f'{out}_yf')} - {c(f'{out}_zf')})"},
    ]


#: CIEDE2000 after the two Lab triples (l1, a1, b1) and (l2, a2, b2), step by step.
_DELTA_E = (
    {"c7": "power((hypot({a1}, {b1}) + hypot({a2}, {b2})) / 2, 7)"},
    {"g": "1.5D - 0.5D * sqrt({c7} / ({c7} + 6103515625D))"},
    {"p1": "{a1} * {g}", "p2": "{a2} * {g}"},
    {"k1": "hypot({p1}, {b1})", "k2": "hypot({p2}, {b2})", "t1": "degrees(atan2({b1}, {p1}))", "t2": "degrees(atan2({b2}, {p2}))"},
    {"h1": "case when {t1} < 0 then {t1} + 360 else {t1} end", "h2": "case when {t2} < 0 then {t2} + 360 else {t2} end", "grey": "{k1} * {k2} = 0"},
    {"d": "{h2} - {h1}", "s": "{h1} + {h2}"},
    {
        "turn": "case when {grey} then 0D when {d} > 180 then {d} - 360 when {d} < -180 then {d} + 360 else {d} end",
        "h": "case when {grey} then {s} when abs({d}) <= 180 then {s} / 2 when {s} < 360 then ({s} + 360) / 2 else ({s} - 360) / 2 end",
        "l": "({l1} + {l2}) / 2",
        "k": "({k1} + {k2}) / 2",
    },
    {
        "t": "1 - 0.17D * cos(radians({h} - 30)) + 0.24D * cos(radians(2 * {h})) + 0.32D * cos(radians(3 * {h} + 6)) - 0.2D * cos(radians(4 * {h} - 63))",
        "q": "power({l} - 50, 2)",
        "k7": "power({k}, 7)",
        "bend": "radians(60 * exp(-power(({h} - 275) / 25, 2)))",
    },
    {
        "dl": "({l2} - {l1}) / ({kl}D * (1 + 0.015D * {q} / sqrt(20 + {q})))",
        "dc": "({k2} - {k1}) / ({kc}D * (1 + 0.045D * {k}))",
        "dh": "2 * sqrt({k1} * {k2}) * sin(radians({turn} / 2)) / ({kh}D * (1 + 0.015D * {k} * {t}))",
        "r": "-2 * sqrt({k7} / ({k7} + 6103515625D)) * sin({bend})",
    },
    {"": "sqrt(greatest(0D, {dl} * {dl} + {dc} * {dc} + {dh} * {dh} + {r} * {dc} * {dh}))"},
)
_DELTA_E_FIELDS = ("l1", "a1", "b1", "l2", "a2", "b2", *(n for step in _DELTA_E for n in step if n))


def delta_e_2000_steps(out: str, weights=(1.0, 1.0, 1.0)) -> list[Step]:
    """CIEDE2000 of fields <out>__l1, a1, b1 and l2, a2, b2 as further steps: the last one makes ``out``."""
    known = dict(zip(("kl", "kc", "kh"), map(repr, weights), strict=True))

    def step(made: dict[str, str]) -> Step:
        return lambda c: {f"{out}__{n}" if n else out: e.format(**known, **{f: c(f"{out}__{f}") for f in _DELTA_E_FIELDS}) for n, e in made.items()}

    return [step(made) for made in _DELTA_E]


def delta_e_2000_start(reference: Callable, sample: Callable, out: str) -> Step:
    """The step before ``delta_e_2000_steps``: two Lab triples of SQL."""
    return lambda c: dict(zip((f"{out}__{n}" for n in ("l1", "a1", "b1", "l2", "a2", "b2")), (*reference(c), *sample(c)), strict=True))


def with_delta_es_2000(df: DataFrame, pairs: dict[str, tuple[Triple, Triple]], weights=(1.0, 1.0, 1.0)) -> DataFrame:
    """Add CIEDE2000 of several (reference, sample) pairs as columns of the given names. All are built step by step
    together, so that the plan stays small; helper columns are dropped."""
    start = {f"{out}__{n}": c for out, (r, s) in pairs.items() for n, c in zip(("l1", "a1", "b1", "l2", "a2", "b2"), (*r, *s), strict=True)}
    df, helpers = df.withColumns(start), [*start]
    for step in together(*(delta_e_2000_steps(out, weights) for out in pairs)):
        made = step(lambda n: f"`{n}`")
        df = df.withColumns({n: F.expr(e) for n, e in made.items()})
        helpers += [n for n in made if n not in pairs]
    return df.drop(*helpers)


def with_delta_e_2000(df: DataFrame, reference: Triple, sample: Triple, out: str, weights=(1.0, 1.0, 1.0)) -> DataFrame:
    """Add CIEDE2000 as column ``out``."""
    return with_delta_es_2000(df, {out: (reference, sample)}, weights)


def describe_delta_e(delta_e: Column) -> Column:
    labels = ((1, "indistinguishable to the eye"), (2, "only visible on close comparison"), (5, "noticeable difference"), (10, "clearly different"))
    out = F.when(delta_e < labels[0][0], labels[0][1])
    for limit, label in labels[1:]:
        out = out.when(delta_e < limit, label)
    return F.when(delta_e.isNotNull(), out.otherwise("very different"))


def round_measure(x: Column, places: int) -> Column:
    """Half up; null, NaN and infinities give null."""
    factor = 10.0**places
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)
    return F.when(finite, F.floor(x * factor + 0.5) / factor)


def hex_to_lab(text: str) -> tuple[float, float, float]:
    """Lab of a constant, for the tables that ship with the library."""
    rgb = [int(text[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    rgb = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in rgb]
    xyz = [sum(m * c for m, c in zip(row, rgb, strict=True)) for row in RGB_TO_XYZ]
    x, y, z = (t ** (1 / 3) if t > EPSILON else (KAPPA * t + 16) / 116 for t in (v / w for v, w in zip(xyz, D65, strict=True)))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)
