"""DuckDB SQL of the derived views and colour formulas, for the queries' oracles. Written apart from the column code."""

from __future__ import annotations

from capturelake.functions.card import patch_rows
from capturelake.functions.panels import PANELS, outcome_rows

PI = "pi()"


def text(x) -> str:
    return "null" if x is None else f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else f"{x!r}::double" if isinstance(x, float) else str(x)


def values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(text(x) for x in r) + ")" for r in rows) + ")"


OUTCOMES = values("outcomes", "panel_id, panel_name, outcome_pos, outcome_id, label, category, hex, l, a, b, max_match, min_separation", [r[:10] + r[12:] for r in outcome_rows()])
PATCHES = values("patches", "patch_id, role, rowname, slot, ramp_pos, x, y, width, height, u, v, hex, l, a, b, ref_r, ref_g, ref_b", patch_rows())


def lab_of(x: str, y: str, z: str, pre: str) -> str:
    """Select items <pre>l, <pre>a, <pre>b of an XYZ triple (columns), by the CIE formulas."""
    f = lambda t: f"case when {t} > 216.0/24389 then cbrt({t}) else (24389.0/27*{t}+16)/116 end"
    return (
        f"{f(f'({x}/0.9504559270516716::double)')} as {pre}fx, {f(f'({y}/1.0::double)')} as {pre}fy, {f(f'({z}/1.0890577507598784::double)')} as {pre}fz, "
        f"116*{pre}fy-16 as {pre}l, 500*({pre}fx-{pre}fy) as {pre}a, 200*({pre}fy-{pre}fz) as {pre}b"
    )


def xyz_of(r: str, g: str, b: str, pre: str) -> str:
    m = ((0.4123907992659595, 0.35758433938387796, 0.1804807884018343), (0.21263900587151036, 0.7151686787677559, 0.07219231536073371), (0.01933081871559185, 0.11919477979462599, 0.9505321522496606))
    return ", ".join(f"{p}::double*{r}+{q}::double*{g}+{s}::double*{b} as {pre}{n}" for n, (p, q, s) in zip("xyz", m, strict=True))


def linear_of_lab(l: str, a: str, b: str, pre: str) -> str:  # noqa: E741
    """Select items <pre>r, <pre>g, <pre>b: linear light of a Lab triple, by the inverse of the sRGB matrix."""
    cubed = lambda t: f"case when pow({t},3) > 216.0/24389 then pow({t},3) else (116*{t}-16)/(24389.0/27) end"
    m = ((3.2409699419045213, -1.5373831775700935, -0.4986107602930033), (-0.9692436362808798, 1.8759675015077206, 0.04155505740717561), (0.05563007969699361, -0.20397695888897657, 1.0569715142428786))
    y = f"(({l}+16)/116.0)"
    parts = [f"{y}+{a}/500.0 as {pre}fx, {y} as {pre}fy, {y}-{b}/200.0 as {pre}fz", f"({cubed(f'{pre}fx')})*0.9504559270516716::double as {pre}x, {cubed(f'{pre}fy')} as {pre}y, ({cubed(f'{pre}fz')})*1.0890577507598784::double as {pre}z"]
    return ", ".join([*parts, *(f"{p}::double*{pre}x+{q}::double*{pre}y+{s}::double*{pre}z as {pre}{n}" for n, (p, q, s) in zip("rgb", m, strict=True))])


def linear_of(c: str) -> str:
    return f"case when abs({c}) <= 0.04045 then {c}/12.92 else sign({c})*pow((abs({c})+0.055)/1.055, 2.4) end"


def de2000(l1, a1, b1, l2, a2, b2, out: str) -> str:
    """Select items that end in <out>: CIEDE2000 by Sharma, Wu and Dalal's equations."""
    n = lambda s: f"{out}_{s}"
    rad = lambda s: f"({s})*{PI}/180"
    items = {
        "cb": f"(sqrt({a1}*{a1}+{b1}*{b1})+sqrt({a2}*{a2}+{b2}*{b2}))/2.0",
        "g": f"0.5*(1-sqrt(pow({n('cb')},7)/(pow({n('cb')},7)+6103515625.0)))",
        "x1": f"(1+{n('g')})*{a1}", "x2": f"(1+{n('g')})*{a2}",
        "c1": f"sqrt({n('x1')}*{n('x1')}+{b1}*{b1})", "c2": f"sqrt({n('x2')}*{n('x2')}+{b2}*{b2})",
        "t1": f"atan2({b1},{n('x1')})*180/{PI}", "t2": f"atan2({b2},{n('x2')})*180/{PI}",
        "h1": f"case when {n('t1')}<0 then {n('t1')}+360 else {n('t1')} end", "h2": f"case when {n('t2')}<0 then {n('t2')}+360 else {n('t2')} end",
        "dh": f"case when {n('c1')}*{n('c2')}=0 then 0 when {n('h2')}-{n('h1')}>180 then {n('h2')}-{n('h1')}-360 when {n('h2')}-{n('h1')}<-180 then {n('h2')}-{n('h1')}+360 else {n('h2')}-{n('h1')} end",
        "hm": f"case when {n('c1')}*{n('c2')}=0 then {n('h1')}+{n('h2')} when abs({n('h2')}-{n('h1')})<=180 then ({n('h1')}+{n('h2')})/2 when {n('h1')}+{n('h2')}<360 then ({n('h1')}+{n('h2')}+360)/2 else ({n('h1')}+{n('h2')}-360)/2 end",
        "lm": f"({l1}+{l2})/2.0", "cm": f"({n('c1')}+{n('c2')})/2.0",
        "t": f"1-0.17*cos({rad(n('hm') + '-30')})+0.24*cos({rad('2*' + n('hm'))})+0.32*cos({rad('3*' + n('hm') + '+6')})-0.20*cos({rad('4*' + n('hm') + '-63')})",
        "sl": f"1+0.015*pow({n('lm')}-50,2)/sqrt(20+pow({n('lm')}-50,2))", "sc": f"1+0.045*{n('cm')}", "sh": f"1+0.015*{n('cm')}*{n('t')}",
        "rt": f"-sin({rad(f'60*exp(-pow(({n('hm')}-275)/25,2))')})*2*sqrt(pow({n('cm')},7)/(pow({n('cm')},7)+6103515625.0))",
        "kl": f"({l2}-{l1})/{n('sl')}", "kc": f"({n('c2')}-{n('c1')})/{n('sc')}", "kh": f"2*sqrt({n('c1')}*{n('c2')})*sin({rad(n('dh') + '/2')})/{n('sh')}",
    }
    total = f"sqrt(greatest(0.0, pow({n('kl')},2)+pow({n('kc')},2)+pow({n('kh')},2)+{n('rt')}*{n('kc')}*{n('kh')})) as {out}"
    return ", ".join([*(f"{e} as {n(k)}" for k, e in items.items()), total])


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 as {name}"


PANEL_LIST = "[" + ", ".join(text(p) for p in PANELS) + "]"
SAMPLES = f"""{OUTCOMES}, sizes as (select panel_id, count(*) as n from outcomes group by 1),
samples as (
    select e.event_id, e.user_id, o.panel_id, o.l + (e.event_id*7%41-20)*0.9::double as l, o.a + (e.event_id*13%37-18)*0.9::double as a,
           o.b + (e.event_id*29%31-15)*0.9::double as b
    from (select *, {PANEL_LIST}[(user_id%4)::int+1] as panel_id from events) e join sizes s using (panel_id)
    join outcomes o on o.panel_id = e.panel_id and o.outcome_pos = e.event_id % s.n)"""
RANKED = f"""{SAMPLES}, ranked0 as (
    select s.event_id, s.panel_id, o.outcome_id, o.outcome_pos, o.category, o.max_match, o.min_separation, {de2000("o.l", "o.a", "o.b", "s.l", "s.a", "s.b", "d")}
    from samples s join outcomes o using (panel_id)),
ranked as (select event_id, panel_id, outcome_id, outcome_pos, category, max_match, min_separation, d,
    row_number() over (partition by event_id order by d, outcome_pos) as rank from ranked0),
best as (
    select event_id, panel_id, min(max_match) as mm, min(min_separation) as ms, min(d) filter (where rank=1) as d1, min(d) filter (where rank=2) as d2,
           min(outcome_id) filter (where rank=1) as o1, min(category) filter (where rank=1) as c1, min(outcome_id) filter (where rank=2) as o2
    from ranked group by 1, 2),
verdicts as (
    select event_id, panel_id, d1 as match_delta_e, d2-d1 as separation_delta_e,
           case when d1 > mm then 'no-reference-match' when d2-d1 < ms then 'ambiguous-between-outcomes' end as reason, o1, o2, c1 from best)"""
GAIN = lambda i, g: f"[{', '.join(str(x[i]) + '::double' for x in g)}][(e.event_id%5)::int+1]"


def readings(gains) -> str:
    part = lambda i, c: (
        f"p.ref_{c}*{GAIN(i, gains)}*(case when e.event_id%5=4 then 1+0.35*(p.u-0.5) else 1.0 end)"
        f"+(case when e.event_id%7=0 then 0.02 else 0.0 end)+((e.event_id*31+p.slot*17)%21-10)*0.0004::double as {c}"
    )
    return f"""{PATCHES}, readings as (
    select e.event_id as capture_id, e.user_id as card_serial, p.patch_id, p.slot, p.role, p.ramp_pos, p.u, p.v, {", ".join(part(i, c) for i, c in enumerate("rgb"))},
           p.ref_r, p.ref_g, p.ref_b, case when (e.event_id+p.slot)%53=0 then 0.5 else 0.0 end as clipped_fraction
    from events e cross join patches p)"""


def solve(prefix: str, n: int, matrix, sides, source: str) -> tuple[str, str]:
    """CTEs that solve n symmetric equations for several sides by Cramer-free elimination; returns (ctes, last name).
    matrix(i, j) and sides[k](i) are column names of ``source``; results are <prefix>x<k>_<i>."""
    ctes, name = [], source
    cells = ", ".join([f"{matrix(i, j)} as {prefix}m{i}{j}" for i in range(n) for j in range(n)] + [f"{s(i)} as {prefix}s{k}_{i}" for k, s in enumerate(sides) for i in range(n)])
    ctes.append(f"{prefix}0 as (select *, {cells} from {name})")
    for p in range(n):
        name, new = f"{prefix}{p}", f"{prefix}{p + 1}"
        pivot = f"(case when abs({prefix}m{p}{p}) >= 1e-12 then {prefix}m{p}{p} end)"
        changed = []
        for i in range(n):
            if i == p:
                continue
            changed += [f"{prefix}m{i}{j} - {prefix}m{i}{p}/{pivot}*{prefix}m{p}{j} as {prefix}m{i}{j}" for j in range(n)]
            changed += [f"{prefix}s{k}_{i} - {prefix}m{i}{p}/{pivot}*{prefix}s{k}_{p} as {prefix}s{k}_{i}" for k in range(len(sides))]
        ctes.append(f"{new} as (select * replace ({', '.join(changed)}) from {name})")
    out = ", ".join(f"{prefix}s{k}_{i}/(case when abs({prefix}m{i}{i}) >= 1e-12 then {prefix}m{i}{i} end) as {prefix}x{k}_{i}" for k in range(len(sides)) for i in range(n))
    ctes.append(f"{prefix}done as (select *, {out} from {prefix}{n})")
    return ", ".join(ctes), f"{prefix}done"
