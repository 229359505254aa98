"""Suffix-array dedup: remove every byte of a passage of ``width`` bytes that also starts anywhere else.

1. Each text's windows are dealt into runs that share the smallest fingerprint of their ``gram``-byte substrings. The
   choice depends on a window's bytes alone, so equal windows fall into runs of one anchor, at equal distance from it.
2. Anchors that occur once hold no repeat. Runs with equal bytes are counted, not sorted.
3. An anchor with very many different byte strings is grown: each of its windows also holds more bytes after the anchor or
   before it, so runs are cut in two and dealt by the longer anchors, again until every group is small.
4. The different byte strings of an anchor are sorted by a linear suffix-array construction that groups suffixes by
   their Lyndon prefix; neighbours with a common prefix of ``width`` bytes are repeats.

The construction works on symbols that end at chosen bytes (white space in prose). Since no symbol is a prefix of
another, the order of symbol strings is the order of their bytes; windows that begin inside a symbol are compared by
the bytes before the next one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.text import Spans, identified, map_columns, map_rows, mix, released, stored, text_bytes

WIDTH = 400
GRAM = 128
#: Different strings of an anchor beyond which it is grown.
MANY = 4096
BLOCK = 1 << 18
LONGEST_SYMBOL = 64
#: What names a run's byte string: its anchor, 128 bits of its bytes, and its number of windows.
STRING = ("anchor", "body", "more", "n")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ENDS = []
for _test in (lambda b: b in b" \t\n\r", lambda b: b % 8 == 0 or b in b" \t\n\r", lambda b: True):
    _ENDS.append(np.array([_test(b) for b in range(256)]))


def lyndon_groups(symbols: list[int]) -> tuple[list[int], list[int]]:
    """(group, previous) of each suffix: the place of its group in sorted order, and the nearest earlier suffix in a
    smaller group. Suffixes of a group have the same Lyndon prefix. The last symbol must be the only smallest.

    Groups are taken from the greatest down. A group's Lyndon prefix is then final; suffixes to which its members point
    back take it (as many times as members point to them) behind what they had, and leave their groups upwards."""
    n = len(symbols)
    members: dict[int, list[int]] = {}
    group, previous = [0] * n, [-1] * n
    start_at = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        by_symbol.setdefault(c, []).append(i)
    at = 0
    for c in sorted(by_symbol):
        own = by_symbol[c]
        members[at] = own
        for i in own:
            group[i] = at
        start_at[at + len(own) - 1] = at
        at += len(own)
    last = n - 1
    end_of = {s: e for e, s in enumerate(start_at) if s or e == len(members[0]) - 1}
    while last >= 0:
        g = start_at[last]
        own = members.pop(g)
        if len(own) == 1:
            i = own[0]
            p = i - 1
            while p >= 0 and group[p] > g:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                h = group[p]
                e = end_of[h]
                if e > h:
                    group[p] = e
                    members[e] = [p]
                    members[h].remove(p) if e - h < 8 else members[h].append(-1 - p)
                    start_at[e], end_of[e] = e, e
                    start_at[e - 1], end_of[h] = h, e - 1
            last = g - 1
            continue
        own = sorted(i for i in own if i >= 0 and group[i] == g)
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and group[p] > g:
                p = previous[p]
            if p >= 0 and group[p] == g:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        for count in sorted(set(times.values()), reverse=True):
            moved: dict[int, list[int]] = {}
            for p, k in times.items():
                if k == count:
                    moved.setdefault(group[p], []).append(p)
            for h, out in moved.items():
                e = end_of[h]
                s = e - len(out) + 1
                if s == h:
                    continue
                for p in out:
                    group[p] = s
                members[s] = out
                start_at[e], end_of[s] = s, e
                start_at[s - 1], end_of[h] = h, s - 1
        last = g - 1
    return group, previous


def suffix_array(symbols: list[int]) -> list[int]:
    """The suffixes in order. Within a group the order is that of what follows the Lyndon prefix: taking suffixes
    in order, each emits those that end their Lyndon prefix where it begins."""
    n = len(symbols)
    group, previous = lyndon_groups(symbols)
    order, front = [n - 1] * n, list(range(n))
    front[0] = 1
    for i in range(n):
        s = order[i]
        p, stop = s - 1, previous[s]
        while p != stop:
            g = group[p]
            order[front[g]] = p
            front[g] += 1
            p = previous[p]
    return order


def _symbols(raw: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each symbol, of all strings; string of each): symbols end at a chosen byte or with a
    string, and are shorter than a window, so that each window holds the first byte of one."""
    for ends in _ENDS:
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:] = ends[raw]
        cut[starts] = True
        first = np.flatnonzero(cut[:-1])
        if np.diff(first, append=len(raw)).max() <= min(LONGEST_SYMBOL, width - 1):
            break
    return first, np.searchsorted(starts, first, "right") - 1


def repeated_windows(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string, which of its windows of ``width`` (at least 2) bytes also start elsewhere in these strings.

    A window is looked up by the first symbol that begins after its first byte: equal windows have it at the same
    distance c, whatever stands before them, so they share the c bytes before it and ``width - c`` bytes from there."""
    raw = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    stops = np.cumsum(sizes)
    starts = stops - sizes
    first, whose = _symbols(raw, starts, width)
    last = np.append(first[1:], len(raw))
    text = raw.tobytes()
    names = [text[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    rank = {s: i + len(strings) + 1 for i, s in enumerate(sorted(set(names)))}
    symbols, at = [], []
    for k, (name, w) in enumerate(zip(names, whose.tolist(), strict=True)):
        symbols.append(rank[name])
        at.append(k)
        if k + 1 == len(names) or whose[k + 1] != w:
            symbols.append(len(strings) - w)
            at.append(-1)
    symbols.append(0)
    at.append(-1)
    order = np.array(at)[np.array(suffix_array(symbols))]
    order = order[order >= 0]
    place, room = first[order], stops[whose[order]] - first[order]
    spans = Spans(raw)
    a, b = place[:-1], place[1:]
    low, high = np.zeros(len(a), np.int64), np.minimum(np.minimum(room[:-1], room[1:]), width)
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        n = np.where(open_, middle, 0)
        good = spans.of(a, a + n) == spans.of(b, b + n)
        low = np.where(open_ & good, middle, low)
        high = np.where(open_ & ~good, middle - 1, high)
    common = np.concatenate([[0], low])
    before = np.where(first[order] == starts[whose[order]], 0, place - first[np.maximum(order - 1, 0)])
    hit = np.zeros(len(raw), bool)
    for c in range(1, int(before.max()) + 1 if len(before) else 0):
        interval = np.cumsum(common < width - c)
        use = (before >= c) & (room >= width - c)
        linked = np.zeros(len(order), bool)
        linked[1:] = common[1:] >= width - c
        linked[:-1] |= linked[1:].copy()
        use = np.flatnonzero(use & linked)
        if not len(use):
            continue
        p = place[use]
        left = spans.of(p - c, p)
        order_of = np.lexsort((left, interval[use]))
        i, h = interval[use][order_of], left[order_of]
        new = np.ones(len(use), bool)
        new[1:] = (i[1:] != i[:-1]) | (h[1:] != h[:-1])
        inverse = np.empty(len(use), np.int64)
        inverse[order_of] = np.cumsum(new) - 1
        count = np.bincount(inverse)
        hit[p[count[inverse] > 1] - c] = True
    return [hit[s : s + max(0, n - width + 1)] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def fingerprints(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram``-byte substring. It only chooses anchors, so collisions cost time but no result."""
    up = np.full(len(raw) + 1, MULTIPLIER, np.uint64)
    down = np.full(len(raw) + 1, pow(int(MULTIPLIER), -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * up[:-1], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])


def digest(raw: bytes) -> tuple[int, int]:
    """128 bits that stand for some bytes, as two longs."""
    h = hashlib.blake2b(raw, digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def runs(text: bytes, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor, two longs of a hash of the bytes) of each run of windows with the same leftmost
    anchor."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < width:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    h = fingerprints(raw, gram)
    least = _least(h, width - gram + 1)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
    first = np.flatnonzero(new)
    count = np.diff(first, append=len(least))
    bodies = [digest(text[a : a + n + width - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
    return first, count, least[first].view(np.int64), *np.array(bodies, np.int64).reshape(-1, 2).T


def _find_runs(named: DataFrame, width: int, gram: int) -> DataFrame:
    def make():
        def each(a, b, texts):
            found = [runs(text_bytes(t), width, gram) for t in texts]
            n = [len(x[0]) for x in found]
            yield np.repeat(np.array(a, np.int64), n), np.repeat(np.array(b, np.int64), n), *(np.concatenate([x[i] for x in found]) for i in range(5))

        return each

    return map_columns(named.select("id_a", "id_b", "id_text"), make, "id_a long, id_b long, at long, n long, anchor long, body long, more long")


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def _sorted_groups(strings: DataFrame, width: int) -> DataFrame:
    """Repeats between the different strings of each anchor; rows come in order of the anchor."""

    def make():
        held: list[tuple] = []
        size, current = 0, None

        def flush():
            nonlocal held, size
            rows, held, size = held, [], 0
            masks = repeated_windows([r[5] for r in rows], width) if rows else []
            for (anchor, body, more, n, twice, _), mask in zip(rows, masks, strict=True):
                for low, high in [(0, n)] if twice else _ranges(mask):
                    yield anchor, body, more, n, low, high

        def each(*columns):
            nonlocal size, current
            for row in zip(*columns, strict=True):
                if row[0] != current and size > BLOCK:
                    yield from flush()
                current = row[0]
                held.append(row)
                size += len(row[5])

        each.rest = flush
        return each

    ordered = strings.select(*STRING, "twice", "raw").repartition("anchor").sortWithinPartitions("anchor")
    return map_rows(ordered, make, "anchor long, body long, more long, n long, low long, high long")


def grown(raw: bytes, n: int, at: int, width: int, gram: int, longer: int) -> list[tuple[int, int, bytes, int]]:
    """A run's windows in two parts (first window, windows, anchor of ``longer`` bytes, its place in the part): those that
    hold the bytes after the ``gram``-byte anchor at ``at``, and those that hold the bytes before it. Equal windows have
    their anchor at one distance, so they also meet by the longer one."""
    if at < 0:
        h = fingerprints(np.frombuffer(raw, np.uint8), gram)
        at = n - 1 + int(h[n - 1 : width - gram + 1].argmin())
    cut = min(n, max(0, at - (width - longer)))
    out = [(cut, n - cut, raw[at : at + longer], at - cut)] if cut < n else []
    return [*out, (0, cut, raw[at + gram - longer : at + gram], at + gram - longer)] if cut else out


def _parts(strings: DataFrame, width: int, gram: int, longer: int) -> DataFrame:
    """Strings of longer anchors with the strings that they are parts of; a part is known by its bytes and its place."""

    def make():
        def each(anchors, bodies, mores, ns, places, twice, raws):
            for anchor, body, more, n, at, two, raw in zip(anchors, bodies, mores, ns, places, twice, raws, strict=True):
                for low, size, key, place in grown(raw, n, at, width, gram, longer):
                    own = raw[low : low + size + width - 1]
                    yield anchor, body, more, n, low, digest(key)[0], *digest(own + place.to_bytes(8, "little")), size, place, two, own

        return each

    schema = "anchor long, body long, more long, n long, shift long, p_anchor long, p_body long, p_more long, p_n long, place long, twice boolean, raw binary"
    return map_rows(strings.select(*STRING, "place", "twice", "raw"), make, schema)


def _verdicts(strings: DataFrame, width: int, gram: int, many: int) -> DataFrame:
    """(anchor, body, more, n, low, high): windows of each different string (``twice`` tells that it occurs again) that
    also start elsewhere."""
    kinds = stored(strings.groupBy("anchor").agg(F.count("*").alias("d")), "kinds")
    strings = strings.join(kinds, "anchor")
    alone = strings.filter("d = 1 and twice").select(*STRING, F.lit(0).cast("long").alias("low"), F.col("n").alias("high"))
    done = alone.unionByName(_sorted_groups(strings.filter(f"d between 2 and {many}"), width))
    longer = gram + (width - gram + 1) // 2
    if longer == gram or kinds.filter(F.col("d") > many).isEmpty():
        return done
    parts = stored(_parts(strings.filter(F.col("d") > many), width, gram, longer), "parts")
    names = {f"p_{c}": c for c in STRING}
    distinct = parts.groupBy(*names).agg((F.max("twice") | (F.count("*") > 1)).alias("twice"), F.first("place").alias("place"), F.first("raw").alias("raw"))
    inner = _verdicts(stored(distinct.withColumnsRenamed(names), "grown"), width, longer, many)
    inner = inner.withColumnsRenamed({c: f"p_{c}" for c in STRING})
    back = parts.drop("raw", "twice", "place").join(inner, list(names))
    return done.unionByName(back.select(*STRING, (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high")))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """``docs`` with a column sd_spans: merged [start, end) bytes that lie in a ``width``-byte string which also starts
    anywhere else, in this text or another. Texts are UTF-8; null or short ones have no spans; matches never cross
    texts. Rows that repeat a key and text count as two places each and share their result. Anchors with more than
    ``many`` different strings are grown; results are the same for any.A column of a name that is added is replaced."""
    named = identified(docs, key, text, "sd_spans")
    every = stored(_find_runs(named, width, gram), "runs")
    shared = stored(every.groupBy("anchor").agg(F.count("*").alias("t")).filter("t > 1").select("anchor"), "anchors")
    found = stored(every.join(shared, "anchor", "left_semi"), "shared")
    released(every, shared)
    strings = found.groupBy(*STRING).agg((F.count("*") > 1).alias("twice"), F.min(F.struct("id_a", "id_b", "at")).alias("one"))
    strings = stored(strings.select(*STRING, "twice", "one.*"), "strings")
    kinds = stored(strings.groupBy("anchor").agg(F.count("*").alias("d")), "kinds")
    strings = strings.join(kinds, "anchor")
    alike = strings.filter("d = 1 and twice").select(*STRING, F.lit(0).cast("long").alias("low"), F.col("n").alias("high"))
    differ = strings.filter("d > 1").groupBy("id_a", "id_b").agg(F.collect_list(F.struct(*STRING, "twice", "at")).alias("parts"))

    def make():
        def each(texts, parts):
            for t, own in zip(texts, parts, strict=True):
                raw = text_bytes(t)
                for p in own:
                    yield *(p[c] for c in STRING), -1, p["twice"], raw[p["at"] : p["at"] + p["n"] + width - 1]

        return each

    one_each = named.select("id_a", "id_b", "id_text").join(differ, ["id_a", "id_b"]).select("id_text", "parts")
    cut = map_rows(one_each, make, "anchor long, body long, more long, n long, place long, twice boolean, raw binary").dropDuplicates(list(STRING))
    verdicts = stored(alike.unionByName(_verdicts(stored(cut, "cut"), width, gram, many)), "verdicts")
    spans = (
        found.join(verdicts, list(STRING))
        .groupBy("id_a", "id_b").agg(F.collect_set(F.struct((F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high") + width - 1).alias("end"))).alias("sd_raw"))
    )
    merged = F.aggregate(
        F.array_sort("sd_raw"), F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return named.join(spans, ["id_a", "id_b"], "left").select("id_row.*", merged.alias("sd_spans"))


def digests(done: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sizes and a hash of what stays of each text."""

    def make():
        def each(keys, texts, spans):
            for k, t, own in zip(keys, texts, spans, strict=True):
                raw, kept, at = text_bytes(t), [], 0
                for s in own or ():
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                kept = b"".join([*kept, raw[at:]])
                yield k, len(raw), len(raw) - len(kept), len(own or ()), hashlib.sha256(kept).hexdigest()

        return each

    kind = done.schema[key].dataType.simpleString()
    return map_rows(done.select(key, text, "sd_spans"), make, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
