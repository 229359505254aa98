"""Benchmark decontamination by spaced seeds.

Fixed masks pick some words of a window and ignore the others. Hashes of the picked words of benchmark items and of
training texts are joined; each hit names a diagonal on which item and text are compared word by word, so passages
with substituted words are found and chance hits are not. A bitmap of the benchmark's hashes keeps all other training
hashes out of the join.

The masks are lossless: every run that keeps the rule of overlaps holds one of them untouched. (A longer run holds one of 13 to
25 words that keeps it, and for these a test goes through all patterns.) Items under 13 words are cut in one part more
than the rule allows substitutions, so one part is untouched; the parts are seeds of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.text import blocks, cut_by, identified, joined_words, map_columns, map_rows, mix, stored, text_bytes, window_hashes, word_factors

#: The picked places of each seed.
MASKS = ("11101011", "101001111", "111111", "11011101")
LEAST_WORDS = 13
LEAST_SHARE = 0.8
#: Shorter items are found only as a whole text: a few words stand in texts that have nothing to do with them.
SHORTEST = 5
#: Against +1 for an equal word: a run has a sum of at least 0 if at least LEAST_SHARE of it are equal.
MISMATCH = -4
#: Of bits in the bitmap, as a power of two: what the driver and each task hold is at most 8 MB.
LEAST_BITS, MOST_BITS = 16, 26
#: Bits of the bitmap for each seed, as far as it may grow, and the places at which a seed is marked.
BITS_A_SEED, PROBES = 64, 4
#: Leaking rows, or seeds of the benchmark, up to which they are sent to every task.
FEW_ROWS = 100_000
#: Beyond that, seeds of the benchmark are repeated so many times, so that the texts of a hot one meet it in as many tasks.
SALTS = 16
#: What parts words: everything in ASCII but letters and digits.
SEPARATORS = np.ones(256, bool)
SEPARATORS[48:58] = SEPARATORS[65:91] = SEPARATORS[97:123] = SEPARATORS[128:] = False


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the picked words at each place where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = word_factors(len(mask))
    h = np.zeros(n, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            h += words[j : j + n] * factors[j]
    return mix(h)


def parts_of(n: int) -> list[tuple[int, int]]:
    """(start, words) of the parts of an item of n words, SHORTEST to LEAST_WORDS - 1: one more than it may have substitutions."""
    cuts = np.linspace(0, n, int(n * (1 - LEAST_SHARE) + 1e-9) + 2).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _windows(words: np.ndarray, texts: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = window_hashes(words, width)
    at = np.flatnonzero(texts[: len(h)] == texts[width - 1 :]) if len(h) else np.zeros(0, np.int64)
    return mix(h[at] + np.uint64(len(MASKS) + width)), texts[at], at - first[texts[at]]


def all_seeds(words: np.ndarray, first: np.ndarray, parts: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of every seed of some texts, whose words begin at ``first``: each mask, and each window of ``parts`` words. A
    text under SHORTEST words has one seed, all its words."""
    texts, out = np.repeat(np.arange(len(first) - 1), np.diff(first)), []
    for k, mask in enumerate(MASKS):
        h = seeds(words, mask)
        at = np.flatnonzero(texts[: len(h)] == texts[len(mask) - 1 :]) if len(h) else np.zeros(0, np.int64)
        out.append((mix(h[at] + np.uint64(k)), texts[at], at - first[texts[at]]))
    out += [_windows(words, texts, first, width) for width in parts]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHORTEST))
    whole = [int(window_hashes(words[first[t] : first[t + 1]], int(first[t + 1] - first[t]))[0]) for t in short.tolist()]
    out.append((mix(np.array(whole, np.uint64) + np.uint64(len(MASKS))), short, np.zeros(len(short), np.int64)))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def item_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the seeds of one item."""
    n, first = len(words), np.array([0, len(words)])
    if not SHORTEST <= n < LEAST_WORDS:
        h, _, at = all_seeds(words, first)
        return h, at
    found = [(_windows(words[a : a + m], np.zeros(m, np.int64), first[:1], m)[0], a) for a, m in parts_of(n)]
    return np.concatenate([h for h, _ in found]), np.array([a for _, a in found])


def overlaps(same: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Disjoint runs (from, to) of at least ``need`` places of which at least LEAST_SHARE are equal: the longest first,
    then those beside it. Unequal places at the ends are cut off as far as ``need`` lets."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, MISMATCH))])
    found, open_ = [], [(0, len(same))]
    while open_:
        low, high = open_.pop()
        if high - low < need:
            continue
        own = sums[low : high + 1]
        size = np.arange(len(own)) - np.searchsorted(-np.minimum.accumulate(own), -own, "left")
        end = int(np.argmax(size))
        i, j = low + end - int(size[end]), low + end
        if j - i < need:
            continue
        while j - i > need and not same[j - 1]:
            j -= 1
        while j - i > need and not same[i]:
            i += 1
        found.append((i, j))
        open_ += [(low, i), (j, high)]
    return sorted(found)


def diagonals(hits: list[tuple[np.ndarray, np.ndarray]], text: int, item: int) -> list[int]:
    """Differences of the places of all hits, in order. Memory grows with the lengths, not with the pairs of places."""
    seen = np.zeros(text + item + 1, bool)
    for p, q in hits:
        if len(p) < len(q):
            for x in p.tolist():
                seen[x - q + item] = True
        else:
            for x in q.tolist():
                seen[p - x + item] = True
    return (np.flatnonzero(seen) - item).tolist()


def matches(text: np.ndarray, item: np.ndarray, hits: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """(start in text, start in item, words, equal words) of each overlap of a text and an item, given as hashes of their
    words; ``hits`` are places in both that share a seed."""
    need, out = min(LEAST_WORDS, len(item)), []
    if len(item) < SHORTEST:
        return [(0, 0, len(item), len(item))] if np.array_equal(text, item) else []
    for shift in diagonals(hits, len(text), len(item)):
        a, b = max(0, -shift), min(len(item), len(text) - shift)
        same = item[a:b] == text[a + shift : b + shift]
        out += [(a + i + shift, a + i, j - i, int(same[i:j].sum())) for i, j in overlaps(same, need)]
    return out


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(n, item, size, words, seeds, places): every item, and its different seeds with their places."""

    def make():
        def each(keys, texts):
            for k, t in zip(keys, texts, strict=True):
                words, _, _ = joined_words([text_bytes(t)], True, SEPARATORS)
                h, at = item_seeds(words)
                yield k, len(words), words.tobytes(), h.tobytes(), at.astype("<u4").tobytes()

        return each

    kind = benchmark.schema[key].dataType.simpleString()
    found = map_rows(benchmark.select(key, text), make, f"item {kind}, size long, words binary, seeds binary, places binary")
    return stored(found.withColumn("n", F.monotonically_increasing_id()), "items")


def _by_seed(rows: DataFrame) -> DataFrame:
    """(h, n, at): one row for each different seed of a row, with its places."""

    def make():
        def each(numbers, raws, places):
            for n, raw, own in zip(numbers, raws, places, strict=True):
                h, at = np.frombuffer(raw, np.uint64), np.frombuffer(own, "<u4")
                order = np.argsort(h, kind="stable")
                for k, a, b in cut_by(h[order].view(np.int64)):
                    yield k, n, at[order[a:b]].tobytes()

        return each

    return map_rows(rows.select("n", "seeds", "places"), make, "h long, n long, at binary")


def _probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The bit at which seeds are marked for the k-th time."""
    return (mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) if k else h) >> np.uint64(64 - bits)


def _marked(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes of which all bits are marked."""
    near = np.arange(len(h))
    for k in range(PROBES):
        at = _probe(h[near], k, bits)
        near = near[(bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0]
    return near


def _bitmap(seeds_of: DataFrame) -> tuple[int, np.ndarray]:
    """(bits as a power of two, bitmap in 64-bit words) of all seeds; at most 2**20 words reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(BITS_A_SEED * seeds_of.count()).bit_length()))

    def make():
        own = np.zeros(1 << bits - 6, np.uint64)

        def each(hashes):
            h = np.array(hashes, np.int64).view(np.uint64)
            for k in range(PROBES):
                at = _probe(h, k, bits)
                np.bitwise_or.at(own, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            return ()

        def rest():
            at = np.flatnonzero(own)
            for i in range(0, len(at), 1 << 16):
                yield at[i : i + (1 << 16)], own[at[i : i + (1 << 16)]].view(np.int64)

        each.rest = rest
        return each

    found = map_columns(seeds_of.select("h"), make, "w long, b long").groupBy("w").agg(F.expr("bit_or(b)").alias("b")).collect()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[[r["w"] for r in found]] = np.array([r["b"] for r in found], np.int64).view(np.uint64)
    return bits, words


def _near(docs: DataFrame, key: str, text: str, bits: int, bitmap, parts: tuple[int, ...]) -> DataFrame:
    """(n, own_key, id_a, id_b, words, seeds, places) of the texts with a seed that the bitmap lets pass."""

    def make():
        seen = bitmap.value

        def each(keys, one, two, texts):
            raws = [text_bytes(t) for t in texts]
            for block in blocks(raws):
                words, _, first = joined_words([raws[i] for i in block], True, SEPARATORS)
                h, whose, at = all_seeds(words, first, parts)
                near = _marked(seen, h, bits)
                near = near[np.argsort(whose[near], kind="stable")]
                for d, a, b in cut_by(whose[near]):
                    own, i = near[a:b], block.start + d
                    yield keys[i], one[i], two[i], words[first[d] : first[d + 1]].tobytes(), h[own].tobytes(), at[own].astype("<u4").tobytes()

        return each

    kind = docs.schema[key].dataType.simpleString()
    named = identified(docs.select(key, text), key, text).select(F.col("id_row")[key].alias("own_key"), "id_a", "id_b", "id_text")
    found = map_rows(named, make, f"own_key {kind}, id_a long, id_b long, words binary, seeds binary, places binary")
    return stored(found.withColumn("n", F.monotonically_increasing_id()), "near")


def _leaks(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str) -> DataFrame:
    """(own_key, id_a, id_b, item, doc_start, item_start, n_words, n_equal)."""
    items = _items(benchmark, item, item_text)
    known = stored(_by_seed(items), "seeds")
    bits, bitmap = _bitmap(known)
    sizes = items.filter(F.col("size").between(SHORTEST, LEAST_WORDS - 1)).select("size").distinct().collect()
    parts = tuple(sorted({m for r in sizes for _, m in parts_of(r["size"])}))
    near = _near(docs, key, text, bits, docs.sparkSession.sparkContext.broadcast(bitmap), parts)
    found, known = _by_seed(near), known.select("h", F.col("n").alias("i"), F.col("at").alias("item_at"))
    if known.count() <= FEW_ROWS:
        hits = found.join(F.broadcast(known), "h")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = found.withColumn("salt", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    pairs = hits.groupBy("n", "i").agg(F.collect_list(F.struct("at", "item_at")).alias("hits"))
    both = pairs.join(near.select("n", "own_key", "id_a", "id_b", "words"), "n").join(items.select(F.col("n").alias("i"), "item", F.col("words").alias("item_words")), "i")

    def make():
        def each(keys, one, two, ids, texts, others, found):
            for k, a, b, i, t, o, own in zip(keys, one, two, ids, texts, others, found, strict=True):
                at = [(np.frombuffer(x["at"], "<u4").astype(np.int64), np.frombuffer(x["item_at"], "<u4").astype(np.int64)) for x in own]
                for m in matches(np.frombuffer(t, np.uint64), np.frombuffer(o, np.uint64), at):
                    yield k, a, b, i, *m

        return each

    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"own_key {kind}, id_a long, id_b long, item {item_kind}, doc_start long, item_start long, n_words long, n_equal long"
    return map_rows(both.select("own_key", "id_a", "id_b", "item", "words", "item_words", "hits"), make, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, doc_start, item_start, n_words, n_equal) for each overlap of a text with a benchmark item.

    An overlap is a run on one diagonal of at least 13 words (or the whole item, if it has 5 to 12), of which at least 0.8 are
    equal, A-Z folded and signs ignored. Every run that keeps this rule is hit by a seed; every diagonal that a seed hits is
    judged by the rule alone, and its disjoint overlaps are all given, the longest first. An item under 5 words
    overlaps only with a text of just its words.

    Both whole tables are used, and neither goes to the driver or to every task: only a bitmap of the benchmark's seeds
    does. Null and empty texts match nothing; repeated rows are matched alike; an empty benchmark gives no rows.
    """
    found = _leaks(docs, benchmark, key, text, item, item_text)
    return found.select(F.col("own_key").alias(key), F.col("item").alias(item), "doc_start", "item_start", "n_words", "n_equal")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows in which ``find_leaks`` finds an overlap."""
    gone = stored(_leaks(docs, benchmark, key, text, item, item_text).select("id_a", "id_b").distinct(), "leaks")
    few = F.broadcast(gone) if gone.count() <= FEW_ROWS else gone
    return identified(docs, key, text).join(few, ["id_a", "id_b"], "left_anti").select("id_row.*")
