"""N-gram Jaccard join with a token-group matrix.

A text's set is its distinct word shingles; two texts link when the Jaccard similarity of their sets reaches a
threshold. Equal sets are one. Sets in one order of shingles (commonest last) can only link when they share a shingle
of their prefixes, so prefixes give candidate lists.

Each list's sets are first tried against its hub, the set whose shingles most others have; linked sets form components.
Lists that still hold several components meet by the component of their hub, each set once. There, similar sets are a
group, and a token-group matrix stores every group's union of shingles: a set is looked up in it, the shingles that it
shares with a union bound its overlap with each member, and only groups that may qualify are opened. This is done with
bitmaps first, and what they let pass again with the shingles themselves. Sets leave the first, and only links that join
components leave the second, so results grow with the sets, not with pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.components import components
from capturelake.llm.text import blocks, bucket_count, bucket_of, by_bucket, cut_by, identified, joined_words, map_columns, mix, released, stored, text_bytes, window_hashes, word_hashes

WORDS = 5
PERCENT = 75
COMMON_IN = 32
COMMON_MOST = 1 << 17
#: Shingles of the sets that one matrix holds, or of the sets that are looked up in it.
BLOCK_SHINGLES = 1 << 20
GROUP_SETS = 64
#: Shingles whose bitmaps take the room of one shingle.
BLOCK_BITS = 32
#: Sets tried against one hub in one task.
HUB_SETS = 4096


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words, _, _ = word_hashes(np.frombuffer(text_bytes(text), np.uint8), fold=True)
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))))


def _sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """``shingles`` of several texts."""
    raws, out = [text_bytes(t) for t in texts], []
    for part in blocks(raws):
        words, doc, first = joined_words([raws[i] for i in part], True)
        h = window_hashes(words, width)
        for d in range(len(part)):
            a, b = first[d], first[d + 1]
            if b - a >= width:
                out.append(np.unique(h[a : b - width + 1]))
            else:
                out.append(window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def set_name(tokens: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| of two sorted sets."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m) or not n or not m:
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (n + m - same)


def sketch(tokens: np.ndarray) -> bytes:
    """Bitmap of a set, of about two bits a shingle; its length is a power of two, so longer ones fold."""
    bits = max(64, 1 << int(2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    marks = np.zeros(bits, np.uint8)
    marks[(mix(tokens) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (or rows of them) at a smaller length."""
    return np.bitwise_or.reduce(bitmap.reshape(*bitmap.shape[:-1], -1, size), axis=-2)


def may_link(n: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of some sets may link with one. Each bit that only one of two sets has is a shingle that the other lacks."""
    mine = n - np.bitwise_count(bits & ~others).sum(-1, dtype=np.int64)
    theirs = sizes - np.bitwise_count(others & ~bits).sum(-1, dtype=np.int64)
    return (100 + percent) * np.minimum(mine, theirs) >= percent * (n + sizes)


def common_shingles(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Shingles that many different texts of some task have. They only come last in the order of shingles: any
    choice gives the same links, so the commonest are kept up to a fixed number."""

    def make():
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0

        def flush():
            nonlocal size
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                h, n = h[n >= COMMON_IN], n[n >= COMMON_IN]
                yield h.view(np.int64), n.astype(np.int64)
            held.clear()
            seen.clear()
            size = 0

        def each(texts):
            nonlocal size
            for tokens in _sets(texts, width):
                name = set_name(tokens)
                if name not in seen:
                    seen.add(name)
                    held.append(tokens)
                    size += len(tokens)
            if size > 6_000_000:
                yield from flush()

        each.rest = flush
        return each

    found = map_columns(docs.select(text), make, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "h").limit(COMMON_MOST).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def _prefixes(named: DataFrame, width: int, percent: int, common) -> DataFrame:
    """(id_a, id_b, n, name, prefix, bits): size and name of each row's set, the shingles of its prefix, and its bitmap."""

    def make():
        rare_last = common.value

        def each(a, b, texts):
            sizes, names, out, bits = [], [], [], []
            for tokens in _sets(texts, width):
                n = len(tokens)
                last = np.isin(tokens, rare_last, assume_unique=True) if len(rare_last) else np.zeros(n, bool)
                most = n - -(-percent * n // 100) + 1 if n else 0
                sizes.append(n)
                names.append(set_name(tokens))
                out.append(np.concatenate([tokens[~last], tokens[last]])[:most].tobytes())
                bits.append(sketch(tokens))
            yield a, b, sizes, names, out, bits

        return each

    return map_columns(named.select("id_a", "id_b", "id_text"), make, "id_a long, id_b long, n long, name binary, prefix binary, bits binary")


def _postings(sets: DataFrame, buckets: int) -> DataFrame:
    """Packed prefixes (bucket, (number, size, count) of sets, shingles)."""

    def make():
        def each(sizes, names, prefixes):
            out: dict[int, list] = {}
            for n, s, raw in zip(sizes, names, prefixes, strict=True):
                h = np.frombuffer(raw, np.uint64)
                own = bucket_of(mix(h), buckets)
                order = np.argsort(own, kind="stable")
                h = h[order]
                for k, x, y in cut_by(own[order]):
                    out.setdefault(k, []).append((s, n, h[x:y]))
            keys = list(out)
            yield (
                keys,
                [np.array([[r[0] for r in out[k]], [r[1] for r in out[k]], [len(r[2]) for r in out[k]]], "<i8").tobytes() for k in keys],
                [np.concatenate([r[2] for r in out[k]]).tobytes() for k in keys],
            )

        return each

    return map_columns(sets.select("n", "s", "prefix"), make, "bucket int, sets binary, shingles binary", most=16 << 20)


def _lists(percent: int):
    """Of one bucket: (list, set, its size, sets) for each different list of sets that share a prefix shingle and whose
    sizes allow a link. A list is named by its members."""

    def make():
        def work(rows):
            head = np.concatenate([np.frombuffer(r[1], "<i8").reshape(3, -1) for r in rows], axis=1)
            h = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
            whose = np.repeat(np.arange(head.shape[1]), head[2])
            sizes = head[1][whose]
            order = np.lexsort((sizes, h))
            h, sizes, names = h[order], sizes[order], head[0][whose][order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (100 * sizes[:-1] < percent * sizes[1:])
            first = np.flatnonzero(new)
            count = np.diff(first, append=len(h))
            name = mix(np.add.reduceat(mix(names.view(np.uint64)), first) + count.astype(np.uint64)) if len(h) else h
            use = np.flatnonzero(count > 1)
            _, once = np.unique(name[use], return_index=True)
            use = use[once]
            n = count[use]
            at = np.repeat(first[use] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.repeat(name[use].view(np.int64), n), names[at], sizes[at], np.repeat(n, n)

        return work

    return make


def _with_hubs(lists: DataFrame) -> DataFrame:
    """(list, s, size, hub): the hub is the member that meets most others, for its size, over all lists."""
    score = lists.groupBy("s").agg((F.sum("size") / F.first("n")).alias("score"))
    hubs = lists.join(score, "s").groupBy("list").agg(F.count("*").alias("size"), F.max(F.struct("score", "s")).alias("hub"))
    return lists.select("list", "s").join(hubs.select("list", "size", F.col("hub")["s"].alias("hub")), "list")


def _tokens(wanted: DataFrame, named: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(s, tokens) of the wanted sets, from the text of the row that gave the set its number."""

    def make():
        def each(names, texts):
            yield names, [x.tobytes() for x in _sets(texts, width)]

        return each

    where = rows.select(F.col("rid").alias("s"), "id_a", "id_b").join(wanted, "s")
    texts = named.select("id_a", "id_b", "id_text").join(where, ["id_a", "id_b"]).dropDuplicates(["id_a", "id_b"])
    return stored(map_columns(texts.select("s", "id_text"), make, "s long, tokens binary"), "tokens")


def _promising(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose bitmaps allow a link."""

    def make():
        def each(us, vs, n, a, m, b):
            keep = []
            for i in range(len(us)):
                x, y = np.frombuffer(a[i], np.uint8), np.frombuffer(b[i], np.uint8)
                size = min(len(x), len(y))
                keep.append(bool(may_link(n[i], fold(x, size), np.array([m[i]]), fold(y, size)[None], percent)[0]))
            yield [u for u, k in zip(us, keep, strict=True) if k], [v for v, k in zip(vs, keep, strict=True) if k]

        return each

    one = bits.select(F.col("s").alias("u"), F.col("n").alias("n1"), F.col("bits").alias("b1"))
    two = bits.select(F.col("s").alias("v"), F.col("n").alias("n2"), F.col("bits").alias("b2"))
    joined = pairs.join(one, "u").join(two, "v").select("u", "v", "n1", "b1", "n2", "b2")
    return map_columns(joined, make, "u long, v long")


def _tried(pairs: DataFrame, tokens: DataFrame, percent: int, block: int) -> DataFrame:
    """The pairs (u, hub v) of sets that link. The sets of one hub are split by salts, and the hub goes to each."""
    salts = pairs.groupBy("v").agg(F.ceil(F.count("*") / block).alias("salts"))
    dealt = pairs.join(salts, "v").select(F.col("u").alias("s"), "v", F.pmod(F.xxhash64("u"), F.col("salts")).alias("salt"))
    hubs = salts.select(F.col("v").alias("s"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    trials = dealt.unionByName(hubs).join(tokens, "s").select("v", "salt", (F.col("s") != F.col("v")).alias("other"), "s", "tokens")

    def make():
        hub = np.zeros(0, np.uint64)

        def each(vs, salt, other, s, raws):
            nonlocal hub
            found = []
            for v, o, u, raw in zip(vs, other, s, raws, strict=True):
                own = np.frombuffer(raw, np.uint64)
                if not o:
                    hub = own
                elif linked(own, hub, percent):
                    found.append((u, v))
            if found:
                yield list(zip(*found, strict=True))

        return each

    ordered = trials.repartition("v", "salt").sortWithinPartitions("v", "salt", "other")
    return stored(map_columns(ordered, make, "u long, v long"), "links")


def _places(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    n = stops - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


class TokenGroups:
    """A token-group matrix: for every shingle, the groups whose union holds it and the member sets that have it.
    Members of one component that share their smallest shingle are put into one group, as far as it has room."""

    def __init__(self, comps: np.ndarray, tokens: list[np.ndarray], percent: int, most: int = GROUP_SETS):
        least = np.array([t[0] for t in tokens], np.uint64)
        order = np.lexsort((least, comps))
        self.percent, self.comps = percent, comps[order]
        self.sizes = np.array([len(tokens[i]) for i in order.tolist()], np.int64)
        new = np.diff(self.comps, prepend=self.comps[0] - 1) != 0
        within = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        new |= within % most == 0
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.group, self.group_comps, self.least = group, self.comps[first], np.minimum.reduceat(self.sizes, first)
        every = np.concatenate([tokens[i] for i in order.tolist()])
        ranked = np.argsort(every, kind="stable")
        every, self.members = every[ranked], np.repeat(np.arange(len(order)), self.sizes)[ranked]
        self.values, self.start = np.unique(every, return_index=True)
        self.stop = np.append(self.start[1:], len(every))
        own = group[self.members]
        once = np.ones(len(every), bool)
        once[1:] = (every[1:] != every[:-1]) | (own[1:] != own[:-1])
        self.unions = own[once]
        before = np.concatenate([[0], np.cumsum(once)])
        self.union_start, self.union_stop = before[self.start], before[self.stop]

    def candidates(self, tokens: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Components of members that link with a set, among the groups that ``use`` marks."""
        at = np.searchsorted(self.values, tokens)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == tokens)]
        n, sums = len(tokens), 100 + self.percent
        bound = np.bincount(self.unions[_places(self.union_start[at], self.union_stop[at])], minlength=len(use))
        open_ = use & (100 * bound >= self.percent * n) & (sums * bound >= self.percent * (n + self.least))
        if not open_.any():
            return np.zeros(0, np.int64)
        members = self.members[_places(self.start[at], self.stop[at])]
        same = np.bincount(members, minlength=len(self.sizes))
        return np.unique(self.comps[open_[self.group] & (sums * same >= self.percent * (n + self.sizes))])


class BitmapGroups:
    """A token-group matrix of bitmaps: the union of every group of sets, alike in size and lowest bit, and its members."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int, most: int = GROUP_SETS):
        lowest = np.array([int(np.flatnonzero(b)[0]) << 8 | int(b[np.flatnonzero(b)[0]]) for b in bitmaps])
        scale = np.floor(np.log(sizes) / np.log(100 / percent)).astype(np.int64)
        self.order = np.lexsort((lowest, scale))
        self.sizes, self.percent, self.most = sizes[self.order], percent, most
        self.bitmaps = [bitmaps[i] for i in self.order.tolist()]
        self.lengths = np.array([len(b) for b in self.bitmaps])
        self.levels: dict[tuple[int, int], tuple] = {}

    def _level(self, own: int, size: int) -> tuple:
        """Members whose bitmaps have ``own`` bytes, folded to ``size``: (their places, rows, groups, and of each group its
        union and least and largest size)."""
        if (own, size) not in self.levels:
            at = np.flatnonzero(self.lengths == own)
            if not len(at):
                self.levels[own, size] = (at,)
                return (at,)
            rows = np.ascontiguousarray(fold(np.array([self.bitmaps[i] for i in at.tolist()]), size)).view(np.uint64)
            first = np.arange(0, len(at), self.most)
            n = self.sizes[at]
            self.levels[own, size] = at, rows, np.arange(len(at)) // self.most, np.bitwise_or.reduceat(rows, first), np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
        return self.levels[own, size]

    def candidates(self, n: int, bits: np.ndarray) -> np.ndarray:
        """Members that may link with a set; groups are opened only if their sizes and union allow it."""
        out = [np.zeros(0, np.int64)]
        for own in (len(bits) // 2, len(bits), len(bits) * 2):
            size = min(own, len(bits))
            if size < 8 or not len((level := self._level(own, size))[0]):
                continue
            at, rows, group, unions, least, most = level
            mine = np.ascontiguousarray(fold(bits, size)).view(np.uint64)
            held = n - np.bitwise_count(mine & ~unions).sum(-1, dtype=np.int64)
            open_ = (100 * held >= self.percent * n) & (100 * n >= self.percent * least) & (100 * most >= self.percent * n)
            use = np.flatnonzero(open_[group])
            if len(use):
                out.append(at[use[may_link(n, mine, self.sizes[at[use]], rows[use], self.percent)]])
        return self.order[np.concatenate(out)]


def _may_join(percent: int):
    """Of one cell: the sets (head, s, component) that by their bitmaps may link with a set of another component."""

    def make():
        def work(rows):
            head = rows[0][1]
            comps, sizes = np.array([r[3] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64)
            bitmaps = [np.frombuffer(r[7], np.uint8) for r in rows]
            member = np.flatnonzero([r[4] for r in rows])
            if not len(member):
                return
            matrix = BitmapGroups(sizes[member], [bitmaps[i] for i in member.tolist()], percent)
            marked = np.zeros(len(rows), bool)
            for i in np.flatnonzero([r[5] for r in rows]).tolist():
                found = member[matrix.candidates(int(sizes[i]), bitmaps[i])]
                found = found[(comps[found] != comps[i]) & ((comps[found] == head) | (comps[found] > comps[i]))]
                marked[found] = True
                marked[i] |= len(found) > 0
            use = np.flatnonzero(marked)
            if len(use):
                yield [head] * len(use), [rows[i][2] for i in use.tolist()], comps[use]

        return work

    return make


def _between_groups(percent: int):
    """Of one cell: pairs of components that some pair of their sets links, as many as join them."""

    def make():
        def work(rows):
            head = rows[0][1]
            tokens = [np.frombuffer(r[5], np.uint64) for r in rows]
            comps = np.array([r[2] for r in rows], np.int64)
            member = np.flatnonzero([r[3] for r in rows])
            if not len(member):
                return
            matrix = TokenGroups(comps[member], [tokens[i] for i in member.tolist()], percent)
            label: dict[int, int] = {}
            u, v = [], []

            def root(c):
                while label.setdefault(c, c) != c:
                    c = label[c]
                return c

            for i in np.flatnonzero([r[4] for r in rows]).tolist():
                own = int(comps[i])
                use = (matrix.group_comps == head) | (matrix.group_comps > own)
                for other in matrix.candidates(tokens[i], use).tolist():
                    if root(own) != root(other):
                        label[root(own)] = root(other)
                        u.append(own)
                        v.append(other)
            if u:
                yield u, v

        return work

    return make


def _remaining(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """(head, s, component): the sets of lists with several components, by the component of the list's hub. Lists of two
    are settled by their trial."""
    named = lists.join(comps.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("component", F.coalesce("component", "s"))
    several = named.filter("size > 2").groupBy("list").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.max(F.when(F.col("s") == F.col("hub"), F.col("component"))).alias("head")
    )
    return named.join(several.filter("x != y").select("list", "head"), "list").select("head", "s", "component").distinct()


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """(cell, head, s, component, member, query): every head's sets in blocks of about ``block`` shingles. All sets are
    members; those outside the head's component are looked up, in a cell with each block of members."""
    outside = F.col("component") != F.col("head")
    totals = rows.groupBy("head").agg(
        F.greatest(F.ceil(F.sum("n") / block), F.lit(1)).alias("of_members"), F.greatest(F.ceil(F.sum(F.when(outside, F.col("n")).otherwise(0)) / block), F.lit(1)).alias("of_queries")
    )
    placed = rows.join(totals, "head").withColumns(
        {"own_member": F.pmod(F.xxhash64("s", F.lit(1)), "of_members"), "own_query": F.pmod(F.xxhash64("s", F.lit(2)), "of_queries")}
    )
    zero = F.lit(0).cast("long")
    as_member = F.transform(F.sequence(zero, F.col("of_queries") - 1), lambda q: F.struct(q.alias("q"), F.col("own_member").alias("m")))
    as_query = F.transform(F.sequence(zero, F.col("of_members") - 1), lambda m: F.struct(F.col("own_query").alias("q"), m.alias("m")))
    cells = F.array_distinct(F.when(outside, F.concat(as_member, as_query)).otherwise(as_member))
    return placed.withColumn("at", F.explode(cells)).select(
        F.xxhash64("head", "at.q", "at.m").alias("cell"), "head", "s", "component", (F.col("at.m") == F.col("own_member")).alias("member"),
        (outside & (F.col("at.q") == F.col("own_query"))).alias("query"),
    )


NULL_KEY = -(2**63)


def _members(named: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """(id_a, id_b, n, component): the size of each document's set, and its class's number."""
    spark = named.sparkSession
    buckets = bucket_count(named, "id_text")
    common = spark.sparkContext.broadcast(common_shingles(named, "id_text", words))
    rows = stored(_prefixes(named, words, percent, common).withColumn("rid", F.monotonically_increasing_id()), "prefixes")
    sets = rows.filter("n > 0").groupBy("name").agg(F.min(F.struct("rid", "n", "prefix", "bits")).alias("one")).select(F.col("one.rid").alias("s"), "one.n", "one.prefix", "one.bits")
    lists = by_bucket(_postings(sets, buckets), "bucket", _lists(percent), "list long, s long, n long, size long", buckets)
    found = stored(lists.dropDuplicates(["list", "s"]), "lists")
    lists = stored(_with_hubs(found), "hubs")
    released(found)

    listed = rows.select(F.col("rid").alias("s"), "n", "bits").join(lists.select("s").distinct(), "s", "left_semi")
    bits = stored(listed, "bits")
    pairs = stored(_promising(lists.filter("s != hub").select(F.col("s").alias("u"), F.col("hub").alias("v")).distinct(), bits, percent), "pairs")
    tokens = _tokens(pairs.select(F.col("u").alias("s")).unionByName(pairs.select(F.col("v").alias("s"))).distinct(), named, rows, words)
    links = _tried(pairs, tokens, percent, HUB_SETS)
    released(tokens, pairs)
    comps = components(links)

    open_ = stored(_remaining(lists, comps).join(bits.select("s", "n"), "s"), "open")
    cells = _cells(open_, BLOCK_BITS * block).join(bits.select("s", "n", "bits"), "s").select("cell", "head", "s", "component", "member", "query", "n", "bits")
    left = by_bucket(cells, "cell", _may_join(percent), "head long, s long, component long").distinct()
    left = stored(left.join(bits.select("s", "n"), "s"), "left")
    released(open_)
    open_ = left
    tokens = _tokens(open_.select("s").distinct(), named, rows, words)
    cells = _cells(open_, block).join(tokens, "s").select("cell", "head", "component", "member", "query", "tokens")
    more = components(stored(by_bucket(cells, "cell", _between_groups(percent), "u long, v long"), "more"))
    released(tokens, open_, lists, bits)

    both = comps.join(more.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    alone = more.join(comps, "node", "left_anti").select("node", "component")
    ids = rows.filter("n > 0").groupBy("name").agg(F.min("rid").alias("node"))
    of_name = ids.join(both.unionByName(alone), "node", "left").select("name", F.coalesce("component", "node").alias("component"))
    return rows.select("id_a", "id_b", "n", "name").join(of_name, "name", "left").select("id_a", "id_b", "n", "component")


def _classes(named: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """(id_a, id_b, n, least): the size of each document's set and the smallest key of its class."""
    by_set = _members(named, words, percent, block)
    least = by_set.filter("n > 0").groupBy("component").agg(F.min("id_a").alias("least"))
    classes = by_set.join(least, "component", "left").select("id_a", "id_b", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id_a")).alias("least"))
    return classes.dropDuplicates(["id_a", "id_b"])


def link_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK_SHINGLES
) -> DataFrame:
    """``docs`` with columns ng_size (distinct shingles) and ng_class (smallest key of the rows reachable by links).

    Words are runs of anything but 0x20 and 0x09-0x0D, A-Z folded; a text of fewer than ``words`` words has one shingle,
    the whole; null, empty and blank texts have none and are a class of their own. Rows with equal sets are linked,
    repeated rows included; a null key counts as the smallest. Words are hashed modulo a 61-bit prime and sets named by 128
    bits.

    Copies collapse by a partial aggregation; the sets of a hub are split by salts; the sets of a head are cut into
    blocks of members and of sets looked up, so that a cell's memory is bounded. No bucket, list or partner is capped. A column of a name that is
    added is replaced.
    """
    named = identified(docs, key, text, "ng_size", "ng_class")
    least = F.when(F.col("least") != NULL_KEY, F.col("least"))
    return named.join(_classes(named, words, percent, block), ["id_a", "id_b"]).select("id_row.*", F.col("n").alias("ng_size"), least.alias("ng_class"))


def class_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Key, set size and class of every row, without the texts."""
    kind = docs.schema[key].dataType
    by_set = _members(identified(docs.select(key, text), key, text), words, percent, block)
    least = by_set.filter("n > 0").groupBy("component").agg(F.min("id_a").alias("least"))
    found = by_set.join(least, "component", "left").withColumn("least", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id_a")))
    known = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c)).cast(kind)
    return found.select(known("id_a").alias(key), F.col("n").alias("n_shingles"), known("least").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest key, a null key counting as the smallest, and of
    several texts with that key the one with the smallest hash (of repeated rows, one). Rows without words all stay."""
    named = identified(docs, key, text)
    members = _members(named, WORDS, PERCENT, BLOCK_SHINGLES)
    first = members.filter("n > 0").groupBy("component").agg(F.min(F.struct("id_a", "id_b")).alias("first")).select("first.*", F.lit(True).alias("worded"))
    bare = members.filter("n = 0").select("id_a", "id_b", F.lit(False).alias("worded")).distinct()
    kept = stored(first.unionByName(bare), "kept")
    done = named.join(kept, ["id_a", "id_b"])
    return done.filter("worded").dropDuplicates(["id_a", "id_b"]).unionByName(done.filter("not worded")).select("id_row.*")
