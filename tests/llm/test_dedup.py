"""Deduplication operators against brute force on hostile rows."""

import hashlib
import random
import re

import pytest

from capturelake.llm import components, lines, similar, substrings, suffixes


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def raw(t):
    return (t or "").encode()


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(2000):
        t = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 14))] + [0]
        assert suffixes.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_grown_anchors_meet():
    """Equal windows get equal longer anchors, down to the whole window."""
    rng = random.Random(4)
    for _ in range(300):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        texts = [base[rng.randrange(20) :] + bytes(rng.choice(b"ab") for _ in range(20)) for _ in range(4)]
        parts = []
        for t in texts:
            for first, n, anchor, *_ in zip(*suffixes.runs(t, 20, 4), strict=True):
                parts.append((t[first : first + n + 19], int(n), -1, int(anchor)))
        gram = 4
        while gram < 20:
            longer = gram + (20 - gram + 1) // 2
            parts = [(raw[low : low + size + 19], size, place, key) for raw, n, at, _ in parts for low, size, key, place in suffixes.grown(raw, n, at, 20, gram, longer)]
            where: dict[bytes, set] = {}
            for raw, n, _, key in parts:
                for i in range(n):
                    where.setdefault(raw[i : i + 20], set()).add(key)
            assert all(len(keys) == 1 for keys in where.values())
            assert sum(n for _, n, *_ in parts) == sum(len(t) - 19 for t in texts)
            gram = longer


def test_repeated_windows():
    rng = random.Random(2)
    for _ in range(600):
        letters, width = rng.choice(["ab", "ab ", "abc  ", "a"]), rng.randint(2, 8)
        base = "".join(rng.choice(letters) for _ in range(30)).encode()
        strings = [base[a : a + rng.randint(1, 12)] for a in (rng.randint(0, 20) for _ in range(rng.randint(1, 4)))]
        count: dict[bytes, int] = {}
        for s in strings:
            for i in range(len(s) - width + 1):
                count[s[i : i + width]] = count.get(s[i : i + width], 0) + 1
        want = [[count[s[i : i + width]] > 1 for i in range(max(0, len(s) - width + 1))] for s in strings]
        assert [m.tolist() for m in suffixes.repeated_windows(strings, width)] == want


@pytest.mark.parametrize(("width", "gram", "many"), [(400, 128, 4096), (60, 16, 2), (24, 4, 3)])
def test_suffix_dedup(docs, rows, width, gram, many):
    """``many`` of 2 or 3 grows nearly all anchors."""
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(suffixes.repeats(docs, width=width, gram=gram, many=many)).collect()}
    count: dict[bytes, int] = {}
    for _, t, *_ in rows:
        for i in range(len(raw(t)) - width + 1):
            count[raw(t)[i : i + width]] = count.get(raw(t)[i : i + width], 0) + 1
    for key, t, *_ in rows:
        gone = bytearray(len(raw(t)))
        for i in range(len(raw(t)) - width + 1):
            if count[raw(t)[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(raw(t), gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert got[key] == (len(raw(t)), sum(gone), spans, sha(kept))


def test_substring_dedup(docs, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(substrings.repeats(docs)).collect()}
    first: dict[tuple, int] = {}
    for key, t, *_ in rows:
        w = raw(t).split()
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(key, first.get(tuple(w[i : i + 13]), key))
    for key, t, *_ in rows:
        w = raw(t).split()
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < key:
                gone[i : i + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert got[key] == (len(w), sum(gone), sha(b" ".join(kept)))


def brute_classes(rows):
    sets = {}
    for key, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[key] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_classes(docs, rows, block):
    """A block of 200 shingles splits every head into many cells."""
    done = similar.link_classes(docs, block=block)
    assert done.columns == [*(c for c in docs.columns if c.lower() not in ("ng_size", "ng_class")), "ng_size", "ng_class"]
    assert {r.doc_id: (r.ng_size, r.ng_class) for r in done.collect()} == brute_classes(rows)


def test_bitmaps_never_lose_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(len(a) * rng.uniform(0.6, 1))], rng.integers(0, 2**62, int(rng.integers(0, 40))).astype(np.uint64)]))
        if similar.linked(a, b, 75):
            x, y = (np.frombuffer(similar.sketch(t), np.uint8) for t in (a, b))
            size = min(len(x), len(y))
            assert similar.may_link(len(a), similar.fold(x, size), np.array([len(b)]), similar.fold(y, size)[None], 75)[0]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent: dict[int, int] = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {k: root(k) for k in list(parent)}


def test_lines(docs, rows):
    done = lines.dedup_lines(docs)
    got = {r.doc_id: (r.ld_n, r.ld_removed, r.ld_kept) for r in done.collect()}
    seen, later = set(), {}
    for key, t, *_ in rows:
        own = (t or "").split("\n")
        for i in range(len(own) - 2):
            w = tuple(own[i : i + 3])
            if w in seen:
                later.setdefault(key, set()).update(range(i, i + 3))
            seen.add(w)
    for key, t, *_ in rows:
        own, gone = (t or "").split("\n"), later.get(key, set())
        kept = "\n".join(x for i, x in enumerate(own) if i not in gone) if gone else t
        assert got[key] == (len(own), len(gone), kept)


def test_repeated_rows_and_null_keys(spark, docs, tmp_path):
    """A row given twice and a row without a key get the same defined results as any other."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 8
    rows = [(1, text), (1, text), (None, text), (2, "alone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert sorted(r.n_removed for r in suffixes.digests(suffixes.repeats(df)).collect()) == [0, *[len(text)] * 3]
    words = {(r.doc_id, r.n_removed) for r in substrings.digests(substrings.repeats(df)).collect()}
    assert words == {(None, 0), (1, 112), (2, 0)}
    assert similar.class_digests(df).count() == 4
    assert lines.dedup_lines(df).count() == 4


def test_shared_keys_lose_no_class(spark, tmp_path):
    """Unlinked texts with null keys or one key are classes of their own, and each class keeps one row."""
    rng = random.Random(8)
    text = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)) for _ in range(8)]
    near = text[4] + " tail"
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (5, text[3]), (5, text[6]), (None, text[4]), (3, near), (4, text[4]), (7, text[5]), (7, text[5]), (None, ""), (None, ""), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = [tuple(r) for r in similar.one_of_each(spark.read.parquet(str(tmp_path / "d"))).collect()]
    gone = [(3, near), (4, text[4]), (7, text[5])]
    want = list(rows)
    for row in gone:
        want.remove(row)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lines_of_shared_keys(spark):
    """A window in several texts of one key, or of none, at one place goes in all but one of them."""
    window = "first\nsecond\nthird"
    rows = [(None, f"{window}\n{c}") for c in "abc"] + [(1, f"{window}\nd"), (2, "x\ny\nz\n1"), (2, "x\ny\nz\n2")]
    got = [(r.doc_id, r.ld_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(None, 0), (None, 3), (None, 3), (1, 3), (2, 0), (2, 3)], key=repr)


def test_structured_words_are_told_apart(spark, tmp_path):
    """Words and passages that hashes modulo a power of two confuse."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join(letters[b] for b in bits) for letters in ("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {one}"), (2, f"{head} {two}"), (3, one), (4, two), (5, f"{one}\n{one}\n{one}"), (6, f"{two}\n{two}\n{two}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert {r.doc_id: r.n_removed for r in substrings.digests(substrings.repeats(df)).collect()} == dict.fromkeys(range(1, 7), 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar.class_digests(df).collect()}
    assert got == brute_classes([(k, t) for k, t in rows])
    assert {r.doc_id: r.ld_removed for r in lines.dedup_lines(df).collect()} == dict.fromkeys(range(1, 7), 0)
    by = {r.doc_id: r.n_removed for r in suffixes.digests(suffixes.repeats(df)).collect()}
    count: dict[str, int] = {}
    for _, t in rows:
        for i in range(len(t) - 399):
            count[t[i : i + 400]] = count.get(t[i : i + 400], 0) + 1
    for k, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        assert by[k] == sum(gone)


def test_large_groups_of_near_copies(spark):
    """Hundreds of variants of one text, many of which do not link with it or with one another, in small cells."""
    rng = random.Random(30)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > rng.choice([0.0, 0.01, 0.03, 0.05]) else f"e{rng.randrange(400)}" for w in base)) for i in range(260)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert len({c for _, c in want.values()}) > 20
    for block in (1 << 20, 1500):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in similar.class_digests(df, block=block).collect()} == want


def test_empty(empty):
    assert suffixes.digests(suffixes.repeats(empty)).count() == 0
    assert substrings.digests(substrings.repeats(empty)).count() == 0
    assert similar.class_digests(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0
