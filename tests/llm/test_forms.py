"""Periodic runs, chat formatting and vector codes."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from capturelake.llm import chat, codes, periods, queries
from capturelake.llm.text import read
from tests.conftest import SF


def brute_runs(w, least=24, times=3):
    """(start, length, period) of every run, lag by lag."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            own = w[first - q : i]
            if len(own) >= max(least, times * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((first - q, len(own), q))
            i += i == first
    return sorted(out, key=lambda r: (r[0], r[2]))


def nested(rng, depth):
    if not depth:
        return [rng.choice("abc") for _ in range(rng.randint(1, 3))]
    return [w for _ in range(rng.randint(1, 3)) for w in nested(rng, depth - 1) * rng.randint(1, 5)]


def test_runs_match_plain_search():
    rng, found = random.Random(1), 0
    for k in range(3000):
        if k % 3 == 0:
            w = [rng.choice("ab") for _ in range(rng.randint(0, 90))]
        elif k % 3 == 1:
            w = nested(rng, rng.randint(1, 3))[:200]
        else:
            around = [[rng.choice("abcdefg") for _ in range(rng.randint(0, 30))] for _ in range(3)]
            w = around[0] + (around[1] * 10)[: rng.randint(0, 150)] + around[2]
        least = rng.choice([6, 24])
        want = brute_runs(w, least)
        found += len(want)
        assert periods.find(periods.numbered(w), least) == want
    assert found > 1000


@pytest.mark.parametrize("words", [["a"] * 200000, [*"abcde"] * 30000, (["a"] * 50 + ["b"]) * 3000, [bin(i).count("1") % 2 for i in range(100000)]])
def test_long_periodic_texts_are_quick(words):
    runs = periods.find(periods.numbered(words))
    assert len(runs) == {2: 0, 5: 1}.get(len(set(words)), 1) or len(runs) == 3001


def test_run_digests_match_plain_search(spark, docs, rows, empty):
    want = []
    for key, text, *_ in rows:
        w = (text or "").encode().split()
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        milli = best[1] * 1000 // best[2] if runs else None
        want.append((key, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert sum(bool(x[1]) for x in want) > 2
    got = periods.run_digests(periods.find_runs(periods.planted(docs))).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    done = periods.find_runs(docs)
    assert done.columns == [*(c for c in docs.columns if c.lower() not in ("pr_runs", "pr_kept")), "pr_runs", "pr_kept"]
    assert done.count() == len(rows) and periods.find_runs(empty).count() == 0
    odd = spark.createDataFrame([(None, "a " * 30), (None, None), (1, "a " * 30), (1, "a " * 30)], "doc_id long, text string")
    assert sorted(r.n_runs for r in periods.run_digests(periods.find_runs(periods.planted(odd))).collect()) == [0, 1, 1, 1]


def test_run_query_covers_the_table(spark):
    rows = read(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op11_diagonal_runs"](spark, SF).collect()}
    assert set(got) == {r.doc_id for r in rows}
    due = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and len((r.text or "").split()) >= 200]
    assert due and sum(got[r.doc_id].n_runs > 0 for r in due) > len(due) / 2


CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<NULL>>", "<<END>>", "<<NEXT>>", "\\", "\\\\", "\n", " ", "<", "[", "a", "é\U0001f600", "$1", ""]


def brute_chat(turns):
    """n_turns, hash of turns, characters and hash of assistants' texts."""
    own = sorted(turns, key=lambda t: [(x is not None, x) for x in t])
    said = "".join(t[2] or "" for t in own if t[1] == "assistant")
    text = "".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in own)
    return len(own), hashlib.sha256(text.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_chats_are_read_back(spark):
    rng, by = random.Random(3), {}
    for key in [None, *range(150)]:
        by[key] = [
            (rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", None, "to[INST]ol\n", ""]), rng.choice([None, "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 9)))]))
            for _ in range(rng.randint(1, 9))
        ]
    by[7] = [(i, "user" if i % 3 else "assistant", f"t{i}") for i in range(400)]
    rows = [(k, *t, "x") for k, turns in by.items() for t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `cf_text` string").repartition(5)
    made = chat.format_chats(df)
    assert made.columns == ["conv_id", "cf_text", "cf_loss"]
    back = chat.read_chats(made)
    got = {r.conv_id: r for r in chat.chat_digests(back).collect()}
    assert set(got) == set(by)
    for key, turns in by.items():
        assert tuple(got[key])[1:5] == brute_chat(turns)
    texts = {r.conv_id: r for r in back.collect()}
    assert got[7].formatted_chars == len(texts[7].cf_text)
    assert texts[7].cf_text.count("[INST]") == 133 and texts[7].cf_text.count("<<NEXT>>") == 133
    assert len(texts[7].cf_loss) == len(texts[7].cf_targets) == 134
    for r in texts.values():
        assert len({t.cf_text for t in texts.values()}) > 140 and [r.cf_text[a:b] for a, b in r.cf_loss] == [chat_escaped(t) for t in r.cf_targets]
    assert chat.chat_digests(chat.read_chats(chat.format_chats(df.filter("false")))).count() == 0


def chat_escaped(text):
    import re

    return re.sub(rf"(\\*)({chat.CONTROL})", r"\\\1\2", text)


def test_chat_plan_is_native(spark):
    plan = queries.QUERIES["op12_chat_format"](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "ExistingRDD"))
    probe = next(r for r in queries.QUERIES["op12_chat_format"](spark, SF).collect() if r.conv_id == -1)
    said = "</s>[INST] ok [/INST]"
    assert (probe.n_turns, probe.loss_chars, probe.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())


def brute_codes(rows, entries=64, rounds=2):
    """{index: (code, error)} and the final codebooks, by plain k-means."""
    use = [(r[0], np.floor(np.array(r[1], np.float64) * 256).astype(np.int64)) for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    order = sorted(range(len(use)), key=lambda i: (use[i][0] is None, use[i][0], use[i][1].tolist()))
    v = np.stack([x for _, x in use]).reshape(len(use), 16, -1)
    book = v[order[:entries]].transpose(1, 0, 2).copy()

    def nearest():
        d = ((v[:, :, None, :] - book[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        own = nearest()[0]
        for p in range(16):
            for e in range(book.shape[1]):
                part = v[own[:, p] == e, p]
                if len(part):
                    book[p, e] = [int(s) // len(part) for s in part.sum(0)]
    own, d = nearest()
    return [(k, bytes(c.astype(np.uint8)).hex(), int(e)) for (k, _), c, e in zip(use, own, d.sum(1), strict=True)], book


def vectors(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (9, width))
    made = (centres[rng.integers(0, 9, n)] + rng.normal(0, 0.1, (n, width))).astype(np.float32)
    made[n // 2 :: 3] = made[0]
    rows = [(int(i), [float(x) for x in v], int(i) % 4 if i % 5 else None) for i, v in enumerate(made)]
    bad = [None, [None] + rows[0][1][1:], [float("nan")] + rows[0][1][1:], [float("inf")] * width]
    return rows + [(n + i, b, 1) for i, b in enumerate(bad)] + [rows[min(3, n - 1)], (None, rows[min(4, n - 1)][1], 2)]


@pytest.mark.parametrize("n,width,rounds", [(300, 32, 2), (300, 64, 4), (40, 16, 2), (1, 16, 1)])
def test_codes_match_plain_clustering(spark, n, width, rounds):
    rows = vectors(n, n, width, 2.0)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, parts string, `code` string").repartition(3)
    done, book = codes.compress(df, rounds=rounds)
    want, want_book = brute_codes(rows, rounds=rounds)
    assert (book == want_book).all()
    got = done.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error) for r in got) == sorted((k is None, k or 0, c, e) for k, c, e in want)
    label = {r[0]: r[2] for r in rows}
    total: dict = {}
    for k, _, e in want:
        total[label[k]] = total.get(label[k], 0) + e
    assert all(r.label_error == total[label[r.vec_id]] for r in got)


def test_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert codes.code_digests(spark.createDataFrame([], kind)).count() == 0
    assert codes.code_digests(spark.createDataFrame([(1, None, 1), (2, [float("nan")] * 16, 1)], kind)).count() == 0
    for bad in ([(1, [0.5] * 17, 1)], [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)]):
        with pytest.raises(ValueError, match="components"):
            codes.code_digests(spark.createDataFrame(bad, kind))


def test_bounds_spare_scans():
    """Later rounds scan a part of the groups only; net displacement is never more than the drifts' sum."""
    rng = np.random.default_rng(5)
    own = (rng.normal(0, 30, (4000, 4)) + rng.integers(0, 6, (4000, 1)) * 80).astype(np.int64)
    books, scanned = [own[None, :64].copy()], []
    code, bound, stamp = np.zeros(4000, np.uint8), np.zeros((4000, 8), np.float16), np.zeros((4000, 8), np.uint8)
    for now in range(4):
        away = codes.moved(books, now)
        scanned.append(codes.assign(own, books[now][0], code, bound, stamp, away[:, 0], now)[1])
        assert (code == codes.distances(own, books[now][0]).argmin(1)).all()
        new = books[-1].copy()
        for e in range(64):
            if (code == e).any():
                new[0, e] = own[code == e].sum(0) // (code == e).sum()
        books.append(new)
        if now:
            steps = sum(codes.moved(books[: s + 1], s)[s - 1] for s in range(1, now + 1))
            assert (away[0] <= steps * (1 + 1e-6)).all()
    assert scanned[0] == 4000 * 8 and max(scanned[1:]) < scanned[0] / 2


@pytest.mark.parametrize("name", ["op12_chat_format", "op13_norm_of_sum_codes"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("conversations", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLES[name]).fetchdf()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
