"""Registered queries of the operators and the pipeline on the smallest tables."""

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from capturelake.llm import decontaminate, languages, packing, queries
from capturelake.llm.text import read
from tests.conftest import SF
from tests.llm.test_dedup import brute_classes


def brute_lines(rows):
    """Rows by key with the lines that stay, or None for a text of which nothing stays."""
    seen, later = set(), {}
    for row in sorted(rows):
        own = (row[1] or "").split("\n")
        for i in range(len(own) - 2):
            w = tuple(own[i : i + 3])
            if w in seen:
                later.setdefault(row[0], set()).update(range(i, i + 3))
            seen.add(w)
    out = {}
    for row in rows:
        gone = later.get(row[0], set())
        kept = "\n".join(x for i, x in enumerate((row[1] or "").split("\n")) if i not in gone) if gone else row[1]
        if not gone or kept.strip(" "):
            out[row[0]] = kept
    return out


def brute_leaking(text, items):
    """Whether a text overlaps an item: the rule on every diagonal of the matrix of equal words."""
    cut = lambda t: "".join(c if c.isalnum() and c.isascii() or c > "\x7f" else " " for c in t).translate({i: i + 32 for i in range(65, 91)}).split()
    a = np.array(cut(text or ""), object)
    for item in items:
        b = np.array(cut(item or ""), object)
        if not len(a) or not len(b):
            continue
        if len(b) < 5:
            if a.tolist() == b.tolist():
                return True
            continue
        equal = a[:, None] == b[None, :]
        need = min(13, len(b))
        for k in range(-len(a) + 1, len(b)):
            same = np.diagonal(equal, k)
            if same.sum() >= 0.8 * need:
                sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
                if any(sums[j] >= sums[i] for i in range(len(same)) for j in range(i + need, len(same) + 1)):
                    return True
    return False


def test_line_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op3_line_windows"]).fetchall()
    got = queries.QUERIES["op3_line_windows"](spark, SF).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages(spark, tmp_path):
    """Each stage keeps the columns, and what it keeps is what brute force on its own input keeps."""
    docs = read(spark, SF, "documents")
    names = docs.columns
    rows = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows[name] = before, [tuple(r) for r in docs.collect()]
        if i < 4:
            assert docs.columns == names
    before, after = rows["n-gram Jaccard join"]
    best = brute_classes(before)
    keep = {k for k, (n, c) in best.items() if n == 0 or k == c}
    assert {r[0] for r in after} == keep
    before, after = rows["language ID"]
    held = {r.doc_id: r.h for r in read(spark, SF, "documents").select("doc_id", languages.held_out("doc_id").alias("h")).collect()}
    labels = sorted({r[2] for r in before if r[2] is not None and r[1] is not None and not held[r[0]]})
    counts = np.stack([languages.trigrams([r[1] for r in before if r[2] == x and r[1] is not None and not held[r[0]]]).sum(0) for x in labels]) + languages.SMOOTHING
    q = (counts / counts.sum(1, keepdims=True)).astype(np.float32)
    weights = languages.infer(languages.trigrams([r[1] for r in before]), q)
    keep = {r[0] for r, w in zip(before, weights, strict=True) if r[1] and any(c.isalpha() for c in r[1]) and w.max() >= languages.REJECT_UNDER}
    assert {r[0] for r in after} == keep and len(keep) > 0.95 * len(before)
    before, after = rows["line dedup"]
    assert {r[0]: r[1] for r in after} == brute_lines(before)
    assert all(r[4] == (len(r[1]) if r[1] != dict((b[0], b[1]) for b in before)[r[0]] else r[4]) for r in after)
    before, after = rows["benchmark decontamination"]
    items = [r.text for r in read(spark, SF, "benchmark").collect()]
    leaked = {r[0] for r in before if brute_leaking(r[1], items)}
    assert leaked and {r[0] for r in after} == {r[0] for r in before} - leaked
    before, after = rows["best-fit packing"]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r[0]: len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in before}
    assert sorted((r[0], r[1], r[2], r[3]) for r in after) == sorted((k, i // 2048, i, min(2048, n - i)) for k, n in sizes.items() for i in range(0, n, 2048))
    by: dict = {}
    for r in after:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    bound = packing.lower_bound(np.bincount([r[3] for r in after], minlength=2049))
    assert bound <= len(by) <= bound + 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect())) == sorted((r[0], r[1], r[3]) for r in after)
