"""Substring dedup over words: fixed-block anchors, rolling probes, exact extension.

Non-overlapping blocks of 7 words of every text are the index; every rolling window of 7 words is a probe. A repeat
of 13 words always holds a whole block of its other place, so places without a hit are never looked at again. Around
hits, runs are extended: consecutive windows of 13 words are matched exactly, and a maximal repeat is the run of those
that also start in an earlier text. Windows are matched by 96 bits of two hashes of words hashed modulo a 61-bit prime.

Probes are not rows but packed arrays, one for each task and bucket of hashes: 4 bytes of hash and about 1 of place.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from capturelake.llm.text import (
    blocks,
    bucket_count,
    bucket_of,
    by_bucket,
    cover,
    cut_by,
    identified,
    joined_words,
    map_columns,
    map_rows,
    mix,
    pack_places,
    released,
    stored,
    text_bytes,
    unpack_places,
    window_hashes,
    word_hashes,
)

WINDOW = 13
BATCH_WORDS = 1_000_000


def _probes(named: DataFrame, block: int, buckets: int) -> DataFrame:
    """Packed probes (bucket, batch, head, low hash bits with a mark for index blocks, places), and as rows with ``head``
    each batch's texts and their numbers of words."""

    def make():
        held: list[tuple] = []
        texts_a, texts_b, counts = [], [], []
        total, flushed = 0, 0

        def flush():
            nonlocal total, flushed
            if not counts:
                return
            batch = TaskContext.get().partitionId() << 24 | flushed
            flushed += 1
            n = np.concatenate(counts).astype("<i8")
            yield [batch % buckets], [batch], [True], [np.array([texts_a, texts_b], "<i8").tobytes()], [n.tobytes()]
            bucket, low, place = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.argsort(bucket, kind="stable")
            low, place = low[order], place[order]
            parts = cut_by(bucket[order])
            for i in range(0, len(parts), 64):
                own = parts[i : i + 64]
                yield (
                    [b for b, _, _ in own], [batch] * len(own), [False] * len(own), [low[x:y].tobytes() for _, x, y in own],
                    [pack_places(place[x:y]) for _, x, y in own],
                )
            total = 0
            for x in (held, texts_a, texts_b, counts):
                x.clear()

        def each(a, b, texts):
            nonlocal total
            raws = [text_bytes(t) for t in texts]
            for part in blocks(raws):
                words, doc, first = joined_words([raws[i] for i in part], False)
                h = window_hashes(words, block)
                at = np.flatnonzero(doc[: len(h)] == doc[block - 1 :][: len(h)])
                h = h[at]
                index = (at - first[doc[at]]) % block == 0
                low = (h & np.uint64(0xFFFFFFFE)).astype("<u4") | index.astype("<u4")
                held.append((bucket_of(h, buckets).astype(np.int32), low, (at + total).astype(np.int32)))
                texts_a.extend(a[i] for i in part)
                texts_b.extend(b[i] for i in part)
                counts.append(np.diff(first))
                total += len(words)
                if total > BATCH_WORDS:
                    yield from flush()

        each.rest = flush
        return each

    return map_columns(named.select("id_a", "id_b", "id_text"), make, "bucket int, batch long, head boolean, low binary, places binary")


def _hits():
    """Of one bucket: places whose hash an index block has and that more than one place has. Heads pass."""

    def work(rows):
        for _, batch, head, ids, counts in rows:
            if head:
                yield [batch], [ids], [counts]
        rows = [r for r in rows if not r[2]]
        if not rows:
            return
        low = np.concatenate([np.frombuffer(r[3], "<u4") for r in rows])
        key, marked = low >> 1, low & 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        first = np.flatnonzero(np.diff(ranked, prepend=ranked[0] + np.uint32(1)) != 0)
        count = np.diff(first, append=len(ranked))
        good = (count > 1) & (np.add.reduceat(marked[order], first) > 0)
        hit = np.zeros(len(low), bool)
        hit[order] = np.repeat(good, count)
        at = 0
        for _, batch, _, own, places in rows:
            mask = hit[at : at + len(own) // 4]
            at += len(own) // 4
            if mask.any():
                yield [batch], [b""], [pack_places(unpack_places(places)[mask])]

    return work


def _by_text():
    """Of one batch: its texts that have hits, with their places in the text."""

    def work(rows):
        head = next(r for r in rows if r[1])
        ids, counts = np.frombuffer(head[1], "<i8").reshape(2, -1), np.frombuffer(head[2], "<i8")
        found = [unpack_places(r[2]) for r in rows if not r[1]]
        if not found:
            return
        places = np.sort(np.concatenate(found))
        ends = np.cumsum(counts)
        own = cut_by(np.searchsorted(ends, places, "right"))
        for i in range(0, len(own), 1000):
            part = own[i : i + 1000]
            yield (
                [int(ids[0, d]) for d, _, _ in part], [int(ids[1, d]) for d, _, _ in part],
                [pack_places(places[x:y] - (ends[d] - counts[d])) for d, x, y in part],
            )

    return work


def _candidates(joined: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """Packed windows around hits: (bucket, texts, hashes, further hash bits, places)."""

    def make():
        def each(a, b, texts, hits):
            out: dict[int, list] = {}
            for one, two, t, packed in zip(a, b, texts, hits, strict=True):
                words, _, _ = word_hashes(np.frombuffer(text_bytes(t), np.uint8))
                h = window_hashes(words, window)
                if not len(h):
                    continue
                near = np.zeros(len(words) + 1, np.int64)
                near[1:][unpack_places(packed)] = 1
                near = np.cumsum(near)
                step = window - block + 1
                at = np.flatnonzero(near[step : step + len(h)] > near[: len(h)])
                own = bucket_of(h[at], buckets)
                order = np.argsort(own, kind="stable")
                at, own = at[order], own[order]
                more = (window_hashes(words, window, second=True) >> np.uint64(32)).astype("<u4")
                for k, x, y in cut_by(own):
                    out.setdefault(k, []).append((one, two, h[at[x:y]], more[at[x:y]], at[x:y]))
            keys = list(out)
            for i in range(0, len(keys), 64):
                part = keys[i : i + 64]
                yield (
                    part,
                    [np.array([[r[0] for r in out[k]], [r[1] for r in out[k]], [len(r[2]) for r in out[k]]], "<i8").tobytes() for k in part],
                    [np.concatenate([r[2] for r in out[k]]).tobytes() for k in part],
                    [np.concatenate([r[3] for r in out[k]]).tobytes() for k in part],
                    [pack_places(np.concatenate([r[4] for r in out[k]])) for k in part],
                )

        return each

    return map_columns(joined, make, "bucket int, texts binary, hashes binary, more binary, places binary")


def _repeated(buckets: int):
    """Of one bucket: windows that also start in a text with a smaller key, packed by groups of texts."""

    def make():
        def work(rows):
            head = np.concatenate([np.frombuffer(r[1], "<i8").reshape(3, -1) for r in rows], axis=1)
            h = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
            more = np.concatenate([np.frombuffer(r[3], "<u4") for r in rows])
            place = np.concatenate([unpack_places(r[4]) for r in rows])
            whose = np.repeat(np.arange(head.shape[1]), head[2])
            key = head[0][whose]
            order = np.lexsort((more, h))
            ranked, after = h[order], more[order]
            first = np.flatnonzero(np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (after[1:] != after[:-1])]))
            least = np.minimum.reduceat(key[order], first)
            gone = np.zeros(len(h), bool)
            gone[order] = key[order] > np.repeat(least, np.diff(first, append=len(h)))
            group = bucket_of(mix(head[1].view(np.uint64)), buckets)
            at = np.flatnonzero(gone)
            at = at[np.argsort(group[whose[at]], kind="stable")]
            parts = cut_by(group[whose[at]])
            for i in range(0, len(parts), 64):
                own = [(g, at[x:y]) for g, x, y in parts[i : i + 64]]
                texts = [np.unique(whose[p], return_counts=True) for _, p in own]
                yield (
                    [g for g, _ in own], [np.array([head[0][d], head[1][d], n], "<i8").tobytes() for d, n in texts],
                    [place[p].astype("<u4").tobytes() for _, p in own],
                )

        return work

    return make


def _merged():
    """Of one group of texts: the repeated windows of each."""

    def work(rows):
        head = np.concatenate([np.frombuffer(r[1], "<i8").reshape(3, -1) for r in rows], axis=1)
        place = np.concatenate([np.frombuffer(r[2], "<u4") for r in rows])
        ends = np.cumsum(head[2])
        order = np.lexsort((head[1], head[0]))
        same = np.concatenate([[False], (head[0][order][1:] == head[0][order][:-1]) & (head[1][order][1:] == head[1][order][:-1])])
        own = cut_by(np.cumsum(~same))
        for i in range(0, len(own), 1000):
            part = [order[x:y] for _, x, y in own[i : i + 1000]]
            places = [np.unique(np.concatenate([place[ends[d] - head[2][d] : ends[d]] for d in p])) for p in part]
            yield [int(head[0][p[0]]) for p in part], [int(head[1][p[0]]) for p in part], [pack_places(x) for x in places]

    return work


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with a column sb_windows: packed starts (in words) of the windows of ``window`` words whose word
    sequence also starts in a row with a smaller key; null where there are none.

    Words are runs of anything but 0x20 and 0x09-0x0D, unchanged. Null, empty and short texts have no window; rows with
    equal keys do not remove one another; a null key sorts before all. ``docs`` must be read from files (or a checkpoint):
    the first pass addresses texts by task and place. No group of equal passages is collected: a bucket holds hashes
    of an even share of all windows, and places return packed by groups of texts. A column of a name that is
    added is replaced.
    """
    block = (window + 1) // 2
    buckets = bucket_count(docs, text)
    named = identified(docs, key, text, "sb_windows")
    probes = _probes(named, block, buckets)
    hits = stored(by_bucket(probes, "bucket", _hits, "batch long, head binary, places binary", buckets), "hits")
    places = stored(by_bucket(hits, "batch", _by_text, "id_a long, id_b long, hits binary", buckets), "places")
    near = named.select("id_a", "id_b", "id_text").join(places.dropDuplicates(["id_a", "id_b"]), ["id_a", "id_b"])
    sent = _candidates(near, block, window, buckets)
    found = by_bucket(sent, "bucket", _repeated(buckets), "texts_of int, texts binary, places binary", buckets)
    gone = stored(by_bucket(found, "texts_of", _merged, "id_a long, id_b long, sb_windows binary", buckets), "gone")
    released(hits, places)
    return named.join(gone, ["id_a", "id_b"], "left").select("id_row.*", "sb_windows")


def removed_words(text: bytes, packed: bytes | None, window: int = WINDOW) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and which of them repeated windows cover."""
    words = text.split()
    starts = unpack_places(packed) if packed else np.zeros(0, np.int64)
    return words, cover(starts, window, len(words))


def digests(done: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Counts and a hash of the words that stay."""

    def make():
        def each(keys, texts, packed):
            for k, t, p in zip(keys, texts, packed, strict=True):
                words, gone = removed_words(text_bytes(t), p, window)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if p else words
                yield k, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

        return each

    kind = done.schema[key].dataType.simpleString()
    return map_rows(done.select(key, text, "sb_windows"), make, f"{key} {kind}, n_words long, n_removed long, kept_sha256 string")
