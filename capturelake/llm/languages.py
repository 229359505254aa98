"""Language ID by mixture inference.

Each document's trigrams are explained as a mixture of the learned languages: expectation-maximisation estimates the
proportions, and the set of languages is the one with the best penalised likelihood.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.text import keep_rows, map_rows

BUCKETS = 4096
SMOOTHING = 0.5
#: Expectation-maximisation ends when no proportion moves by more.
SETTLED = 1e-3
#: Different labels beyond which learning refuses: the driver holds BUCKETS counts for each.
MOST_LABELS = 512
PENALTY = 2.0
REJECT_UNDER = 0.34
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    """Whether some character is in a Unicode category of letters (digits in circles and the like are not)."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def trigrams(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed byte trigrams of each text, lower-cased, with everything but letters as one space."""
    raws = [b" " + t.lower().encode("utf-8", "replace") + b" " if t else b" " for t in texts]
    raw = _CLEAN[np.frombuffer(b"".join(raws) + b"  ", np.uint8)].astype(np.uint32)
    h = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h >> np.uint32(20)).astype(np.int64)
    sizes = np.array([len(r) for r in raws])
    h += np.repeat(np.arange(len(raws)) * BUCKETS, sizes)
    use = (raw[1:-1] != 32) | (raw[:-2] != 32) & (raw[2:] != 32)
    return np.bincount(h[use], minlength=len(raws) * BUCKETS).reshape(-1, BUCKETS)


def held_out(key: str) -> Column:
    """True where crc32 of the key as text is 2 modulo 4; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Trigram probabilities of every language label, counted over all labelled documents that are not held out.

    Counts are added up in the tasks and then by Spark; what reaches the driver is one row for each language and
    bucket, whatever the corpus; more than MOST_LABELS labels are refused."""

    def make():
        held: dict[str, np.ndarray] = {}

        def each(texts, langs):
            counts = trigrams(texts)
            for own in set(langs):
                rows = [i for i, x in enumerate(langs) if x == own]
                total = counts[rows].sum(0)
                held[own] = held[own] + total if own in held else total
            return ()

        def rest():
            for own, total in held.items():
                for b in np.flatnonzero(total).tolist():
                    yield own, b, int(total[b])

        each.rest = rest
        return each

    use = docs.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    if use.select(lang).distinct().limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} language labels")
    rows = map_rows(use.select(text, lang), make, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(langs), BUCKETS))
    for r in rows:
        counts[langs.index(r["lang"]), r["bucket"]] = r["n"]
    counts += SMOOTHING
    return langs, (counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _expect(counts: np.ndarray, total: np.ndarray, weights: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions at which expectation-maximisation settles, document by document, and their log likelihood."""
    weights, open_ = weights.copy(), np.arange(len(counts))
    while len(open_):
        own = counts[open_]
        new = weights[open_] * ((own / (weights[open_] @ q)) @ q.T) / total[open_, None]
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - weights[open_]).max(1)
        weights[open_] = new
        open_ = open_[moved > SETTLED]
    return weights, (counts * np.log(weights @ q)).sum(1)


def infer(counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Proportions of the languages in each document; languages outside the chosen set have 0. From all languages the
    least one leaves, step by step; the set with the best penalised likelihood stays."""
    counts = counts.astype(np.float32)
    total = np.maximum(counts.sum(1), 1)
    n, k = len(counts), len(q)
    alone = counts @ np.log(q).T
    best = alone.argmax(1)
    out = np.zeros((n, k), np.float32)
    out[np.arange(n), best] = 1
    if k < 2:
        return out
    full, fit = _expect(counts, total, np.full((n, k), 1 / k, np.float32), q)
    price = PENALTY * np.log(total + 1)
    top = alone[np.arange(n), best]
    mixed = np.flatnonzero(fit - top > price)
    reached = top[mixed]
    weights, fit = full[mixed], fit[mixed]
    for size in range(k, 1, -1):
        if not len(mixed):
            break
        gain = fit - price[mixed] * (size - 1)
        better = gain > reached
        out[mixed[better]] = weights[better]
        reached = np.maximum(reached, gain)
        weights = weights.copy()
        weights[weights == 0] = np.inf
        weights[np.arange(len(weights)), weights.argmin(1)] = 0
        weights[np.isinf(weights)] = 0
        weights = np.where(weights > 0, np.maximum(weights, 1e-3), 0)
        weights, fit = _expect(counts[mixed], total[mixed], weights / weights.sum(1, keepdims=True), q)
    return out


def classify(texts: list[str | None], langs: list[str], q: np.ndarray) -> list[tuple[str, float, list[float]]]:
    """(label, its proportion, all proportions); ``und`` for null texts and those without a letter."""
    weights = infer(trigrams(texts), q) if langs else None
    out = []
    for i, t in enumerate(texts):
        if not langs or not t or not has_letter(t):
            out.append((UNKNOWN, 0.0, [0.0] * len(langs)))
        else:
            top = int(weights[i].argmax())
            out.append((langs[top], min(1.0, float(weights[i, top])), [float(w) for w in weights[i]]))
    return out


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score, proportions map) of every row. Labels are read only to learn, from rows that
    are not held out; with no label at all every row is ``und``. Ties go to the label that sorts first."""
    langs, q = learn(docs, key, text, lang)

    def make():
        def each(keys, held, texts):
            for k, h, (label, score, shares) in zip(keys, held, classify(texts, langs, q), strict=True):
                yield k, h, label, score, [(x, s) for x, s in zip(langs, shares, strict=True) if s > 0]

        return each

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, held_out boolean, lang_pred string, score double, proportions map<string,double>"
    return map_rows(docs.select(F.col(key), held_out(key), F.col(text)), make, schema)


def keep_known(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = REJECT_UNDER) -> DataFrame:
    """``docs`` without those rejected: no letter or no text, or no language that makes up ``least`` of the text."""
    langs, q = learn(docs, key, text, lang)

    def make():
        return lambda texts: [label != UNKNOWN and score >= least for label, score, _ in classify(texts, langs, q)]

    return keep_rows(docs, text, make)
