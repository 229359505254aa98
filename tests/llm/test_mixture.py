"""Language mixtures against every set of languages, each settled by plain expectation-maximisation."""

import itertools
import math

import numpy as np

from capturelake.llm import languages


def plain_trigrams(text):
    """Hashed trigram counts, letter by letter."""
    raw = b" " + text.lower().encode() + b" "
    raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw) + b"  "
    out = [0] * languages.BUCKETS
    for i in range(len(raw) - 2):
        a, b, c = raw[i : i + 3]
        if i + 2 < len(raw) and (b != 32 or a != 32 and c != 32):
            h = a * 0x9E3779B1 & 0xFFFFFFFF ^ b * 0x85EBCA77 & 0xFFFFFFFF ^ c * 0xC2B2AE3D & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            out[h >> 20] += 1
    return out


def test_trigrams_match_plain_counts():
    texts = ["plain words, twice: plain words", "é à ü 12 z", "A", "  ", "one\ntwo-three"]
    got = languages.trigrams([*texts, None])
    for text, row in zip(texts, got, strict=False):
        assert row.tolist() == plain_trigrams(text)
    assert got[-1].sum() == 0


def best_set(counts, q):
    """(set, weights) with the best penalised likelihood among all sets of languages."""
    use = np.flatnonzero(counts)
    n, total, best = counts[use].astype(float), counts.sum(), None
    for size in range(1, len(q) + 1):
        for own in itertools.combinations(range(len(q)), size):
            p, w = q[list(own)][:, use].astype(float), [1 / size] * size
            for _ in range(400):
                mixed = [sum(w[k] * p[k][b] for k in range(size)) for b in range(len(use))] if len(use) < 40 else np.array(w) @ p
                w = [float((n * w[k] * p[k] / mixed).sum()) / total for k in range(size)]
            score = float((n * np.log(np.array(w) @ p)).sum()) - languages.PENALTY * math.log(total + 1) * (size - 1)
            if best is None or score > best[0]:
                best = score, own, w
    return best[1:]


def test_mixtures_match_all_sets():
    rng = np.random.default_rng(4)
    q = rng.dirichlet(np.full(languages.BUCKETS, 0.05), 4) + 1e-7
    q = (q / q.sum(1, keepdims=True)).astype(np.float32)
    mixes = [(1, 0, 0, 0), (0, 0, 1, 0), (0.5, 0.5, 0, 0), (0.7, 0, 0.3, 0), (0.34, 0.33, 0.33, 0), (0.25, 0.25, 0.25, 0.25), (0, 0.15, 0, 0.85)]
    counts = np.stack([rng.multinomial(size, np.array(m) @ (q / q.sum(1, keepdims=True, dtype=float)).astype(float) / (np.array(m) @ (q / q.sum(1, keepdims=True, dtype=float)).astype(float)).sum()) for m in mixes for size in (30, 300, 3000)])
    got = languages.infer(counts, q)
    for row, w in zip(counts, got, strict=True):
        own, weights = best_set(row, q)
        assert tuple(np.flatnonzero(w).tolist()) == own
        assert np.abs(w[list(own)] - weights).max() < 0.01
    assert abs(got.sum(1) - 1).max() < 1e-5
    assert {len(np.flatnonzero(w)) for w in got} == {1, 2, 3, 4}
