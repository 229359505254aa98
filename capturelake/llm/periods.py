"""Periodic run detection by an online sparse diagonal DP over the words of each text.

A run is a stretch of words whose smallest period is q and which no neighbouring word extends. On the diagonal of lag q it
is a match of ``length - q`` words. For each word, an earlier occurrence that shares the words before it opens the
diagonal of its lag; every active diagonal whose word recurs grows by one; one that does not ends, and emits its run there
if it is long enough.

The earlier occurrences are thinned without loss. A diagonal of lag q counts only with 2q matching words, so it holds a
gram of g words for the power of two g with g/2 < q <= g, and one whose own period is above g/2, or q were no smallest
period. Such a gram has one occurrence at most at a lag in (g/2, g], its nearest. So for every g a word needs its gram's
nearest earlier occurrence only, and texts of one repeated word cost as much as others: n log n at most for n words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.text import add_columns, text_bytes

LEAST_WORDS = 24
LEAST_PERIODS = 3


def numbered(words: list) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    known: dict = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def openings(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag) wherever the gram of g words that ends at a word occurred before, last at a lag in (g/2, g], for any
    power of two g; by word. Grams are named by doubling; those that occur once are dropped, as longer ones then do too."""
    n = len(ids)
    names, at, gram = ids, np.arange(n), 1
    words, lags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        order = np.argsort(names, kind="stable")
        place, ranked = at[order], names[order]
        same = ranked[1:] == ranked[:-1]
        lag = (place[1:] - place[:-1])[same]
        near = (lag > gram // 2) & (lag <= gram)
        words.append(place[1:][same][near])
        lags.append(lag[near])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        number = np.cumsum(np.concatenate([[True], ~same]))
        dense = np.full(n, -1, np.int64)
        dense[place[again]] = number[again]
        if 3 * gram >= n:  # a diagonal of a longer lag cannot reach three periods
            break
        before = np.full(n, -1, np.int64)
        before[gram:] = dense[:-gram]
        at = np.flatnonzero((dense >= 0) & (before >= 0))
        names = before[at] * (n + 1) + dense[at]
        gram *= 2
    word, lag = np.concatenate(words), np.concatenate(lags)
    order = np.lexsort((lag, word))
    return word[order], lag[order]


def find(ids: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if periods < 3:
        raise ValueError("runs of fewer than three periods are not searched")
    word, lag = openings(ids)
    if not len(word):
        return []
    own, n = ids.tolist(), len(ids)
    opened = list(zip(word.tolist(), lag.tolist(), strict=True))
    runs, active, i, at = [], {}, 0, 0

    def end(lag: int, stop: int) -> None:
        length = active.pop(lag) + lag
        if length >= max(least, periods * lag):
            runs.append((stop - length, length, lag))

    while at < len(opened) or active:
        if not active:
            i = opened[at][0]
        if i == n:
            for d in list(active):
                end(d, n)
            break
        for d in list(active):
            if own[i] == own[i - d]:
                active[d] += 1
            else:
                end(d, i)
        while at < len(opened) and opened[at][0] == i:
            d = opened[at][1]
            at += 1
            if d not in active:  # its first words lie before the gram by which it was seen
                first = i
                while first > d and own[first - 1] == own[first - 1 - d]:
                    first -= 1
                active[d] = i + 1 - first
        i += 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words without those that some run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    dropped = np.cumsum(gone[:-1]) > 0
    return [w for w, d in zip(words, dropped.tolist(), strict=True) if not d]


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with columns pr_runs (array of start, length, period: by start, then period) and pr_kept (the words that
    stay, joined by one space): of each run only its first period stays, unless another run drops words of it.

    Words are runs of anything but 0x20 and 0x09-0x0D, unchanged, numbered from 0. A run has at least ``least`` words and
    ``periods`` periods (three or more). Null, empty and blank texts have no run and keep no word; rows are judged one by
    one, so repeated rows, null keys and extra columns do not matter. Columns of the added names are replaced. A text
    is searched whole in the task that reads it; nothing is shuffled.
    """

    def make():
        def each(texts):
            found, kept = [], []
            for t in texts:
                words = text_bytes(t).split()
                runs = find(numbered(words), least, periods)
                found.append([{"start": a, "length": n, "period": p} for a, n, p in runs])
                kept.append(b" ".join(collapsed(words, runs) if runs else words).decode("utf-8", "replace"))
            return found, kept

        return each

    return add_columns(docs, [text], make, "pr_runs array<struct<start:long,length:long,period:long>>, pr_kept string")


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text, the texts with the contract's test runs: with h the crc32 of the decimal key and g = floor(h / 10), where
    h % 10 = 0 each word i >= a is word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). Rows with a
    null key and texts without words stay as they are."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.crc32(F.col(key).cast("string")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % greatest(n, 1L)")))
    rows = rows.withColumn("p", F.expr("1L + (n - a) div (3 + g % 8)"))
    made = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select(F.col("key").alias(key), F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias(text))


def run_digests(done: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns: the run of the greatest exact length / period, and hashes of runs and kept words."""
    runs = F.col("pr_runs")

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    lines = F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    rows = done.select(
        key, F.size(runs).cast("long").alias("n_runs"), F.aggregate(runs, none, better).alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("pr_kept"), 256).alias("collapsed_sha256"),
    )
    return rows.select(
        key, "n_runs", "best.start", "best.length", "best.period",
        F.floor(F.try_divide(F.col("best.length") * 1000, F.col("best.period"))).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
