"""Vector code compression: product codes by integer k-means with norm-of-sum bounds.

Every part of a vector keeps, for each group of codebook entries, a lower bound of its distance to them and the round in
which it was measured (the bound's stamp). All rounds' codebooks are kept, so in a later round a bound is lowered by how far
its group's entries lie from where they were in the stamped round: the norm of the sum of their moves, which no sum of the
moves' norms undercuts. Only groups whose lowered bound does not exceed the exact distance to the part's present entry are
scanned again, in whole numbers. Lowering allows for rounding, so ties are always scanned and codes are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.text import map_columns, quoted, released, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
GROUP = 8
SCALE = 256
#: Components from here on are refused: squares of their scaled values could leave 64 bits.
LARGEST = 2.0**20
#: Share by which bounds are lowered to allow for rounding.
SLACK = 1e-9
STATE = "vec_id long, label string, parts binary, codes binary, bounds binary, stamps binary"


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has neither null nor non-finite components."""
    v = F.col(quoted(vector))
    return vectors.filter(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component."""
    if len(values) and np.abs(values).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST:.0f} or more cannot be coded")
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


def first_books(rows: list[list[float]]) -> np.ndarray:
    """Codebooks (part, entry, position) of the first vectors."""
    own = np.stack([scaled(np.array(r)) for r in rows])
    return own.reshape(len(own), PARTS, -1).transpose(1, 0, 2)


def moved(books: list[np.ndarray], now: int) -> np.ndarray:
    """(stamp, part, group): the greatest distance of a group's entries between the stamped round and the round ``now``."""
    entries = books[now].shape[1]
    cuts = np.arange(0, entries, GROUP)
    away = [np.sqrt(((books[now] - books[s]) ** 2).sum(2, dtype=np.float64)) for s in range(now + 1)]
    return np.stack([np.maximum.reduceat(a, cuts, axis=1) for a in away]) * (1 + SLACK)


def half_down(x: np.ndarray) -> np.ndarray:
    """Half-precision numbers not above ``x`` (which is not negative)."""
    h = np.minimum(x, 60000.0).astype(np.float16)
    return np.where(h.astype(np.float64) > x, np.nextafter(h, np.float16(0)), h).astype(np.float16)


def distances(own: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (n, d) to entries (k, d)."""
    out = np.zeros((len(own), len(entries)), np.int64)
    for j in range(own.shape[1]):
        out += (own[:, j, None] - entries[None, :, j]) ** 2
    return out


def assign(own: np.ndarray, book: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray, away: np.ndarray, now: int) -> tuple[np.ndarray, int]:
    """Nearest entries of the parts at one position. ``code`` (n), ``bound`` and ``stamp`` (n, groups) are brought up to
    date; ``away`` is (stamp, group). Returns the exact squared distances and how many groups were scanned.

    A first scan has bounds below every distance, so that each group is scanned."""
    n, groups = bound.shape
    mine = code.astype(np.int64)
    at_old = ((own - book[mine]) ** 2).sum(1)
    best, entry = at_old.copy(), mine.copy()
    reach = np.sqrt(at_old.astype(np.float64)) * (1 + SLACK)
    lowered = bound.astype(np.float64) - away[stamp, np.arange(groups)[None, :]]
    scans = reach[:, None] >= lowered * (1 - SLACK)
    nearest = np.zeros((n, groups), np.int64)  # of the scanned groups: the least and the next distance, and whose
    second = np.zeros((n, groups), np.int64)
    whose = np.zeros((n, groups), np.int64)
    big = np.iinfo(np.int64).max
    for g in range(groups):
        rows = np.flatnonzero(scans[:, g])
        if not len(rows):
            continue
        first = g * GROUP
        d = distances(own[rows], book[first : first + GROUP])
        least = d.argmin(1)
        at = np.arange(len(rows))
        nearest[rows, g], whose[rows, g] = d[at, least], least + first
        d[at, least] = big
        second[rows, g] = d.min(1)
        closer = (nearest[rows, g] < best[rows]) | (nearest[rows, g] == best[rows]) & (whose[rows, g] < entry[rows])
        best[rows[closer]], entry[rows[closer]] = nearest[rows, g][closer], whose[rows, g][closer]
    other = np.where(whose == entry[:, None], second, nearest)
    fresh = np.where(other == big, 60000.0, np.sqrt(other.astype(np.float64)) * (1 - SLACK))
    bound[scans] = half_down(fresh)[scans]
    stamp[scans] = now
    # an entry that was left counts for its group from now on; had its group not been scanned, its bound is joined with it
    left = np.flatnonzero((entry != mine) & ~scans[np.arange(n), mine // GROUP])
    g = mine[left] // GROUP
    bound[left, g] = half_down(np.maximum(np.minimum(lowered[left, g] * (1 - SLACK), np.sqrt(at_old[left].astype(np.float64)) * (1 - SLACK)), 0))
    stamp[left, g] = now
    code[:] = entry
    return best, int(scans.sum())


def _assigned(rows: DataFrame, books: list[np.ndarray], last: bool) -> DataFrame:
    """One round over stored rows: new codes, bounds and stamps, or with ``last`` codes as text and errors."""
    now = len(books) - 1
    book, away = books[now], moved(books, now)
    groups = away.shape[2]

    def make() -> Callable:
        def each(ids, labels, parts, codes, bounds, stamps):
            n = len(ids)
            own = np.frombuffer(b"".join(parts), "<i4").reshape(n, PARTS, -1).astype(np.int64)
            code = np.frombuffer(b"".join(codes), np.uint8).reshape(n, PARTS).copy()
            bound = np.frombuffer(b"".join(bounds), np.float16).reshape(n, PARTS, groups).copy()
            stamp = np.frombuffer(b"".join(stamps), np.uint8).reshape(n, PARTS, groups).copy()
            error = np.zeros(n, np.int64)
            for p in range(PARTS):
                c, b, s = code[:, p].copy(), bound[:, p].copy(), stamp[:, p].copy()
                error += assign(own[:, p], book[p], c, b, s, away[:, p], now)[0]
                code[:, p], bound[:, p], stamp[:, p] = c, b, s
            if last:
                yield ids, labels, [c.tobytes().hex() for c in code], pa.array(error)
            else:
                yield ids, labels, parts, [c.tobytes() for c in code], [b.tobytes() for b in bound], [s.tobytes() for s in stamp]

        return each

    return map_columns(rows, make, "vec_id long, label string, code string, error long" if last else STATE)


def _opened(kept: DataFrame, groups: int) -> DataFrame:
    """Scaled vectors with bounds that make the first round scan every group."""

    def make() -> Callable:
        def each(ids, labels, vectors):
            n = len(ids)
            own = [scaled(np.array(v)).astype("<i4").tobytes() for v in vectors]
            yield ids, labels, own, [bytes(PARTS)] * n, [bytes(2 * PARTS * groups)] * n, [bytes(PARTS * groups)] * n

        return each

    return map_columns(kept, make, STATE)


def _sums(rows: DataFrame, entries: int, width: int) -> DataFrame:
    """(place, n, sums) of the parts of each entry, added up in the tasks and then by Spark: at most one row for each entry."""

    def make() -> Callable:
        total = np.zeros((PARTS * entries, width + 1), np.int64)

        def each(parts, codes):
            n = len(parts)
            own = np.frombuffer(b"".join(parts), "<i4").reshape(n, PARTS, width).astype(np.int64)
            place = (np.frombuffer(b"".join(codes), np.uint8).reshape(n, PARTS) + np.arange(PARTS) * entries).ravel()
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.diff(place[order], prepend=-1))
            total[place[order][first], 0] += np.diff(first, append=len(order))
            total[place[order][first], 1:] += np.add.reduceat(own.reshape(-1, width)[order], first, axis=0)
            return ()

        def rest():
            used = np.flatnonzero(total[:, 0])
            if len(used):
                yield used, total[used, 0], list(total[used, 1:])

        each.rest = rest
        return each

    found = map_columns(rows.select("parts", "codes"), make, "place int, n long, sums array<long>")
    return found.groupBy("place").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(width)))


def learned(kept: DataFrame, entries: int, rounds: int) -> tuple[list[np.ndarray], DataFrame]:
    """All rounds' codebooks, and the stored rows after the last of these rounds. ``kept``: vec_id, label, vector."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    if not first:
        return [], kept
    books = [first_books([r["vector"] for r in first])]
    state = _opened(kept, -(-len(first) // GROUP))
    for _ in range(rounds):
        before, state = state, stored(_assigned(state, books, False), "codes")
        if len(books) > 1:
            released(before)
        new = books[-1].copy()
        for r in _sums(state, new.shape[1], new.shape[2]).collect():
            new[divmod(r["place"], new.shape[1])] = [r[f"s{i}"] // r["n"] for i in range(new.shape[2])]
        books.append(new)
    return books, state


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """((key, code, error, label_error) of every usable row, the final codebooks (part, entry, position)).

    Components count as floor(256 * x), vectors as PARTS equal parts. A codebook begins with the parts of the ``entries``
    rows with the smallest keys (ties by the vectors; null keys last; fewer rows, fewer entries) and is replaced ``rounds``
    times by floored means; unused entries stay. Nearest goes by squared distance, ties to the lower entry. Rows whose vector
    is null or has null or non-finite components are left out; components of 2**20 or more, vectors of different
    lengths and lengths that PARTS does not divide are errors. Repeated rows are coded alike; other columns are not read;
    no rows give no rows. ``label_error`` adds up the errors of rows with equal labels, nulls together.

    A round reads the stored rows once and shuffles a row for each entry and task; the driver holds codebooks only.
    """
    if not 0 < entries <= 256 or not 0 < rounds < 256:
        raise ValueError("entries must be 1 to 256, rounds 1 to 255")
    kept = usable(vectors, vector).select(
        F.col(quoted(key)).cast("long").alias("vec_id"), F.col(quoted(label)).cast("string").alias("label"), F.col(quoted(vector)).cast("array<double>").alias("vector")
    )
    sizes = kept.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if sizes["least"] != sizes["most"] or (sizes["most"] or 0) % PARTS or sizes["most"] == 0:
        raise ValueError(f"vectors have {sizes['least']} to {sizes['most']} components, not one multiple of {PARTS}")
    books, state = learned(kept, entries, rounds)
    if not books:
        none = kept.select(F.col("vec_id").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, np.zeros((PARTS, 0, 0), np.int64)
    coded = stored(_assigned(state, books, True), "coded")
    released(state)
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "totals").withColumnRenamed("label", "of")
    done = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return done.select(F.col("vec_id").alias(key), "code", "error", "label_error"), books[-1]


def books_sha256(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def code_digests(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    done, book = compress(vectors)
    return done.withColumn("codebooks_sha256", F.lit(books_sha256(book)))


def _round_sql(n: int) -> str:
    """Assignments a{n} of the parts to the codebooks b{n}, and the codebooks b{n+1}."""
    return f"""
a{n} as (
    select vec_id, p, any_value(v.x) as x, any_value(label) as label, arg_min(e, (d, e)) as e, min(d) as d
    from (select v.vec_id, v.p, v.x, v.label, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v join b{n} b on v.p = b.p) v
    group by vec_id, p
)"""


def _means_sql(n: int) -> str:
    return f"""
m{n} as (
    select p, e, list(floor(s::decimal(38, 0) / c)::bigint order by i) as x
    from (select p, e, i, sum(x[i]) as s, count(*) as c from a{n}, range(1, 1000) r(i) where i <= len(x) group by p, e, i) group by p, e
), b{n + 1} as (select b.p, b.e, coalesce(m.x, b.x) as x from b{n} b left join m{n} m on m.p = b.p and m.e = b.e)"""


ORACLE = f"""
with k as (
    select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), v as (
    select vec_id, label, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] as x from k, range(0, {PARTS}) r(p)
), b0 as (
    select v.p, f.e, v.x from v join (select vec_id, row_number() over (order by vec_id) - 1 as e from k order by vec_id limit {ENTRIES}) f on f.vec_id = v.vec_id
), {_round_sql(0)}, {_means_sql(0)}, {_round_sql(1)}, {_means_sql(1)}, {_round_sql(2)},
done as (
    select vec_id, any_value(label) as label, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a2 group by vec_id
), books as (
    select sha256(string_agg(t, ',' order by p, e)) as codebooks_sha256 from (select p, e, array_to_string(x, ',') as t from b2)
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from done, books
"""
