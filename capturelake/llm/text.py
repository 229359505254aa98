"""Small helpers shared by the text operators: Arrow batches in, rows out, and numpy word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from capturelake.shared import shared_folder

OUT_ROWS = 2000
#: Bytes of text for which an operator that deals hashes into buckets makes one bucket at least.
BUCKET_BYTES = 16 << 20
PRIME = np.uint64(2**61 - 1)
#: The base of word hashes, below the prime.
BASE = 0x1C5B3A7D9E64F281
PIECE = 4 << 20
_LOW32, _LOW29 = np.uint64(2**32 - 1), np.uint64(2**29 - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A byte counts as its value and one, so that no byte is without effect.
_VALUES = np.arange(1, 257, dtype=np.uint64)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_powers: list[np.ndarray] = []
#: Spark then removes a query's shuffle files at its end, not only when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str | StructType) -> DataFrame:
    """Arrow map without pandas. ``make()`` runs once a task and returns a function that takes a batch's
    columns as Python lists and yields output tuples; they leave in small batches, so memory stays bounded."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, rows, held = make(), [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow, strict=True)], schema=arrow
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for row in each(*(c.to_pylist() for c in part.columns)):
                    rows.append(row)
                    held += sum(len(x) for x in row if isinstance(x, bytes | str))
                    if len(rows) >= OUT_ROWS or held > 8 << 20:
                        yield out()
                        rows, held = [], 0
        for row in getattr(each, "rest", tuple)():
            rows.append(row)
            if len(rows) >= OUT_ROWS:
                yield out()
                rows = []
        if rows:
            yield out()

    return df.mapInArrow(run, kind)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def released(*frames: DataFrame) -> None:
    """Empty the folders of frames from ``stored`` that nothing reads any more."""
    for df in frames:
        if files := df.inputFiles():
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(docs: DataFrame, text: str) -> int:
    """Buckets for hashes of a text column: what one holds does not grow with the table."""
    return max(partitions(docs.sparkSession), -(-sized(docs, text) // BUCKET_BYTES))


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit hashes (an xor-shift multiply finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2**32 modulo the prime, for x < 2**62, not fully reduced (less than 2**62)."""
    return ((x & _LOW29) << np.uint64(32)) + (x >> np.uint64(29))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    low = a0 * b0
    return _reduced(np.uint64(8) * a1 * b1 + _shifted(a1 * b0 + a0 * b1) + (low & PRIME) + (low >> np.uint64(61)))


def powers(n: int) -> list[np.ndarray]:
    """BASE**i modulo the prime as (low half, high half), and BASE**-i, for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        made = []
        for base in (BASE, pow(BASE, -1, int(PRIME))):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                p[done : 2 * done] = times(p[:done], np.uint64(pow(base, done, int(PRIME))))
                done *= 2
            made.append(p)
        _powers[:] = made[0] & _LOW32, made[0] >> np.uint64(32), made[1]
    return [p[:n] for p in _powers]


class Spans:
    """Hashes of any spans of some bytes: a polynomial modulo the prime 2**61 - 1. Unlike one modulo a power of two, it has
    no structured texts that collide; two different spans of n bytes do with a chance of about n / 2**61.

    Prefix sums of both halves of the powers wrap around at 2**64; differences over up to PIECE bytes are exact."""

    def __init__(self, raw: np.ndarray, fold: bool = False):
        low, high, self.down = powers(len(raw) + 1)
        value = (_FOLDED if fold else _VALUES)[raw]
        self.low, self.high = np.zeros(len(raw) + 1, np.uint64), np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value * low[:-1], out=self.low[1:])
        np.cumsum(value * high[:-1], out=self.high[1:])

    def _part(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low = self.low[j] - self.low[i]
        return _reduced(_shifted(self.high[j] - self.high[i]) + (low & PRIME) + (low >> np.uint64(61)))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes below 2**61 of the bytes from i to j."""
        longest = int((j - i).max()) if len(i) else 0
        total = self._part(i, np.minimum(j, i + PIECE))
        for k in range(PIECE, longest, PIECE):
            total = _reduced(total + self._part(np.minimum(i + k, j), np.minimum(i + k + PIECE, j)))
        return times(total, self.down[i])


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09-0x0D."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start, end) of each word of a text's UTF-8 bytes; ``fold`` lower-cases A-Z. Long texts are hashed in
    pieces of whole words."""
    starts, ends = word_bounds(raw)
    out, a = [np.zeros(0, np.uint64)], 0
    while a < len(starts):
        first = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, first + PIECE, "right")))
        out.append(mix(Spans(raw[first : ends[b - 1]], fold).of(starts[a:b] - first, ends[a:b] - first)))
        a = b
    return np.concatenate(out), starts, ends


def word_factors(n: int, second: bool = False) -> np.ndarray:
    """Odd factors by which the hashes of the words of a window count, by place."""
    at = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(at ^ np.uint64(0x5851F42D4C957F2D)) if second else at) | np.uint64(1)


def window_hashes(words: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """64-bit hash of each run of ``width`` words; order counts. ``second`` asks for an independent one."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = word_factors(width, second)
    h = words[:n] * factors[0]
    for j in range(1, width):
        h += words[j : j + n] * factors[j]
    return mix(h)


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of length n that is true where a window of ``width`` that begins at one of ``starts`` lies."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:n]) > 0


def sized(df: DataFrame, column: str) -> int:
    """Bytes in a text column, by one aggregate; what is broadcast is checked against a bound with it."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column) + 64), F.lit(0)).alias("n")).first()["n"]


def blocks(raws: list[bytes], most: int = 1 << 20) -> Iterator[range]:
    """Consecutive texts in ranges of about ``most`` bytes; a longer text is alone."""
    first = held = 0
    for i, raw in enumerate(raws):
        if held and held + len(raw) > most:
            yield range(first, i)
            first, held = i, 0
        held += len(raw) + 1
    if first < len(raws):
        yield range(first, len(raws))


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, *replaced: str) -> list[str]:
    """The columns of ``df`` but those named ``replaced``; as for Spark, case does not tell names apart."""
    gone = {c.lower() for c in replaced}
    return [c for c in df.columns if c.lower() not in gone]


def _whole(df: DataFrame) -> DataFrame:
    """Rows as one struct of numbered fields, so that no column's name matters on the way through Python."""
    return df.select(F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns))).alias("whole"))


def _unfolded(df: DataFrame, names: list[str], use: list[str]) -> list[Column]:
    return [F.col("whole")[f"c{names.index(c)}"].alias(c, metadata=df.schema[c].metadata) for c in use]


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable]) -> DataFrame:
    """Rows of ``df``, all columns as they are, for which ``make()``'s function of a list of values says true."""
    at = df.columns.index(column)
    whole = _whole(df)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                yield part.filter(pa.array(keep(part.column(0).field(at).to_pylist()), pa.bool_()))

    return whole.mapInArrow(run, whole.schema).select(*_unfolded(df, df.columns, df.columns))


def add_columns(df: DataFrame, columns: list[str], make: Callable[[], Callable], added: str) -> DataFrame:
    """``df`` with columns ``added`` (a schema); those of these names are replaced. ``make()`` runs once a task and returns
    a function that takes lists of the values of ``columns`` and returns a list of values for each column added."""
    extra = _parse_datatype_string(added)
    at = [df.columns.index(c) for c in columns]
    whole = _whole(df)
    kind = StructType([*whole.schema.fields, *extra.fields])
    arrow = to_arrow_schema(extra)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                values = each(*(part.column(0).field(i).to_pylist() for i in at))
                made = [pa.array(c, f.type) for c, f in zip(values, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["whole", *extra.names])

    done = whole.mapInArrow(run, kind)
    return done.select(*_unfolded(df, df.columns, others(df, *extra.names)), *extra.names)


def joined_words(raws: list[bytes], fold: bool, separators: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Word hashes of several texts at once: (hash, text number, first word of each text and the count of all)."""
    raw = np.frombuffer(b"\n".join(raws), np.uint8)
    if separators is not None:
        raw = np.where(separators[raw], np.uint8(32), raw)
    h, starts, _ = word_hashes(raw, fold)
    ends = np.cumsum([len(r) + 1 for r in raws])
    first = np.concatenate([[0], np.searchsorted(starts, ends)])
    return h, np.repeat(np.arange(len(raws)), np.diff(first)), first


def map_columns(df: DataFrame, make: Callable[[], Callable], schema: str | StructType, most: int = 4 << 20) -> DataFrame:
    """Arrow map in whole columns. ``make()`` runs once a task and returns a function that takes a batch's columns as
    Python lists and yields tuples of output columns; ``most`` bounds the text bytes of a call."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()

        def sent(columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            step = max(1, min(1024, most * max(1, batch.num_rows) // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                for columns in each(*(c.to_pylist() for c in batch.slice(at, step).columns)):
                    yield sent(columns)
        for columns in getattr(each, "rest", tuple)():
            yield sent(columns)

    return df.mapInArrow(run, kind)


def identified(docs: DataFrame, key: str, text: str, *replaced: str) -> DataFrame:
    """(id_row, id_a, id_b, id_text): a whole row as a struct, so that no column name of it can clash, its key as a long that
    is never null, a hash of its text, and the text. Rows that repeat key and text are one document. Columns named
    ``replaced`` are left out, as the operator gives columns of these names itself."""
    return docs.select(
        F.struct(*(F.col(quoted(c)) for c in others(docs, *replaced))).alias("id_row"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("id_a"),
        F.xxhash64(text).alias("id_b"), F.col(text).alias("id_text"),
    )


def pack_places(places: np.ndarray) -> bytes:
    """32-bit places as gaps modulo 2**32, byte plane by byte plane (zeros then compress well if they rise)."""
    gaps = np.diff(places.astype(np.int64), prepend=0).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_places(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32).astype(np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Even deal of 64-bit hashes by their upper half."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cut_by(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of each run of equal keys."""
    if not len(keys):
        return []
    edges = np.flatnonzero(np.diff(keys)) + 1
    first = np.concatenate([[0], edges])
    return list(zip(keys[first].tolist(), first.tolist(), [*edges.tolist(), len(keys)], strict=True))


def by_bucket(df: DataFrame, column: str, make: Callable[[], Callable], schema: str, buckets: int = 0) -> DataFrame:
    """Deal rows by ``column`` and call ``make()``'s function with the rows (as tuples) of one value at a time; it yields
    tuples of output columns."""

    def each_group():
        work = make()
        held: list[tuple] = []

        def each(*columns):
            for row in zip(*columns, strict=True):
                if held and held[-1][0] != row[0]:
                    yield from work(held)
                    held.clear()
                held.append(row)

        def rest():
            if held:
                yield from work(held)

        each.rest = rest
        return each

    others = [c for c in df.columns if c != column]
    dealt = df.select(column, *others).repartition(buckets or partitions(df.sparkSession), column).sortWithinPartitions(column)
    return map_columns(dealt, each_group, schema)
