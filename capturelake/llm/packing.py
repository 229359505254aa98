"""Best-fit packing of tokenised documents into fixed-length sequences, certified by lower bounds.

Each partition packs its pieces best-fit decreasing and compares its bin count with a lower bound from
dual-feasible functions. A partition that meets its bound is proven optimal and left alone. Partitions with a gap give
the documents of their unfilled bins to a shared pool, which is dealt anew and packed again, until the pool's
bound is met or a round gains nothing; then the better packing of the pool stays.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from capturelake.llm.text import Spans, blocks, map_rows, released, stored

LENGTH = 2048
END = (0).to_bytes(4, "little")
POOL = 50_000
UNITS_KEPT = 1_000_000
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
_KIND = np.full(256, ODD, np.uint8)
_KIND[33:127] = SIGN
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[0xC3] = LETTER
_KIND[39] = ODD


#: The settings of tokenizer files whose words Encoder knows how to cut.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Library:
    """Token ids of whole texts, straight from the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        return self._encode([r.decode("utf-8") for r in raws])


class Encoder(Library):
    """The same, faster, for files that lower-case and split into words by WORD_RULE.

    Such a tokenizer works on each run between white space alone, so a unit of text is encoded once and remembered. A run
    of plain letters, digits and signs is first cut where the tokenizer's own word rule cuts it; any other run is a unit
    as it stands. Units are looked up by a hash modulo a 61-bit prime and then compared byte by byte. What is remembered
    is bounded and only saves time.
    """

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    @staticmethod
    def knows(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        splits = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        return (
            settings["normalizer"] == WORD_NORMALIZER and splits[0].get("pattern") == {"Regex": WORD_RULE} and settings["model"]["type"] == "BPE"
            and settings["model"].get("end_of_word_suffix") == "</w>"
        )

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.slot, self.known = np.zeros(0, np.int64), []

    def _words(self, units: list[str], group: int = 200) -> list[np.ndarray]:
        """Ids of plain units, many to a call; a unit's last token tells where it ends."""
        out = []
        for i in range(0, len(units), group):
            own = units[i : i + group]
            ids = self._encode([" ".join(own)])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            out += np.split(ids, cuts[:-1]) if len(cuts) == len(own) else self._encode(own)
        return out

    def _learn(self, hashes: np.ndarray, units: list[bytes], plain: np.ndarray) -> None:
        texts = [u.decode("utf-8", "replace") for u in units]
        found: list = [None] * len(texts)
        for rule, own in ((self._words, np.flatnonzero(plain).tolist()), (self._encode, np.flatnonzero(~plain).tolist())):
            for i, ids in zip(own, rule([texts[i] for i in own]), strict=True):
                found[i] = ids
        lengths = np.array([len(x) for x in found], np.int64)
        at = len(self.pool) + np.cumsum(lengths) - lengths
        self.pool = np.concatenate([self.pool, *found])
        order = np.argsort(hashes)
        where = np.searchsorted(self.hashes, hashes[order])
        self.slot = np.insert(self.slot, where, len(self.known) + order)
        self.known += units
        self.hashes = np.insert(self.hashes, where, hashes[order])
        self.at = np.insert(self.at, where, at[order])
        self.length = np.insert(self.length, where, lengths[order])

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.hashes, hashes)
        known = i < len(self.hashes)
        known[known] = self.hashes[i[known]] == hashes[known]
        return i, known

    def units(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, plain) of each unit of some UTF-8 bytes."""
        kind = _KIND[raw]
        pair = np.flatnonzero(raw == 0xC3)
        pair = pair[pair + 1 < len(raw)]
        kind[pair + 1] = np.where((raw[pair + 1] == 0x97) | (raw[pair + 1] == 0xB7), ODD, LETTER)
        bar = np.flatnonzero(raw == 0x7C)
        kind[bar[(bar > 0) & (raw[bar - 1] == 0x3C)]] = ODD
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = kind != SPACE
        step = np.diff(inside)
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if not len(first):
            return first, last, np.zeros(0, bool)
        odd = np.bincount(np.searchsorted(first, np.flatnonzero(kind == ODD), "right") - 1, minlength=len(first)) > 0
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        cut[first] = True
        for a, b in zip(first[odd].tolist(), last[odd].tolist(), strict=True):
            cut[a + 1 : b] = False
        starts = np.flatnonzero(cut[:-1] & inside[1:-1].astype(bool))
        run = np.searchsorted(first, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(raw)), last[run])
        return starts, ends, ~odd[run]

    def ids(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each unit, number of ids before each unit and in all)."""
        raw = np.frombuffer(text, np.uint8)
        starts, ends, plain = self.units(raw)
        if not len(starts):
            return np.zeros(0, "<u4"), starts, np.zeros(1, np.int64)
        h = Spans(raw, fold=True).of(starts, ends)
        if not plain.all():
            odd = ~plain
            h[odd] = Spans(raw).of(starts[odd], ends[odd]) | np.uint64(1 << 63)
        which, distinct = pd.factorize(h)
        place = np.empty(len(distinct), np.int64)
        place[which[::-1]] = np.arange(len(which))[::-1]
        lower = text.lower()
        cut = [(lower if p else text)[a:b] for p, a, b in zip(plain[place].tolist(), starts[place].tolist(), ends[place].tolist(), strict=True)]
        i, known = self._find(distinct)
        own = np.flatnonzero(known)
        kept = list(map(self.known.__getitem__, self.slot[i[own]].tolist()))
        if not known.all() and len(self.hashes) > UNITS_KEPT or kept != list(map(cut.__getitem__, own.tolist())):
            self._forget()
            known[:] = False
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(distinct[new], [cut[k] for k in new.tolist()], plain[place[new]])
            i, _ = self._find(distinct)
        n = self.length[i][which]
        before = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=before[1:])
        return self.pool[np.repeat(self.at[i][which] - before[:-1], n) + np.arange(before[-1])], starts, before

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        ids, units, before = self.ids(b" ".join(raws))
        cuts = before[np.searchsorted(units, np.cumsum([len(r) + 1 for r in raws]))]
        return np.split(ids, cuts[:-1])


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each whole text's ids and the end id 0, cut only beyond ``length``.
    Null and empty texts have the end id alone."""

    def make():
        if tokenizer not in _encoders:
            _encoders[tokenizer] = (Encoder if Encoder.knows(tokenizer) else Library)(tokenizer)
        known = _encoders[tokenizer]

        def each(keys, texts):
            raws = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
            for block in blocks(raws):
                for i, ids in zip(block, known.encode(raws[block.start : block.stop]), strict=True):
                    own = ids.tobytes() + END
                    for p, at in enumerate(range(0, len(own), 4 * length)):
                        part = own[at : at + 4 * length]
                        yield keys[i], p, at // 4, len(part) // 4, zlib.crc32(part)

        return each

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"{key} {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray) -> int:
    """Bins that pieces need at least; counts[s] is the number of pieces of size s, capacity len(counts) - 1.

    The largest value over two families of dual-feasible functions: for each threshold, sizes over capacity less the
    threshold count whole and those under it not at all; and for each k, sizes are rounded to parts of k.
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number = np.cumsum(counts)
    total = np.cumsum(counts * sizes)
    best = -(-int(total[-1]) // capacity)
    a = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - a]
    middle = total[capacity - a] - total[a - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        values = np.where(whole, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * values).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, number of bins) of each piece: largest first, each to the fullest bin that takes it."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, n = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = present >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            own = free[room].pop()
            if not free[room]:
                present ^= 1 << room
        else:
            room, own, n = capacity, n, n + 1
        bins[i], offsets[i] = own, capacity - room
        if left := room - s:
            free[left].append(own)
            present |= 1 << left
    return bins, offsets, n


def _pack(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(sizes, length)
        filled = np.bincount(bins, sizes, n).astype(np.int64)
        gap = n - lower_bound(np.bincount(sizes, minlength=length + 1))
        return frame.assign(pk_bin=bins, pk_offset=offsets, pk_filled=filled[bins], pk_gap=gap)

    return run


def pack(parts: DataFrame, length: int = LENGTH, pool: int = POOL) -> DataFrame:
    """Add sequence_id and offset to ``parts`` (any rows with a long column ``length`` in 1..``length``).

    Rows are numbered once, where they are stored; a partition gets about ``pool`` pieces by a hash of their number, so
    repeated rows, hot keys and very long documents spread evenly and its memory does not grow with the table. Every
    round has fewer sequences than the one before it, or is the last. An empty table stays empty. Ties go to the first row.
    """
    rows = parts if "pk_id" in parts.columns else stored(parts.withColumn("pk_id", F.monotonically_increasing_id()), "numbered")
    columns = rows.columns
    left, done, before, r = rows, None, None, 0
    while True:
        counts = np.zeros(length + 1, np.int64)
        for x in left.groupBy("length").count().collect():  # at most ``length`` rows
            counts[x["length"]] = x["count"]
        groups = max(1, -(-int(counts.sum()) // pool))
        dealt = left.withColumn("pk_deal", F.pmod(F.xxhash64("pk_id", F.lit(r)), F.lit(groups)))
        schema = StructType([*dealt.schema, *(StructField(f"pk_{c}", LongType()) for c in ("bin", "offset", "filled", "gap"))])
        packed = stored(
            dealt.repartition(max(1, min(groups, 4096)), "pk_deal").groupBy("pk_deal").applyInPandas(_pack(length), schema), "packed"
        )
        bins = packed.filter("pk_offset = 0").count()
        if before is not None and bins >= before.filter("offset = 0").count():
            released(packed)
            return done.unionByName(before).drop("pk_id")
        number = (F.lit(r).cast("long") * (1 << 28) + F.col("pk_deal")) * (1 << 24) + F.col("pk_bin")
        now = packed.select(*columns, number.alias("sequence_id"), F.col("pk_offset").alias("offset"), ((F.col("pk_gap") > 0) & (F.col("pk_filled") < length)).alias("pk_open"))
        final = groups == 1 or bins <= lower_bound(counts)
        closed = (now if final else now.filter("not pk_open")).drop("pk_open")
        done = closed if done is None else done.unionByName(closed)
        before = now.filter("pk_open").drop("pk_open")
        if final or before.isEmpty():
            return done.drop("pk_id")
        left, r = before.select(*columns), r + 1


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise whole texts, cut only what is longer than a sequence, and pack the pieces.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor can read; null texts count as empty; every
    row gives at least one piece, repeated rows included."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(stored(pieces(docs, tokenizer, length, key, text).withColumn("pk_id", F.monotonically_increasing_id()), "pieces"), length)
