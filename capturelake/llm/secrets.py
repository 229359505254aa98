"""Secret scans: an Aho-Corasick keyword pass, regular expressions anchored at its hits, checksums last.

Kinds ``assign``, ``access`` and ``hex`` are matched by shape. Kinds ``github`` and ``npm`` are tokens whose last six
characters are the base-62 CRC-32 of the rest: only those whose checksum holds are reported.
"""

from __future__ import annotations

import itertools
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.text import map_rows

KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_LEAST = 24
HEX_GRAM = 4


def automaton():
    """Keywords of all kinds. A hex run of 24 holds a four-character gram, so its grams are its keywords."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for gram in itertools.product("0123456789abcdef", repeat=HEX_GRAM):
        found.add_word("".join(gram), ("hex", HEX_GRAM))
    for word in WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for word in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"):
        found.add_word(word, ("github", 4))
    found.add_word("npm_", ("npm", 4))
    found.make_automaton()
    return found


def checksum(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def scan(text: str, keywords) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, in code points."""
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    last = dict.fromkeys(KINDS, 0)
    out = []
    for end, (kind, width) in sorted(keywords.iter(folded), key=lambda x: x[0] - x[1][1]):
        at = end - width + 1
        if at < last[kind]:
            continue
        if kind == "hex":
            m = HEX.match(text, at)
            if not m:
                continue
            last[kind] = m.end()
            while at and text[at - 1] in "0123456789abcdef":
                at -= 1
            if m.end() - at >= HEX_LEAST:
                out.append((at, kind, m.end()))
        elif kind == "assign":
            if m := ASSIGN.match(text, at):
                last[kind] = m.end()
                if len(m[2]) >= 6:
                    out.append((at, kind, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                last[kind] = m.end()
                if m.end() - at >= 20:
                    out.append((at, kind, m.end()))
        elif (m := CHECKED.match(text, at)) and checksum(m[0][4:-6]) == m[0][-6:]:
            last[kind] = m.end()
            out.append((at, kind, m.end()))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, secrets array<struct<kind,start,end>>) over the whole text. Null and empty texts
    have none. Repeated rows are scanned alike."""

    def make():
        keywords = automaton()

        def each(keys, texts):
            for k, t in zip(keys, texts, strict=True):
                yield k, [{"kind": kind, "start": a, "end": b} for a, kind, b in scan(t or "", keywords)]

        return each

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), make, f"{key} {kind}, secrets array<struct<kind:string,start:int,end:int>>")


def secret_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and span digests of ``find_secrets``."""
    def joined(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda x: x["kind"].isin(*KINDS[:3]))
    return found.select(
        key, *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )

