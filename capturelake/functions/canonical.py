"""Canonical JSON, hashes and encodings of records. Record text is the truth; columns are derived from it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

GENESIS = "0" * 64


def _number(x: float) -> str:
    """A number as JavaScript prints it."""
    if isinstance(x, int):
        x = float(x) if abs(x) >= 2**53 else x
    if isinstance(x, int):
        return str(x)
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("number is not finite")
    if x == 0:
        return "0"
    mantissa, _, power = f"{x!r}".partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(digits)
    digits = digits.rstrip("0") or "0"
    if -6 < point <= 21:
        if point <= 0:
            return sign + "0." + "0" * -point + digits
        return sign + (digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}")
    power = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if power > 0 else '-'}{abs(power)}"


def canonical_text(text: str) -> str:
    """Sorted keys (by UTF-16 units), no spaces, nulls kept, -0 as 0."""

    def out(v, path: str) -> str:
        if v is None or isinstance(v, bool | str):
            return json.dumps(v, ensure_ascii=False)
        if isinstance(v, int | float):
            try:
                return _number(v)
            except ValueError as e:
                raise ValueError(f"{e} at {path}") from e
        if isinstance(v, list):
            return "[" + ",".join(out(x, f"{path}[{i}]") for i, x in enumerate(v)) + "]"
        keys = sorted(v, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{out(v[k], f'{path}.{k}')}" for k in keys) + "}"

    return out(json.loads(text), "$")


def pruned_text(text: str, key: str) -> str:
    """Canonical text of an object without one key."""
    return canonical_text(json.dumps({k: v for k, v in json.loads(text).items() if k != key}))


@F.pandas_udf(StringType())
def _canonical_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: None if x is None else canonical_text(x))


@F.pandas_udf(StringType())
def _pruned_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, keys in batches:
        yield pd.Series([None if t is None else pruned_text(t, k) for t, k in zip(texts, keys, strict=True)])


def _strange(text: Column) -> Column:
    """Whether a text may hold numbers that JavaScript prints otherwise: exponents, many digits, very small ones."""
    return text.rlike(r"(^|[:\[,])\s*-?([0-9]+(\.[0-9]+)?[eE]|[0-9.]{16}|0\.0000)")


def canonicalise(text: Column) -> Column:
    """Canonical JSON of a text column, in the JVM; texts with numbers that JavaScript prints otherwise (exponents, more
    than 15 digits) go through a helper. Text that is not JSON is an error."""
    strange = _strange(text)
    return F.when(strange, _canonical_udf(F.when(strange, text))).otherwise(F.to_json(F.parse_json(text)))


def prune_key(text: Column, key: str) -> Column:
    """Canonical text of an object without one key."""
    strange = _strange(text)
    entries = F.from_json(text, "map<string,variant>")
    plain = F.to_json(F.parse_json(F.to_json(F.map_filter(entries, lambda k, _: k != key))))
    return F.when(strange, _pruned_udf(F.when(strange, text), F.lit(key))).otherwise(plain)


#: SQL of the text of a double v whose Java text t has an exponent, step by step.
_FAR_NUMBER = (
    {"w": "substring_index(substring_index(s.t, 'E', 1), '.', 1)", "f": "substring_index(substring_index(s.t, 'E', 1), '.', -1)", "e": "cast(substring_index(s.t, 'E', -1) as int)"},
    {"d": "regexp_replace(concat(s.w, s.f), '0+$', '')", "p": "length(s.w) + s.e"},
    {"n": "length(s.d)"},
    {
        "out": """case when s.p > -6 and s.p <= 0 then concat('0.', repeat('0', -s.p), s.d) when s.p > 0 and s.p <= 21 and s.n <= s.p then concat(s.d, repeat('0', s.p - s.n))
        when s.p > 0 and s.p <= 21 then concat(substring(s.d, 1, s.p), '.', substring(s.d, s.p + 1, s.n))
        else concat(substring(s.d, 1, 1), case when s.n > 1 then concat('.', substring(s.d, 2, s.n)) else '' end, 'e', case when s.p > 1 then '+' else '-' end, abs(s.p - 1)) end"""
    },
)


def _far_number(size: Column) -> Column:
    out = F.transform(F.array(size.cast("string")), lambda t: F.struct(t.alias("t")))
    known = ["t"]
    for step in _FAR_NUMBER:
        out = F.call_function("transform", out, F.expr(f"s -> named_struct({', '.join([*(f"'{n}', s.{n}" for n in known), *(f"'{n}', {e}" for n, e in step.items())])})"))
        known += step
    return F.get(out, F.lit(0))["out"]


def number_text(x: Column) -> Column:
    """A double as JavaScript prints it: no point for whole numbers, plain digits from 1e-6 up to 1e21, else an exponent."""
    size = F.abs(x)
    near = F.regexp_replace(size.cast("string"), r"\.0$", "")
    text = F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), F.when(size.between(1e-3, 9999999.0), near).otherwise(_far_number(size))))
    return F.when(F.isnan(x), "NaN").when(size == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity")).otherwise(text)


def fixed_text(x: Column, places: int) -> Column:
    """A double to ``places`` digits after the point (at most 6), rounded by its exact binary value, halves away from zero:
    1.005 is under its half and gives 1.00. Numbers of 1e15 and more are printed as by ``number_text``."""
    scale = f"{10.0**places!r}D"
    steps = (
        {"v": "s.v", "h": "134217729D * s.v - (134217729D * s.v - s.v)", "p": f"s.v * {scale}"},
        {"l": "floor(s.p)", "p": "s.p", "r": f"(s.h * {scale} - s.p) + (s.v - s.h) * {scale}"},
        {"u": "cast(s.l + case when (s.p - s.l - 0.5D) + s.r >= 0 then 1 else 0 end as string)"},
        {"u": f"lpad(s.u, greatest(length(s.u), {places + 1}), '0')"},
        {"out": f"concat(substring(s.u, 1, length(s.u) - {places}), '{'.' if places else ''}', substring(s.u, length(s.u) - {places - 1}, {places}))"},
    )
    size = F.abs(x)
    out = F.transform(F.array(F.when(size < 1e15, size)), lambda v: F.struct(v.alias("v")))
    for step in steps:
        out = F.call_function("transform", out, F.expr(f"s -> named_struct({', '.join(f"'{n}', {e}" for n, e in step.items())})"))
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.get(out, F.lit(0))["out"])
    return F.when(F.isnan(x) | (size >= 1e15), number_text(x)).otherwise(text)


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def record_hash(text: Column) -> Column:
    """Hash of the whole record, signature included."""
    return sha256_hex(canonicalise(text))


def core_hash(text: Column) -> Column:
    """Hash of the record without its signature."""
    return sha256_hex(prune_key(text, "signature"))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    """Bytes of an even number of hex digits; anything else is an error."""
    good = (F.length(text) % 2 == 0) & ~text.rlike("[^0-9a-fA-F]")
    return F.when(text.isNull() | good, F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("not hex: "), text)).cast("binary"))


def to_base64url(data: Column) -> Column:
    return F.translate(F.base64(data), "+/=\r\n", "-_")


def from_base64url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.length(plain) + F.pmod(-F.length(plain), F.lit(4))).cast("int"), "="))


def key_fingerprint(curve: Column, x: Column, y: Column) -> Column:
    return F.substring(sha256_hex(F.concat_ws(".", curve, x, y)), 1, 32)


@F.pandas_udf(StructType([StructField("canonical", StringType()), StructField("core", StringType())]))
def _both_udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for t in texts:
        yield pd.DataFrame({"canonical": t.map(lambda x: None if x is None else canonical_text(x)), "core": t.map(lambda x: None if x is None else pruned_text(x, "signature"))})


def sound_text(text: Column) -> Column:
    """The text where it is one JSON object, else null: a key given twice, text after its end and the like make it none."""
    value = F.try_parse_json(text)
    return F.when(F.substring(F.schema_of_variant(value), 1, 6) == "OBJECT", text)


def with_hashes(records: DataFrame, text: str = "record_json", core_text: str = "") -> DataFrame:
    """Add record_hash and core_hash, of the canonical record and core texts; the texts themselves are not carried, but for the
    core's where a name for it is given. Texts with odd numbers go through one helper for both. A text that is no JSON object has nulls."""
    done = records.withColumn("ch_text", sound_text(F.col(text)))  # columns of their own, as each is used several times
    done = done.withColumn("ch_strange", _strange(F.col("ch_text")))
    own, strange = F.col("ch_text"), F.col("ch_strange")
    entries = F.map_filter(F.from_json(own, "map<string,variant>"), lambda k, _: k != "signature")
    done = done.withColumn("ch_both", _both_udf(F.when(strange, own)))
    whole = F.when(strange, F.col("ch_both.canonical")).otherwise(F.to_json(F.parse_json(own)))
    core = F.when(strange, F.col("ch_both.core")).otherwise(F.to_json(F.parse_json(F.to_json(entries))))
    done = done.withColumn("ch_core", core).withColumns({"record_hash": sha256_hex(whole), "core_hash": sha256_hex(F.col("ch_core"))})
    done = done.drop("ch_text", "ch_strange", "ch_both")
    return done.withColumnRenamed("ch_core", core_text) if core_text else done.drop("ch_core")
