"""Line dedup: overlapping windows of three lines, repeated anywhere in the corpus, lose their later occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.text import identified

WIDTH = 3


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(ld_key, ld_text, ld_at, ld_a, ld_b): each window's document, place and 128-bit hash."""
    lines = F.split("ld_body", "\n", -1)
    hashed = F.when(
        F.size("ld_lines") >= width,
        F.transform(
            F.sequence(F.lit(1), F.size("ld_lines") - (width - 1)),
            lambda i: F.struct(
                F.xxhash64(F.array_join(F.slice("ld_lines", i, width), "\n")).alias("a"),
                F.xxhash64(F.lit(1), F.array_join(F.slice("ld_lines", i, width), "\n")).alias("b"),
            ),
        ),
    )
    found = docs.withColumn("ld_lines", lines).select("ld_key", "ld_text", F.posexplode(hashed).alias("ld_at", "w"))
    return found.select("ld_key", "ld_text", "ld_at", F.col("w.a").alias("ld_a"), F.col("w.b").alias("ld_b"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with columns ld_n (lines), ld_removed (lines removed) and ld_kept (the text that stays).

    A window is ``width`` consecutive lines (cut at line feeds) of one text; its first occurrence is that with the
    smallest (key, place), texts that share a key coming one after the other by their hashes. Every line that a later occurrence covers goes; overlapping windows merge, and windows are
    judged on the input. Null texts count as empty, but stay null when nothing is removed. Texts with fewer lines than
    ``width`` are left alone. Rows that repeat a key and text are one document and share its result; a null key sorts
    before all others. Groups of equal windows are reduced before they are shuffled, so a line that every document has
    costs one row a task. A column of a name that is
    added is replaced.
    """
    named = identified(docs, key, text, "ld_n", "ld_removed", "ld_kept").select(
        "id_row", F.col("id_a").alias("ld_key"), F.col("id_b").alias("ld_text"), F.coalesce("id_text", F.lit("")).alias("ld_body"), F.col("id_text").isNull().alias("ld_null")
    )
    windows = _windows(named.select("ld_key", "ld_text", "ld_body"), width)
    first = (
        windows.groupBy("ld_a", "ld_b").agg(F.min(F.struct("ld_key", "ld_text", "ld_at")).alias("ld_first"), F.count("*").alias("ld_count"))
        .filter("ld_count > 1").select("ld_a", "ld_b", "ld_first")
    )
    later = windows.join(first, ["ld_a", "ld_b"]).filter("ld_key != ld_first.ld_key or ld_text != ld_first.ld_text or ld_at != ld_first.ld_at")
    places = later.groupBy("ld_key", "ld_text").agg(F.collect_set("ld_at").alias("ld_places"))
    covered = F.array_distinct(F.flatten(F.transform("ld_places", lambda p: F.sequence(p + 1, p + width))))
    stay = F.array_except(F.sequence(F.lit(1), F.size("ld_lines")), "ld_covered")
    return (
        named.join(places, ["ld_key", "ld_text"], "left")
        .withColumn("ld_lines", F.split("ld_body", "\n", -1))
        .withColumn("ld_covered", covered)
        .withColumn("ld_stay", F.when(F.col("ld_covered").isNotNull(), stay))
        .select(
            "id_row.*", F.size("ld_lines").cast("long").alias("ld_n"),
            F.coalesce(F.size("ld_covered"), F.lit(0)).cast("long").alias("ld_removed"),
            F.when(F.col("ld_covered").isNull(), F.when(~F.col("ld_null"), F.col("ld_body")))
            .otherwise(F.array_join(F.transform("ld_stay", lambda i: F.element_at("ld_lines", i)), "\n")).alias("ld_kept"),
        )
    )


def line_digests(done: DataFrame, key: str = "doc_id") -> DataFrame:
    return done.select(
        key, F.col("ld_n").alias("n_lines"), F.col("ld_removed").alias("n_removed"),
        F.sha2(F.coalesce("ld_kept", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = """
with lines as (
    select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), windows as (
    select doc_id, pos, line || chr(10) || lead(line, 1) over w || chr(10) || lead(line, 2) over w as body
    from lines window w as (partition by doc_id order by pos)
), ranked as (
    select doc_id, pos, row_number() over (partition by body order by doc_id, pos) as nth from windows where body is not null
), gone as (
    select distinct doc_id, pos + step as pos from ranked, (values (0), (1), (2)) as s(step) where nth > 1
)
select l.doc_id, count(*) as n_lines, count(g.pos) as n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '')) as kept_sha256
from lines l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id
"""
