"""A corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns the columns of
``documents``; the last returns the packed pieces. Rows are kept as they are unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm import decontaminate, languages, lines, packing, similar
from capturelake.llm.text import quoted, read, released, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts of which no learned language makes up a third."""
    return languages.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of repeated three-line windows; a text of which nothing stays goes. ``n_chars`` follows."""
    done = lines.dedup_lines(docs).filter("ld_removed = 0 or length(trim(ld_kept)) > 0")
    new = {"text": F.col("ld_kept"), "n_chars": F.when(F.col("ld_removed") > 0, F.length("ld_kept")).otherwise(F.col("n_chars"))}
    kinds = dict(docs.dtypes)
    return done.select(*(new[c].cast(kinds[c]).alias(c) if c in new else F.col(quoted(c)) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each class of linked texts."""
    return similar.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that overlap a benchmark item."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]
#: Language inference and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            released(before)
    return STAGES[-1][1](spark, docs, sf_dir)
