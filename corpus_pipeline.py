"""The corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), ``docs`` having the columns of
``documents``, and works on all that the stage before kept; all but the last
return these columns. Between stages the documents are written as Parquet in the
shared folder and read again, and each table goes once the next is written.

In every stage rows without an id, null and empty texts and columns of any name
are allowed, rows that repeat an id are judged each by its own text, and an empty
table gives an empty one (the last stage: no piece).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fractus.llm.decontamination import contamination
from fractus.llm.line_dedup import dedup_lines
from fractus.llm.ngram_join import near_copies
from fractus.llm.packing import pack
from fractus.llm.storage import discard, materialize, small, table, unused
from fractus.llm.toxicity import toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that operator 5 predicts toxic, by their whole texts; null and empty ones have the score of no words."""
    return toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*docs.columns)


def dedup_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later occurrences of repeated lines (operator 9); n_chars follows the text.

    A document of which nothing but white space is left goes, as all of it stands
    in others; documents that were null or empty before stay as they are.
    """
    out = dedup_lines(docs)
    changed = F.col("n_removed") > 0
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    # As a generator: Spark would push a filter below the lines and split each text anew for every line.
    left = F.when(~changed | (F.btrim("text", F.lit(" \n")) != ""), F.array(F.struct("text", n_chars.alias("n_chars"))))
    return out.select(*(c for c in docs.columns if c not in ("text", "n_chars")), F.inline(left)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of operator 1 keep one document, that of the smallest id.

    Rows that repeat an id are texts of their own. Of rows that repeat id and
    text one stays. Rows without an id, and texts without words, are in no
    component and stay.
    """
    doc_id, th, copies, keep = unused(docs, "id", "th", "copies", "keep")
    marked = materialize(near_copies(docs), "near-copies").toDF(doc_id, th, copies, keep)
    same = (F.col("doc_id").cast("long") == F.col(doc_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(th))
    kept = docs.join(small(marked), same, "left_anti")
    repeated = marked.where(keep)
    if not repeated.isEmpty():
        one = docs.join(small(repeated), same).dropDuplicates([doc_id, th])
        kept = kept.select(*docs.columns).unionByName(one.select(*docs.columns))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs (operator 10); texts without words have none."""
    return contamination(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens (operator 4); a null or empty text is its end id alone."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The learnt and packing stages can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
