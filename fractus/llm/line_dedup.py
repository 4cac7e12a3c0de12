"""Removal of repeated runs of lines (operator 9), with DataFrame functions only.

A text is folded into lines where its own words say so: a line ends with a
newline, or with a marked word (eight characters or more, or the end of a
sentence) behind two words that aren't marked. Three words decide, wherever the
line began, so a passage has the same lines in any text that it is set into, but
for the words before its first end. Every window of three consecutive lines is
hashed; a window that occurs more than once anywhere in the table is repeated.
Its first occurrence, by (doc_id, text, line number), stays; all lines that lie
in later occurrences go. ``ORACLE_SQL`` defines the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, unused

#: Words that aren't marked, words that are, and a line with the white space that ends it; the matches add up to the text.
PLAIN, MARKED = r"[^ \n]{0,6}[^ \n.!?]", r"(?:[^ \n]{8,}|[^ \n]*[.!?])"
LINE = rf" *(?:[^\n]*? )??{PLAIN} +{PLAIN} +{MARKED}(?: +|\n+|\z)| *[^\n]*(?:\n+|\z)"
#: Covered positions that may be broadcast (about 8 bytes each); more are joined by a shuffle.
BROADCAST_POSITIONS = 4_000_000
#: What names a row: its id and its text, as rows may share an id or lack one.
ROW = ("doc_id", "th")


def lines_of(text: Column) -> Column:
    """Array of lines, white space included; empty for a null or empty text."""
    return F.array_remove(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LINE), F.lit(0)), "")


def windows(docs: DataFrame) -> DataFrame:
    """Rows (k1, k2, doc_id, th, i): a 96-bit key of the lines i, i + 1 and i + 2."""
    hashed = docs.select(*ROW, F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(F.btrim(x, F.lit(" \n")))).alias("h"))
    at = F.posexplode(F.slice("h", F.lit(1), F.greatest(F.size("h") - 2, F.lit(0))))
    rows = hashed.select(*ROW, "h", at.alias("i", "a")).select(*ROW, "i", "a", F.get("h", F.col("i") + 1).alias("b"), F.get("h", F.col("i") + 2).alias("c"))
    return rows.select(F.xxhash64("a", "b", "c").alias("k1"), F.hash("a", "b", "c").alias("k2"), *ROW, "i")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` freed of repeated lines, and n_lines and n_removed (long).

    A null text stays null and an empty one empty, both with no lines; a text of
    fewer than three lines has no window and stays as it is. Within one text
    later occurrences go too. Rows that repeat an id with another text are cut
    each by its own text; rows that repeat both (ids may be null) count as one,
    so that none of them loses its text to another. A text that repeats others
    wholly becomes empty; its row stays. Columns named n_lines and n_removed are
    replaced; all other columns are carried along, whatever their names.
    """
    if docs.isEmpty():
        zero = F.lit(0).cast("long")
        return docs.withColumns({"n_lines": zero, "n_removed": zero})
    docs = docs.drop("n_lines", "n_removed")
    doc_id, digest = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    seen = materialize(windows(docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("th"))), "line-windows")
    # Counts and first places combine within each task before the shuffle, so a hot window is one row a task.
    # They are written: of a join of two shuffled tables Spark splits the partitions that hot windows fill.
    repeated = seen.groupBy("k1", "k2").agg(F.min(F.struct(*ROW, "i")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = materialize(repeated, "line-repeated")
    later = seen.join(repeated, ["k1", "k2"]).where(~F.struct(*ROW, "i").eqNullSafe(F.col("first")))
    covered = materialize(later.groupBy(*ROW).agg(F.collect_set("i").alias("at")), "line-covered")
    size = covered.agg(F.coalesce(F.sum(F.size("at") + 6), F.lit(0))).first()[0]
    of, th, at, lines = unused(docs, "of", "th", "at", "lines")
    covered = covered.toDF(of, th, at)
    if size <= BROADCAST_POSITIONS:
        covered = F.broadcast(covered)
    joined = docs.join(covered, doc_id.eqNullSafe(F.col(of)) & (digest == F.col(th)), "left").withColumn(lines, lines_of(F.col("text").cast("string")))
    gone = F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda j: F.get(lines, j)), ""))
    n = F.size(lines).cast("long")
    left = F.when(F.col(at).isNull(), n).otherwise(F.size(kept).cast("long"))
    return joined.withColumns({"text": text, "n_lines": n, "n_removed": n - left}).drop(lines, of, th, at)


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, text, list_filter(regexp_extract_all(coalesce(text, ''), '{line}'), lambda x: x <> '') AS a FROM documents
), w AS (
  SELECT doc_id, i, trim(a[i], ' ' || chr(10)) || chr(10) || trim(a[i + 1], ' ' || chr(10)) || chr(10) || trim(a[i + 2], ' ' || chr(10)) AS k
  FROM l, unnest(range(1, len(a) - 1)) AS u(i)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM w) WHERE nth > 1
), c AS (
  SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(a) AS BIGINT) AS n_lines, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  CASE WHEN js IS NULL THEN text ELSE array_to_string(list_filter(a, lambda x, j: NOT list_contains(js, j)), '') END AS text
FROM l LEFT JOIN c USING (doc_id)
""".format(line=LINE)
