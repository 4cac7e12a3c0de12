"""Benchmark passages in training texts (operator 10), with DataFrame functions only.

A positional inverted index of the training words is built for the terms that
decide: of each benchmark window the ``rarest`` distinct terms by their counts
in the corpus. Candidate places are the postings of a window's rarest term,
shifted by the term's offset in the window, and are intersected with the shifted
lists of its next rarest terms. What remains is compared with the window word by
word, as a hash of the whole phrase in the text. Postings name a row by a hash of
its id and text: rows may share an id, and the comparison is with their own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, fits, materialize, small, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: every ASCII character but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in order, A to Z lower-cased; empty for a null text. Other letters keep their case."""
    text = F.coalesce(text, F.lit(""))
    # lower() has a fast path for ASCII, where it does the same.
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def phrase_hash(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows: key, len, words and the ids of the items that have them.

    An item of fewer than ``size`` words, but not none, is one window.
    """
    split = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    each = split.select("item", "w", starts.alias("s")).select("item", F.slice("w", F.col("s"), F.lit(size)).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).select(phrase_hash(F.col("words")).alias("key"), F.size("words").alias("len"), "words", "items")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences of each of ``terms`` in all texts; terms that never occur have no row."""
    found = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    if fits(terms):
        return found.join(F.broadcast(terms), "term").groupBy("term").count()
    return found.groupBy("term").count().join(terms, "term")  # a frequent word is one row of each task


def rarest_terms(windows: DataFrame, counts: DataFrame, rarest: int, partly: bool = False) -> DataFrame:
    """For each window the array ``anchors`` of (count, term, offset), rarest first.

    A window with a term that never occurs can't occur either and is left out,
    unless windows may occur ``partly``.
    """
    terms = windows.select("key", "len", F.posexplode("words").alias("off", "term"))
    terms = terms.groupBy("key", "len", "term").agg(F.min("off").alias("off"))
    joined = terms.join(counts, "term", "left")
    anchor = F.when(F.col("count").isNotNull(), F.struct(F.col("count"), "term", "off"))
    known = joined.groupBy("key", "len").agg(F.count_if(F.col("count").isNull()).alias("absent"), F.sort_array(F.collect_list(anchor)).alias("anchors"))
    known = known.where("size(anchors) > 0" if partly else "absent = 0")
    return known.select("key", "len", F.slice("anchors", 1, rarest).alias("anchors"))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of both, which names a row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.withColumn("row", F.xxhash64("doc_id", "text"))


def positional_index(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, row, pos) of ``terms``, pos counting words from 0; written to the shared folder."""
    postings = rows.select("row", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return materialize(postings.join(small(terms), "term").select("term", "row", "pos"), "postings")


def intersect(index: DataFrame, windows: DataFrame, rarest: int, slop: int = 0) -> DataFrame:
    """Places (row, start, key, len) where the anchors of a window stand at their offsets.

    The list of the rarest term is shifted by its offset; each further list is
    joined by row and term and must have a posting at the shifted place, or with
    ``slop`` at most that many words from it. Rows never exceed the postings of
    the rarest terms.
    """
    first = windows.select("key", "len", "anchors", F.col("anchors")[0]["term"].alias("term"), F.col("anchors")[0]["off"].alias("off"))
    places = index.join(small(first), "term").select("row", (F.col("pos") - F.col("off")).alias("start"), "key", "len", "anchors")
    if not slop:
        places = places.where("start >= 0")
    for k in range(1, rarest):
        anchor = F.get("anchors", F.lit(k))
        wanted = places.withColumns({"w_term": anchor["term"], "w_pos": F.col("start") + anchor["off"]})
        single, more = wanted.where(F.col("w_term").isNull()), wanted.where(F.col("w_term").isNotNull())
        other = index.select(F.col("row").alias("o_row"), F.col("term").alias("o_term"), F.col("pos").alias("o_pos"))
        same = (F.col("row") == F.col("o_row")) & (F.col("w_term") == F.col("o_term"))
        near = F.col("w_pos") == F.col("o_pos") if not slop else F.abs(F.col("w_pos") - F.col("o_pos")) <= slop
        places = more.join(other, same & near, "left_semi").unionByName(single).select("row", "start", "key", "len", "anchors")
    return places.select("row", "start", "key", "len").distinct()


def _prepared(rows: DataFrame, items: DataFrame, size: int, rarest: int, partly: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    windows = materialize(benchmark_windows(items, size), "bench-windows")
    counts = materialize(term_counts(rows, windows.select(F.explode("words").alias("term")).distinct()), "term-counts")
    anchored = materialize(rarest_terms(windows, counts, rarest, partly), "bench-anchors")
    index = positional_index(rows, anchored.select(F.explode("anchors.term").alias("term")).distinct())
    return windows, counts, anchored, index


def proximity_matches(docs: DataFrame, items: DataFrame, size: int = 10, rarest: int = 3, slop: int = 2) -> DataFrame:
    """Distinct (doc_id, item_id, start) where all words of a window that occur in ``docs`` stand within ``slop`` words of their places.

    ``start`` is where the window would begin by the place of its rarest word, so
    it may be negative. Words that no text has are passed over, but a window has
    at least one that some text has. Null texts have no words; item_id is a string.
    """
    rows = _rows(docs)
    windows, counts, anchored, index = _prepared(rows, items, size, rarest, partly=True)
    places = materialize(intersect(index, anchored, rarest, slop), "places")
    words = windows.select("key", F.posexplode("words").alias("j", "term")).join(counts.select("term"), "term", "left_semi")
    words = words.groupBy("key").agg(F.collect_list(F.struct("j", "term")).alias("known"))
    met = places.join(small(words), "key").join(rows.distinct(), "row").withColumn("w", words_of(F.col("text")))
    low = lambda x: F.greatest(F.col("start") + x["j"] - slop, F.lit(0))
    around = lambda x: F.slice("w", low(x) + 1, F.greatest(F.col("start") + x["j"] + slop + 1 - low(x), F.lit(0)))
    met = met.where(F.forall("known", lambda x: F.array_contains(around(x), x["term"])))
    return met.select("doc_id", "start", "key").join(small(windows.select("key", "items")), "key").select("doc_id", F.explode("items").alias("item_id"), "start").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, rarest: int = 3) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), items_sha256 (string), contaminated (boolean) and ``hits``.

    ``hits`` is the array of (start, len, key) of exact matches, start counting
    words from 0. Null and empty texts have no words and no hits, null and empty
    items no windows; an item without an id hits but isn't counted. Rows that
    repeat an id, or have none, are checked each against its own text. Columns of
    these names are replaced; all others are carried along, whatever their names.
    Tables may be empty.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits")
    rows = _rows(docs)
    windows, counts, anchored, index = _prepared(rows, items, size, rarest)
    places = intersect(index, anchored, rarest).groupBy("row").agg(F.collect_list(F.struct("start", "len", "key")).alias("places"))
    places = materialize(places, "candidates")
    discard(index, anchored, counts)
    # Candidates against the words of their own texts.
    met = rows.join(small(places), "row").withColumn("w", words_of(F.col("text")))
    met = met.withColumn("hits", F.array_sort(F.filter("places", lambda c: phrase_hash(F.slice("w", c["start"] + 1, c["len"])) == c["key"])))
    met = materialize(met.where("size(hits) > 0").dropDuplicates(["row", "doc_id"]).select("row", "doc_id", "hits"), "contaminated")
    found = met.select("row", "doc_id", F.explode(F.array_distinct("hits.key")).alias("key")).join(small(windows.select("key", "items")), "key")
    found = found.select("row", "doc_id", F.explode("items").alias("item")).groupBy("row", "doc_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = found.select(F.col("row").alias("r"), F.col("doc_id").alias("d"), "items")
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda acc, c: F.struct((acc["n"] + F.greatest(F.lit(0), c["start"] + c["len"] - F.greatest(acc["e"], c["start"]))).alias("n"), F.greatest(acc["e"], c["start"] + c["len"]).alias("e")),
        lambda acc: acc["n"],
    )
    met = met.join(found, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    row, doc, hits, n, ids = unused(docs, "row", "of", "at", "n", "ids")
    met = materialize(met.select(F.col("row").alias(row), F.col("doc_id").alias(doc), F.col("hits").alias(hits), covered.cast("long").alias(n), F.coalesce("items", F.array().cast("array<string>")).alias(ids)), "hits")
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    joined = docs.join(small(met), (F.xxhash64(doc_id, text) == F.col(row)) & doc_id.eqNullSafe(F.col(doc)), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *(joined[f"`{c}`"] for c in docs.columns),
        F.size(words_of(text)).cast("long").alias("n_words"),
        F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size(F.coalesce(ids, none)), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce(ids, none), ","), 256).alias("items_sha256"),
        F.col(n).isNotNull().alias("contaminated"),
        F.coalesce(F.col(hits), F.array().cast(met.schema[hits].dataType)).alias("hits"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM win
), dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(s)
), hit AS (
  SELECT dw.doc_id, dw.n, dw.s, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
