"""Exact self-join on the Jaccard similarity of word n-grams (operator 1), by vertical partitioning.

1. Filter. In the order of the hashes, two texts that link share a number of
   n-grams among the first ones of each. Only these prefixes are shuffled, once
   combined within each task; a text whose prefix shares too few n-grams with any
   other text can't link and is settled.
2. Texts with equal sets become one representative, numbered in the order of the
   smallest ids.
3. Order. The representatives' n-grams are ordered by frequency (rarest first);
   n-grams of one representative alone are dropped. The order is cut into
   fragments, each twice as frequent as the one before.
4. Pairs. A pair that links shares an n-gram of both prefixes in this order. For
   each n-gram there, all its texts are first compared with one central text; the
   links give components. Only pairs that then lie in different components are
   compared too: those of short lists as pairs, those of long lists in blocks of
   texts. Every comparison counts partial overlaps in each fragment separately
   and sums them for each pair.
5. Components of the links give each text its class.

All n-grams of all texts count and every pair above the threshold within
different components is compared, so no link between components is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import star_components
from .batches import bounded, slices
from .shingles import shingle_sets
from .storage import discard, materialize, partitions

#: Postings that a task combines before it sends them (17 bytes each).
HELD = 1_000_000
#: Survivors that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text for each bucket of step 1, whose postings take about as many: one bucket is counted at once.
BUCKET_BYTES = 32 << 20
#: Lists up to this length are compared as pairs, longer ones in blocks.
SHORT_LIST = 48
#: Texts on either side of a block: bounds a task's memory.
BLOCK_PROBES, BLOCK_TEXTS = 256, 1024


def least_common(n: Column | int, percent: int) -> Column | int:
    """Least intersection of a set of n with any set that it links with: ceil(n * percent / 100)."""
    if isinstance(n, Column):
        return F.ceil(n * percent / F.lit(100.0)).cast("long")
    return -(-n * percent // 100)


def _shared_needed(n: int) -> int:
    """N-grams that two texts must share in their extended prefixes (the smaller text's number holds)."""
    return max(1, -(-n // 8))


# --- 1. texts that may link ---------------------------------------------------


def _prefix_rows(size: int, percent: int, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        ids: list[int] = []
        ns: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            h = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[new, len(h)])
            many = counts > 1  # settled here; one posting without a text stands for all
            local = np.bincount(d[np.repeat(many, counts)], minlength=len(ids)).astype(np.int64)
            h, given = h[new], np.array(ids, np.int64)
            d = given[d[new]] if len(ids) else d[new]
            bucket = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            at = [(b, order[lo:hi]) for b, lo, hi in zip(range(buckets), cuts[:-1], cuts[1:]) if hi > lo]
            out = {"bucket": [b for b, _ in at], "hashes": [h[i].tobytes() for _, i in at], "docs": [d[i].tobytes() for _, i in at], "many": [many[i].tobytes() for _, i in at], "ns": [None] * len(at)}
            if ids:
                for k, v in (("bucket", (ids[0] * 7919 + len(ids)) % buckets), ("hashes", local.tobytes()), ("docs", given.tobytes()), ("many", None), ("ns", np.array(ns, np.int64).tobytes())):
                    out[k].append(v)
            for x in (keys, docs, ids, ns):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("hashes", "docs", "many", "ns"))], ["bucket", "hashes", "docs", "many", "ns"])

        for some in slices(batches, 1):
            for doc, grams in zip(some.column(0).to_pylist(), shingle_sets(some.column(1), size)):
                n = len(grams)
                prefix = min(n, n - least_common(n, percent) + _shared_needed(n)) if n else 0
                keys.append(grams[:prefix])
                docs.append(np.full(prefix, len(ids), np.int64))
                ids.append(doc)
                ns.append(n)
                held += prefix
                if held >= HELD:
                    yield flush()
        if ids:
            yield flush()

    return rows


def _count_shared(table: pa.Table) -> pa.Table:
    """One bucket of n-grams: for each text how many of its postings another text has too."""
    h, d, m, ids, ns, shared = [], [], [], [], [], []
    for hashes, docs, many, n in zip(*(table.column(k).to_pylist() for k in ("hashes", "docs", "many", "ns"))):
        if n is None:
            h.append(np.frombuffer(hashes, np.uint64))
            d.append(np.frombuffer(docs, np.int64))
            m.append(np.frombuffer(many, bool))
        else:
            ids.append(np.frombuffer(docs, np.int64))
            ns.append(np.frombuffer(n, np.int64))
            shared.append(np.frombuffer(hashes, np.int64))
    out_ids, out_ns, out_shared = [pa.array([], pa.int64())], [pa.array([], pa.int64())], [pa.array([], pa.int64())]
    for i, n, s in zip(ids, ns, shared):
        out_ids.append(pa.array(i))
        out_ns.append(pa.array(n))
        out_shared.append(pa.array(s))
    if h:
        h, d, m = np.concatenate(h), np.concatenate(d), np.concatenate(m)
        order = np.argsort(h, kind="stable")
        h, d, m = h[order], d[order], m[order]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        counts = np.diff(np.r_[new, len(h)])
        alone = (counts == 1) & ~m[new]
        mine = d[~np.repeat(alone, counts) & ~m]
        found, times = np.unique(mine, return_counts=True)
        out_ids.append(pa.array(found))
        out_ns.append(pa.nulls(len(found), pa.int64()))
        out_shared.append(pa.array(times.astype(np.int64)))
    return pa.table([pa.concat_arrays(out_ids), pa.concat_arrays(out_ns), pa.concat_arrays(out_shared)], ["doc_id", "n", "shared"])


def sizes_and_survivors(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (doc_id, n, may_link), one for each row of ``docs``."""
    measured = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(4 * partitions(docs.sparkSession), -(-measured // BUCKET_BYTES))
    sent = bounded(docs).mapInArrow(_prefix_rows(size, percent, buckets), "bucket int, hashes binary, docs binary, many binary, ns binary")
    counted = sent.groupBy("bucket").applyInArrow(_count_shared, "doc_id long, n long, shared long")
    by_id = counted.groupBy("doc_id").agg(F.sum("shared").alias("shared"), F.collect_list("n").alias("ns"))
    rows = by_id.select("doc_id", F.explode("ns").alias("n"), "shared")
    # The partner may be smaller: its number of n-grams to share holds then.
    needed = F.greatest(F.lit(1), F.ceil(least_common(F.col("n"), percent) / F.lit(8.0)))
    return rows.select("doc_id", "n", ((F.col("n") > 0) & (F.col("shared") >= needed)).alias("may_link"))


# --- 2. representatives -------------------------------------------------------


SETS = "doc_id long, th long, n long, digest binary, grams array<long>"


def _sets(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1):
            sets = list(shingle_sets(some.column(1), size))
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32))
            values = pa.array((np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64))
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "th", "n", "digest", "grams"])

    return rows


# --- 4. partial overlaps ------------------------------------------------------


def _partial(table: pa.Table) -> pa.Table:
    """One block and one fragment of the order: numbers of n-grams that probes share with texts there, packed."""
    block = table.column("block")[0].as_py()
    probe = np.array(table.column("probe").to_pylist(), bool)
    ids, ns = table.column("rep").to_numpy(), table.column("n").to_numpy()
    grams = table.column("grams").combine_chunks()
    grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
    lengths = np.diff(grams.offsets.to_numpy())
    values, owner = grams.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lengths)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    left, right = np.flatnonzero(probe), np.flatnonzero(~probe)
    place = np.zeros(len(ids), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    total = np.zeros((len(left), len(right)), np.int32)
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if hi - lo > 1:
            those = owner[lo:hi]
            mine = probe[those]
            if mine.any() and not mine.all():
                total[np.ix_(place[those[mine]], place[those[~mine]])] += 1
    a, b = np.nonzero(total)
    packed = np.empty((len(a), 5), np.int64)
    packed[:, 0], packed[:, 1], packed[:, 2], packed[:, 3], packed[:, 4] = ids[left[a]], ids[right[b]], ns[left[a]], ns[right[b]], total[a, b]
    return pa.table([pa.array([block], pa.int64()), pa.array([packed.tobytes()], pa.binary())], ["block", "packed"])


def _summed(percent: int):
    def links(table: pa.Table) -> pa.Table:
        """One block: partial overlaps summed for each pair, and the pairs that reach the threshold."""
        parts = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 5) for x in table.column("packed").to_pylist()])
        if len(parts):
            order = np.lexsort((parts[:, 1], parts[:, 0]))
            parts = parts[order]
            new = np.flatnonzero(np.r_[True, (parts[1:, :2] != parts[:-1, :2]).any(1)])
            common = np.add.reduceat(parts[:, 4], new)
            parts = parts[new]
            parts = parts[100 * common >= percent * (parts[:, 2] + parts[:, 3] - common)]
        return pa.table([pa.array(parts[:, 0]), pa.array(parts[:, 1])], ["a", "b"])

    return links


def compare(members: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the probes and the texts of each block.

    ``members``: (block, probe, rep); ``fragments``: (rep, n, fragment, grams).
    """
    laid = members.join(fragments, "rep")
    partial = laid.groupBy("block", "fragment").applyInArrow(_partial, "block long, packed binary")
    return partial.groupBy("block").applyInArrow(_summed(percent), "a long, b long")


def _block(*columns: Column) -> Column:
    return F.xxhash64(*columns)


# --- the operator -------------------------------------------------------------


def _classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n) that link with nothing, and rows (doc_id, th, n, rep, label, component) of all others.

    Together one row for each of ``docs`` (doc_id, text), of which none lacks an
    id. ``th`` is a hash of the text, ``label`` the smallest representative that
    ``rep`` reaches, and component the smallest id of its texts.
    """
    sizes = materialize(sizes_and_survivors(docs, size, percent), "ngram-sizes")
    survivors = sizes.where("may_link").select("doc_id").distinct()
    few = sizes.where("may_link").count() <= BROADCAST_IDS
    survivors = F.broadcast(survivors) if few else survivors
    kept = docs.join(survivors, "doc_id", "left_semi").select("doc_id", "text", F.xxhash64("text").alias("th"))
    sets = materialize(kept.mapInArrow(_sets(size), SETS).where("n > 0"), "ngram-sets")
    alone = sizes.where("n = 0").unionByName(sizes.where("n > 0").join(survivors, "doc_id", "left_anti").select(*sizes.columns))

    # Representatives are numbered in the order of their smallest ids: the smallest of a class has the smallest id.
    names = sets.groupBy("digest").agg(F.min("doc_id").alias("least")).orderBy("least", "digest")
    names = materialize(names.withColumn("rep", F.monotonically_increasing_id()), "ngram-names")
    reps = sets.groupBy("digest").agg(F.first("n").alias("n"), F.first("grams").alias("grams")).join(names, "digest")

    # The order of all n-grams that two representatives have: by frequency, then by hash.
    postings = materialize(reps.select("rep", "n", F.explode("grams").alias("gram")), "ngram-postings")
    frequency = postings.groupBy("gram").count().where("count > 1").withColumnRenamed("count", "df")
    ordered = postings.join(frequency, "gram").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    own_grams = F.col("n") - F.size("grams")
    prefix = (F.col("n") - least_common(F.col("n"), percent) + 1 - own_grams).cast("int")
    ordered = materialize(ordered.withColumns({"rare": own_grams / F.col("n"), "prefix": prefix}).where("prefix > 0"), "ngram-ordered")
    discard(postings)
    each = ordered.select("rep", "n", F.explode("grams").alias("g"))
    fragments = each.groupBy("rep", "n", F.floor(F.log2(F.col("g.df"))).cast("int").alias("fragment")).agg(F.collect_list("g.gram").alias("grams"))
    fragments = materialize(fragments, "ngram-fragments")

    # Each list's texts against its central one: the text with the smallest part of n-grams of its own.
    lists = ordered.select("rep", "n", "rare", F.explode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("g")).select("rep", "n", "rare", F.col("g.gram").alias("gram"))
    heads = lists.groupBy("gram").agg(F.min(F.struct("rare", "rep", "n")).alias("hub"), F.count("*").alias("length")).where("length > 1")
    lists = materialize(lists.join(heads, "gram").select("gram", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"), "length"), "ngram-lists")
    discard(ordered)
    alike = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    rays = lists.where(F.col("rep") != F.col("hub")).where(alike(F.col("n"), F.col("hub_n"))).select("hub", "rep").distinct()
    links = materialize(compare(_around(rays, "hub", "rep"), fragments, percent), "ngram-links")
    labels = star_components(links)

    # Pairs of one list that lie in different components still.
    named = lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_lists = named.groupBy("gram").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("gram")
    still = materialize(named.join(open_lists, "gram", "left_semi"), "ngram-open")
    discard(lists)
    short = still.where(F.col("length") <= SHORT_LIST).select("gram", "rep", "n", "label", "hub")
    other = short.select("gram", *(F.col(c).alias(f"o_{c}") for c in ("rep", "n", "label")))
    pairs = short.join(other, "gram").where((F.col("rep") < F.col("o_rep")) & (F.col("label") != F.col("o_label")) & (F.col("rep") != F.col("hub")) & (F.col("o_rep") != F.col("hub")))
    pairs = pairs.where(alike(F.col("n"), F.col("o_n"))).select("rep", "o_rep").distinct()
    long = still.where(F.col("length") > SHORT_LIST).select("hub", "rep", "label").distinct()
    home = long.where(F.col("rep") == F.col("hub")).select("hub", F.col("label").alias("home")).distinct()
    long = long.join(home, "hub", "left").withColumn("probe", ~F.col("label").eqNullSafe(F.col("home")))
    counts = long.groupBy("hub").agg(F.ceil(F.count_if("probe") / F.lit(BLOCK_PROBES)).cast("int").alias("rows"), F.ceil(F.count("*") / F.lit(BLOCK_TEXTS)).cast("int").alias("cols"))
    long = long.join(counts.where("rows > 0"), "hub")
    spread = lambda n: F.pmod(F.hash("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block_probes = long.where("probe").select("hub", spread("rows").alias("r"), every("cols").alias("c"), "rep").select(_block("hub", "r", "c").alias("block"), F.lit(True).alias("probe"), "rep")
    block_texts = long.select("hub", every("rows").alias("r"), spread("cols").alias("c"), "rep").select(_block("hub", "r", "c").alias("block"), F.lit(False).alias("probe"), "rep")
    members = _around(pairs, "rep", "o_rep").unionByName(block_probes).unionByName(block_texts)
    rest = compare(members, fragments, percent).where("a <> b")
    all_links = materialize(links.unionByName(rest), "ngram-links")
    discard(links, still, fragments)
    labels = star_components(all_links)

    # Back to all texts.
    smallest = names.select(F.col("rep").alias("label"), F.col("least").alias("component"))
    groups = names.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "rep", F.coalesce("label", "rep").alias("label")).join(smallest, "label")
    return alone, sets.select("doc_id", "th", "n", "digest").join(groups, "digest").drop("digest")


def _around(rays: DataFrame, centre: str, other: str) -> DataFrame:
    """Members (block, probe, rep) of blocks of one text, the centre, with at most about ``BLOCK_TEXTS`` others each."""
    count = rays.groupBy(centre).agg(F.count("*").alias("rays"))
    salt = F.pmod(F.hash(other), F.lit(1 << 16)) % F.greatest(F.lit(1), F.ceil(F.col("rays") / F.lit(BLOCK_TEXTS)))
    salted = rays.join(count, centre).select(F.col(centre).alias("centre"), F.col(other).alias("rep"), salt.alias("salt"))
    texts = salted.select(_block("centre", "salt").alias("block"), F.lit(False).alias("probe"), "rep")
    return texts.unionByName(salted.select("centre", "salt").distinct().select(_block("centre", "salt").alias("block"), F.lit(True).alias("probe"), F.col("centre").alias("rep")))


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs`` (doc_id, text).

    The set of a text are its distinct shingles of ``size`` words (A to Z
    lower-cased, words cut at ASCII white space); with fewer words the whole
    sequence is the one shingle. Two texts link when 100 * |intersection| >=
    ``percent`` * |union|. component_id is the smallest doc_id reachable by links.

    Null and empty texts have no shingles and link with nothing. Rows without an
    id take no part: their component_id is null. Rows that repeat an id are
    texts of their own, each in the class that its own text links with. Other
    columns are ignored; an empty table gives no row. Sets are compared as 64-bit
    hashes of shingles: two given texts of 20,000 words collide in one of more
    than 10^10 cases.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known, unknown = own.where("doc_id IS NOT NULL"), own.where("doc_id IS NULL")
    alone, linked = _classes(known, size, percent)
    result = alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    result = result.unionByName(linked.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")))
    loose = unknown.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(_sets(size), SETS)
    return result.unionByName(loose.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def near_copies(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Rows (doc_id, th, copies, keep) of the texts of ``docs`` that a filter has to look at.

    Of each class of :func:`ngram_components` one text is kept: that of the
    smallest id, and of several texts with this id that of the smallest hash
    ``th`` = xxhash64(text). All others have a row with keep = false. A kept text
    has a row only if ``copies`` of its rows, more than one, repeat id and text.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    linked = _classes(own, size, percent)[1].groupBy("label", "doc_id", "th").agg(F.count("*").alias("copies"))
    linked = materialize(linked, "ngram-classes")
    first = materialize(linked.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("first")), "ngram-first")
    marked = linked.join(first, "label").select("doc_id", "th", "copies", (F.struct("doc_id", "th") == F.col("first")).alias("keep"))
    return marked.where("NOT keep OR copies > 1")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), cc(v, comp) USING KEY (v) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, min(cc.comp) FROM cc JOIN e ON e.a = cc.v JOIN recurring.cc AS r ON r.v = e.b WHERE cc.comp < r.comp GROUP BY e.b
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, comp AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN cc ON cc.v = d.doc_id
"""
