"""Merkle manifest of a table, by superblocks (operator 11).

Leaves are digests of rows, in a tree for each group; the groups' roots are the
leaves of one more tree. Places are cut into buckets of ``fanout ** levels``
leaves; one grouped function collapses that many levels of a bucket at once, and
the buckets' roots, so many times fewer, are the leaves of the next turn. A
leaf's proof is what its bucket gave, followed by the proof of its bucket.
Texts are read once: only digests are sorted, shuffled and written.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import in_order, placed, runs
from .storage import materialize, small

#: Leaves of a bucket at most, which are what a task holds at once.
BUCKET = 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A value as the manifest hashes it: ``-`` if null, else its bytes in UTF-8, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    """Lowercase hex digest of a row's values in their order."""
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def levels_of(fanout: int, bucket: int = BUCKET) -> int:
    k = 1
    while fanout ** (k + 1) <= bucket:
        k += 1
    return k


def parent(children: list[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def collapsed(digests: list[bytes], fanout: int, levels: int | None) -> tuple[list[list[int]], list[list[bytes]], bytes]:
    """Of each leaf the place in its run and the run's other digests (joined) for every level, and the root.

    ``levels`` None: until one node remains.
    """
    n = len(digests)
    ats: list[list[int]] = [[] for _ in range(n)]
    siblings: list[list[bytes]] = [[] for _ in range(n)]
    width, nodes = 1, digests
    while len(nodes) > 1 if levels is None else levels > 0:
        rest = []
        for low in range(0, len(nodes), fanout):
            run = nodes[low : low + fanout]
            rest += [b"".join(run[:i] + run[i + 1 :]) for i in range(len(run))]
        for leaf in range(n):
            node = leaf // width
            ats[leaf].append(node % fanout)
            siblings[leaf].append(rest[node])
        nodes = [parent(nodes[low : low + fanout]) for low in range(0, len(nodes), fanout)]
        width *= fanout
        levels = None if levels is None else levels - 1
    return ats, siblings, nodes[0]


def _collapse(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (grp, place, total, digest, ...) with at and siblings of each, and up (the bucket's root) on the first of a bucket."""
    size = fanout**levels
    kept = [c for c in nodes.columns if c != "bucket"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        ats, siblings, up = collapsed(rows["digest"].map(bytes).tolist(), fanout, None if rows["total"].iloc[0] <= size else levels)
        return rows[kept].assign(at=ats, siblings=siblings, up=[up] + [None] * (len(rows) - 1))

    schema = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in kept)
    with_bucket = nodes.withColumn("bucket", F.floor(F.col("place") / size))
    return with_bucket.groupBy("grp", "bucket").applyInPandas(one, f"{schema}, at array<int>, siblings array<binary>, up binary")


def _tree(leaves: DataFrame, fanout: int, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The written turns of all groups' trees, the leaves' first, and the roots (grp, digest)."""
    size, turns, now = fanout**levels, [], leaves
    while True:
        turns.append(materialize(_collapse(now, fanout, levels), name))
        now = turns[-1].where("up IS NOT NULL").select("grp", F.floor(F.col("place") / size).alias("place"), F.ceil(F.col("total") / size).alias("total"), F.col("up").alias("digest"))
        if now.where("total > 1").isEmpty():
            return turns, now.select("grp", "digest")


def _with_upper(turn: DataFrame, upper: DataFrame, on: list[str]) -> DataFrame:
    """Proofs of a turn's nodes followed by those of what stands above them."""
    above = upper.withColumnsRenamed({"at": "at_above", "siblings": "siblings_above"})
    both = turn.join(small(above), on)
    return both.withColumns({c: F.concat(c, f"{c}_above") for c in ("at", "siblings")}).drop("at_above", "siblings_above")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", fanout: int = 2, bucket: int = BUCKET, carry: dict[str, Column] | None = None) -> DataFrame:
    """Rows (order, group, *carry, leaf, place, total, subroot, root, proof).

    ``leaf``, ``subroot`` and ``root`` are lowercase hex; ``proof`` is an array of
    (at, siblings), a step for each level: the node's place in its run of up to
    ``fanout`` and the digests of the run's others (32 bytes each, joined), for
    :func:`folded`. ``bucket`` bounds the leaves that a task collapses at once and
    has no effect on the digests. Within a group leaves ascend by ``order`` (null first), equal
    values by digest; equal rows are leaves of their own with proofs of their
    own. Groups ascend bytewise, null first and a group like any other. ``carry``:
    small further columns, computed where the leaf is.

    Null values count as ``-``, empty ones as ``0:``. A table without rows gives
    none. Columns other than ``columns`` have no part in it, whatever their names.
    """
    levels = levels_of(fanout, bucket)
    extra = dict(carry or {})
    leaves = docs.select(F.col(order).alias("ord"), F.col(group).cast("string").alias("g"), F.unhex(leaf_digest([F.col(c) for c in columns])).alias("digest"), *(c.alias(f"c_{n}") for n, c in extra.items()))
    ordered = in_order(materialize(leaves, "merkle-leaves"), ["g", "ord", "digest"], "merkle-ordered")
    pieces = materialize(runs(ordered, ["g"]), "merkle-runs")
    # The groups get numbers in their own order; they are leaves of the tree above.
    names = in_order(materialize(pieces.select("g").distinct(), "merkle-groups"), ["g"], "merkle-groups")
    alone = names.withColumn("all", F.lit(0))
    numbers = materialize(placed(alone, runs(alone, ["all"]), ["all"]).select("g", F.col("place").alias("grp"), F.col("total").alias("groups")), "merkle-groups")
    of_group = numbers.withColumnRenamed("g", "g_")
    pieces = pieces.join(small(of_group), pieces["g"].eqNullSafe(of_group["g_"])).drop("g_", "groups")
    turns, subroots = _tree(placed(ordered, small(pieces), ["g"]), fanout, levels, "merkle-turn")
    # The groups' roots: (0, number of the group) in a tree of one group.
    tops = subroots.join(small(numbers.select("grp", "groups")), "grp").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.col("groups").alias("total"), "digest")
    above, root = _tree(tops, fanout, levels, "merkle-top")
    upper = _joined(above, fanout**levels).select(F.col("place").alias("grp"), F.col("digest").alias("subroot"), "at", "siblings")
    last = _with_upper(turns[-1], upper, ["grp"])
    full = _joined([*turns[:-1], last], fanout**levels, "subroot").crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))  # one row
    return full.select(F.col("ord").alias(order), F.col("g").alias(group), *(F.col(f"c_{n}").alias(n) for n in extra), *(F.lower(F.hex(c)).alias(n) for c, n in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))), "place", "total", F.arrays_zip("at", "siblings").alias("proof"))


def _joined(turns: list[DataFrame], size: int, *more: str) -> DataFrame:
    """The nodes of the first turn with whole proofs; ``more``: columns of the last turn that all get."""
    out = turns[-1]
    for turn in reversed(turns[:-1]):
        above = out.select("grp", F.col("place").alias("bucket"), "at", "siblings", *more)
        out = _with_upper(turn.withColumn("bucket", F.floor(F.col("place") / size)), above, ["grp", "bucket"])
    return out


def folded(leaf: str, proof: str) -> Column:
    """Root (lowercase hex) that a leaf's digest (lowercase hex) and a proof lead to."""
    before, behind = "lower(hex(substring(s.siblings, 1, 32 * s.at)))", "lower(hex(substring(s.siblings, 32 * s.at + 1)))"
    return F.expr(f"aggregate({proof}, {leaf}, (acc, s) -> sha2(concat({before}, acc, {behind}), 256))")


def proof_digest(proof: str) -> Column:
    """Digest of all siblings of a proof, from the leaf up and left to right."""
    return F.expr(f"sha2(array_join(transform({proof}, s -> lower(hex(s.siblings))), ''), 256)")


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` (:data:`COLUMNS`), each leaf folded up to the root again after some were tampered with.

    Where 7 divides the crc32 of the id in decimal, n_chars grows by one before
    the leaf is computed again; a null n_chars stays, and a null id is never
    tampered with. Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified).
    """
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    values = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    out = manifest(docs, carry={"tampered": F.when(changed, leaf_digest(values))})
    out = out.withColumns({"now": F.coalesce("tampered", "leaf"), "proof_sha256": proof_digest("proof")}).withColumn("folded_root", folded("now", "proof"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The unsigned crc32 of a value in decimal, as DuckDB SQL.
CRC_SQL = """
xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END)), CAST(4294967295 AS BIGINT))"""
_ENCODED = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_ENCODED.format(c) for c in COLUMNS)
ORACLE_SQL = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
    CASE WHEN {CRC_SQL.format("doc_id")} % 7 = 0 THEN sha256({_LEAF.replace("n_chars", "(n_chars + 1)")}) END AS tampered FROM documents
), leaves AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM doc
), node AS MATERIALIZED (
  SELECT g, 0 AS l, i, n, leaf AS h FROM leaves
  UNION ALL SELECT g, l + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY g, l, i // 2
), sub AS MATERIALIZED (SELECT g, h, count(*) OVER () AS n FROM node WHERE n = 1), top AS MATERIALIZED (
  SELECT 0 AS l, g AS i, n, h FROM sub
  UNION ALL SELECT l + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY l, i // 2
), every AS MATERIALIZED (
  SELECT s.g, s.i, 0 AS part, a.l, a.i AS pos, b.h AS sibling FROM leaves s JOIN node a ON a.g = s.g AND a.n > 1 AND a.i = s.i >> a.l LEFT JOIN node b ON b.g = a.g AND b.l = a.l AND b.i = xor(a.i, 1)
  UNION ALL SELECT s.g, s.i, 1, a.l, a.i, b.h FROM leaves s JOIN top a ON a.n > 1 AND a.i = s.g >> a.l LEFT JOIN top b ON b.l = a.l AND b.i = xor(a.i, 1)
), step AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY part, l) AS k FROM every
), fold AS MATERIALIZED (
  SELECT g, i, 1 AS k, coalesce(tampered, leaf) AS h FROM leaves
  UNION ALL SELECT f.g, f.i, f.k + 1, sha256(CASE WHEN pos % 2 = 1 THEN sibling || h ELSE h || coalesce(sibling, '') END) FROM fold f JOIN step s ON s.g = f.g AND s.i = f.i AND s.k = f.k
), proof AS (SELECT g, i, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS proof_sha256 FROM step GROUP BY g, i)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = top.h AS verified
FROM leaves JOIN sub USING (g) JOIN (SELECT h FROM top WHERE n = 1) top ON true LEFT JOIN proof USING (g, i)
JOIN (SELECT g, i, arg_max(h, k) AS h FROM fold GROUP BY g, i) fold USING (g, i)
"""
