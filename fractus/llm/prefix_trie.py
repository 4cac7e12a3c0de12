"""Prefix trie of conversations, built family by family (operator 13).

A family are the conversations whose ids share a base (``c - c % 5``). Its
members are rebuilt (the base's first turns, then their own) and put into a
small trie by one cogrouped function; what leaves it is a row for each node of
the family, so copies within a family never meet the shuffle. Only these combined
nodes are merged over all families. What is under a node that one family alone
has was counted there; under a shared node it is summed by pointer doubling, in
as many rounds as the longest shared path has binary digits.

Turns are digests from the first step on; texts are read once and never
shuffled. A node's name is a digest of its turns: blocks of ``block`` turns are
chained, so a conversation longer than a block is named block by block in many
tasks, and only its first block goes through the family.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded
from .merkle import CRC_SQL
from .ranks import in_order, placed, runs
from .storage import materialize, small

FAMILY = 5
#: Turns taken from the base are fewer than this.
HEADS = 9
#: Turns of a conversation that a family's task holds; longer ones go on in blocks of as many.
BLOCK = 4096
ROOT = b"\0" * 16
NOTHING = sha256(b"").hexdigest()

NODE = "id binary, parent binary, depth long, n long, conv long, above long, bytes long, children long, leaves long, saved long, ends array<long>, open boolean"
#: A node's row, or (id null) how a long conversation goes on: ends = [conversation, shift of its places].
FIELDS = [f.split()[0] for f in NODE.split(", ")]
#: The same fields' types in Arrow.
ARROW = [{"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[f.split()[1]] for f in NODE.split(", ")]


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def names(turns: list[bytes], block: int) -> Iterator[bytes]:
    """Names of the prefixes of one turn, two turns and so on."""
    start, running = ROOT, b""
    for k, turn in enumerate(turns, 1):
        running = _digest(running + turn)
        name = _digest(start + running)
        yield name
        if k % block == 0:
            start, running = name, b""


def taken(conv: int) -> int:
    """Turns that a conversation takes from its base."""
    return crc32(str(conv).encode()) % HEADS


def family_nodes(base: list[tuple[bytes, int]], members: dict[int, tuple[list[tuple[bytes, int]], bool]], block: int) -> list[tuple]:
    """Rows :data:`NODE` of one family: the first turns of its base, and the turns (digest, bytes) of its members, with whether more follow."""
    nodes: dict[bytes, list] = {ROOT: [None, 0, 0, None, 0, 0, 0, 0, [], False, 0, []]}  # parent, depth, n, conv, bytes, children, leaves, saved, ends, open, passers, goes on
    for conv in sorted(members):
        own, more = members[conv]
        h = taken(conv)
        turns = base[:h] + own[h:]
        shift = min(h, len(base)) - h
        turns = turns[:block] if more else turns
        at, path = ROOT, [ROOT]
        for (_, size), name in zip(turns, names([d for d, _ in turns], block)):
            if name not in nodes:
                nodes[name] = [at, len(path), 0, None, size, 0, 0, 0, [], False, 0, []]
                nodes[at][5] += 1
            at = name
            path.append(at)
        for name in path:
            node = nodes[name]
            node[2] += 1
            node[3] = conv if node[3] is None else min(node[3], conv)
            node[10] += name != at or more
        if more:
            nodes[at][11].append((conv, shift))
        else:
            nodes[at][8].append(conv)
    out = []
    for name in sorted(nodes, key=lambda k: -nodes[k][1]):  # children come before their parents
        parent, depth, n, conv, size, children, leaves, saved, ends, is_open, passers, goes_on = nodes[name]
        if goes_on:
            # One member that goes on alone is a chain below; several, or others beside it, are merged by name.
            is_open = is_open or passers > 1
            children, leaves = children + 1, leaves + 1
        leaves = leaves if children else 1
        saved += (n - 1) * size
        if parent is not None:
            above = nodes[parent]
            above[6] += leaves
            above[7] += saved
            above[9] = above[9] or is_open
        out.append((name, parent, depth, n, conv, None if parent is None else nodes[parent][3], size, children, leaves, saved, ends, is_open))
        out += [(None, name, depth, None, conv, None, None, None, None, None, [c, shift], None) for c, shift in goes_on]
    return out


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes): role and text as one digest of 16 bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    cid = F.col("conv_id").cast("long")
    return conversations.where(cid.isNotNull()).select(cid.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(whole, 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def _families(heads: DataFrame, block: int) -> DataFrame:
    def rows_of(side: pa.Table) -> dict[int, tuple[list[tuple[bytes, int]], bool]]:
        out: dict[int, tuple[list[tuple[bytes, int]], bool]] = {}
        columns = (side.column(c).to_pylist() for c in ("conv_id", "numbered", "turn", "digest", "bytes", "more"))
        for conv, _, _, digest, size, more in sorted(zip(*columns)):
            out.setdefault(conv, ([], more))[0].append((digest, size))
        return out

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        bases = rows_of(left)
        base = [t for turns, _ in bases.values() for t in turns[:HEADS]]  # one base at most
        found = zip(*family_nodes(base, bases | rows_of(right), block))
        return pa.Table.from_arrays([pa.array(values, kind) for values, kind in zip(found, ARROW)], FIELDS)

    with_family = heads.withColumns({"family": F.col("conv_id") - F.col("conv_id") % FAMILY, "numbered": F.col("turn").isNotNull(), "turn": F.coalesce("turn", F.lit(0))})
    base = F.col("conv_id") % FAMILY == 0
    others = with_family.where(~base).select(*(F.col(c).alias(c) for c in with_family.columns))  # columns of its own, for the cogroup
    return with_family.where(base).groupBy("family").cogroup(others.groupBy("family")).applyInArrow(one, NODE)


def _chained(rows: DataFrame, goes_on: DataFrame, block: int) -> DataFrame:
    """Rows :data:`NODE` of the turns behind the first block of long conversations; ``rows``: (conv_id, place, total, digest, bytes)."""
    places = rows.join(small(goes_on), "conv_id").withColumn("at", F.col("place") + F.col("shift")).where(F.col("at") >= block)
    places = places.withColumns({"b": F.floor(F.col("at") / block), "last": F.col("place") == F.col("total") - 1})

    def running(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        before, value, pairs = None, b"", []
        for d in group["digest"]:
            value = _digest(value + bytes(d))
            pairs.append((before, value))
            before = value
        return group[["conv_id", "b", "at", "bytes", "last", "above"]].assign(before=[p for p, _ in pairs], value=[v for _, v in pairs])

    schema = "conv_id long, b long, at long, bytes long, last boolean, above long, before binary, value binary"
    settled = materialize(places.groupBy("conv_id", "b").applyInPandas(running, schema), "trie-blocks")
    ends = settled.where((F.col("at") + 1) % block == 0).select("conv_id", "b", "value").unionByName(goes_on.select("conv_id", F.lit(0).cast("long").alias("b"), F.col("id").alias("value")))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names of the blocks' starts, one block of a conversation after another."""
        now, start = None, ROOT
        for batch in batches:
            out = []
            for conv, b, value in zip(*(batch.column(c).to_pylist() for c in range(3))):
                start = value if conv != now else _digest(start + value)
                now = conv
                out.append((conv, b + 1, start))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["conv_id", "b", "start"])

    starts = ends.repartition("conv_id").sortWithinPartitions("conv_id", "b").mapInArrow(chain, "conv_id long, b long, start binary")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, before, value = (batch.column(c).to_pylist() for c in range(3))
            ids = [_digest(s + v) for s, v in zip(start, value)]
            above = [s if v is None else _digest(s + v) for s, v in zip(start, before)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(above, pa.binary()), *batch.columns[3:]], ["id", "parent", "depth", "conv", "above", "bytes", "last"])

    met = settled.join(starts, ["conv_id", "b"])
    above = F.when(F.col("at") == block, F.col("above")).otherwise(F.col("conv_id"))
    named_rows = met.select("start", "before", "value", (F.col("at") + 1).alias("depth"), F.col("conv_id").alias("conv"), above.alias("above"), "bytes", "last").mapInArrow(named, "id binary, parent binary, depth long, conv long, above long, bytes long, last boolean")
    fixed = {"n": F.lit(1), "children": F.when(F.col("last"), 0).otherwise(1), "leaves": F.lit(1), "saved": F.lit(0)}
    return named_rows.withColumns({c: v.cast("long") for c, v in fixed.items()} | {"ends": F.when(F.col("last"), F.array("conv")).otherwise(F.array().cast("array<long>")), "open": F.lit(False)}).select(*FIELDS)


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the ascending conversations of each node (id, conv).

    Pieces of a sorted list are joined where ranges of it lie; a node's digest
    then passes over its pieces, one after another, in constant memory.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
            spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in spans], pa.binary()), pa.array([convs[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, convs[a:b])) for a, b in spans], pa.string())], ["id", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(name: bytes, state) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(state, pa.string())], ["id", "ends_sha256"])

        now, state, names_, values = None, None, [], []
        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name == now:
                    state.update(b",")
                else:
                    if now is not None:
                        names_.append(now)
                        values.append(state.hexdigest())
                    now, state = name, sha256()
                state.update(piece.encode())
            yield row(names_, values)
            names_, values = [], []
        if now is not None:
            yield row([now], [state.hexdigest()])

    joined = ends.select("id", "conv").repartitionByRange("id", "conv").sortWithinPartitions("id", "conv").mapInArrow(pieces, "id binary, first long, piece string")
    return joined.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digests, "id binary, ends_sha256 string")


def _subtrees(shared: DataFrame) -> DataFrame:
    """(id, leaves, saved): sums of own_leaves and own_saved over the shared nodes of each subtree; ``shared`` has a forest by parent, null at its tops."""
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    state, reach = shared.select("id", F.col("parent").alias("up"), F.col("own_leaves").alias("leaves"), F.col("own_saved").alias("saved")), 1
    while reach < deepest:
        # So far a node has the sums of what is less than ``reach`` below it; up is its ancestor ``reach`` above.
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        more = state.join(below, "id", "left").join(jump, "up", "left")
        state = materialize(more.select("id", F.col("next").alias("up"), *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved"))), "trie-sums")
        reach *= 2
    return state.select("id", "leaves", "saved")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations.

    Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), and node (binary, 16 bytes), parent (null at the
    root): names of a node and of the one above it. Turns are ordered by turn,
    null first; equal numbers by a digest of role and text, so that the result
    doesn't hang on the order of rows; repeated rows are turns of their own. Null
    roles and texts are empty. Rows without a conv_id are of no conversation and
    left out; a table without conversations has no node, not even a root.
    ``c % 5`` has the sign of c. Other columns are ignored. ``block`` (16 or more)
    bounds the turns of a conversation that one task holds; it has no effect on
    the result but the names of nodes.
    """
    if block < 16:
        raise ValueError("a block has 16 turns or more")
    rows = bounded(materialize(_turns(conversations), "trie-turns"))
    long_ones = materialize(rows.groupBy("conv_id").count().where(F.col("count") > block + HEADS - 1).select("conv_id"), "trie-long")
    longs = small(long_ones)
    ordered = in_order(materialize(rows.join(longs, "conv_id", "left_semi"), "trie-long"), ["conv_id", "turn", "digest"], "trie-long")
    ranked = placed(ordered, small(runs(ordered, ["conv_id"])), ["conv_id"])
    heads = rows.join(longs, "conv_id", "left_anti").withColumn("more", F.lit(False)).unionByName(ranked.where(F.col("place") < block + HEADS).select("conv_id", "turn", "digest", "bytes", F.lit(True).alias("more")))
    found = materialize(_families(heads, block), "trie-families")
    goes_on = found.where("id IS NULL").select(F.col("ends")[0].alias("conv_id"), F.col("ends")[1].alias("shift"), F.col("parent").alias("id"), F.col("conv").alias("above"))
    nodes = found.where("id IS NOT NULL").unionByName(materialize(_chained(ranked.select("conv_id", "place", "total", "digest", "bytes"), goes_on, block), "trie-tails"))

    of_node = nodes.groupBy("id").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("above").alias("above"), F.max("bytes").alias("bytes"), F.max("children").alias("children"), F.max("leaves").alias("leaves"), F.max("saved").alias("saved"), ((F.count("*") > 1) | F.bool_or("open")).alias("shared"), F.max(F.when(F.size("ends") > 0, F.sha2(F.array_join(F.array_sort("ends"), ","), 256))).alias("ends_sha256"))
    merged = materialize(of_node, "trie-nodes")
    shared = merged.where("shared")
    known = shared.select(F.col("id").alias("parent"), F.col("conv").alias("parent_conv"))
    linked = materialize(merged.join(small(known), "parent", "left"), "trie-linked")
    below = linked.where("parent_conv IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"), *(F.sum(F.when(F.col("shared"), 0).otherwise(F.col(c))).alias(f"{c}_below") for c in ("leaves", "saved")))
    of_shared = linked.where("shared").drop("children", "leaves", "saved").join(below, "id", "left")
    kids = F.coalesce("kids", F.lit(0))
    own = {"children": kids, "own_leaves": F.when(kids == 0, 1).otherwise(F.coalesce("leaves_below", F.lit(0))), "own_saved": (F.col("n") - 1) * F.col("bytes") + F.coalesce("saved_below", F.lit(0))}
    counted = materialize(of_shared.withColumns(own), "trie-shared")
    # The root has a row of its own sums at the end: all that lies directly below it is too much for one key.
    inner = counted.where("depth > 0").withColumn("parent", F.when(F.col("depth") > 1, F.col("parent")))
    sums = materialize(_subtrees(inner), "trie-sums")
    top = inner.where("depth = 1").select("id").join(sums, "id").agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("a"), F.coalesce(F.sum("saved"), F.lit(0)).alias("b"))
    root_sums = counted.where("depth = 0").crossJoin(F.broadcast(top)).select("id", (F.col("own_leaves") + F.col("a")).alias("leaves"), (F.col("own_saved") + F.col("b")).alias("saved"))  # one row
    digests = _ends_digests(nodes.where(F.size("ends") > 0).join(small(shared.select("id")), "id", "left_semi").select("id", F.explode("ends").alias("conv")))
    done = counted.drop("ends_sha256").join(sums.unionByName(root_sums), "id").join(digests, "id", "left")
    both = linked.where("NOT shared").unionByName(done.select(*linked.columns))
    return both.select(F.col("conv").alias("conv_id"), "depth", F.coalesce("parent_conv", "above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), F.col("id").alias("node"), "parent")


#: Turns are numbered and rebuilt; a node is the list of its turns' digests, and its subtree is found through the prefixes of its nodes' smallest members.
ORACLE_SQL = """
WITH turn AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), head AS (
  SELECT c, own, CRC % 9 AS h FROM turn
), rebuilt AS MATERIALIZED (
  SELECT a.c, list_concat(coalesce(list_slice(b.own, 1, h), []), list_slice(a.own, h + 1, len(a.own))) AS t FROM head a LEFT JOIN turn b ON b.c = a.c - a.c % 5
), prefix AS MATERIALIZED (
  SELECT c, d, len(t) AS n, CASE WHEN d > 0 THEN strlen(t[d].t) ELSE 0 END AS bytes, sha256(CAST(list_transform(list_slice(t, 1, d), lambda x: sha256(strlen(x.r) || ':' || x.r || x.t)) AS VARCHAR)) AS id,
    CASE WHEN d > 0 THEN sha256(CAST(list_transform(list_slice(t, 1, d - 1), lambda x: sha256(strlen(x.r) || ':' || x.r || x.t)) AS VARCHAR)) END AS parent
  FROM rebuilt, range(0, len(t) + 1) AS g(d)
), node AS MATERIALIZED (
  SELECT id, any_value(parent) AS parent, min(c) AS c, d, count(*) AS n, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = prefix.n), '')) AS ends_sha256 FROM prefix GROUP BY id, d
), kids AS MATERIALIZED (SELECT parent AS id, count(*) AS kids FROM node WHERE parent IS NOT NULL GROUP BY parent
), sub AS MATERIALIZED (
  SELECT p.id, count(*) FILTER (kids IS NULL) AS leaves, sum((node.n - 1) * node.bytes) AS saved FROM node LEFT JOIN kids USING (id) JOIN prefix p ON p.c = node.c AND p.d <= node.d GROUP BY p.id
)
SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, node.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node LEFT JOIN node up ON up.id = node.parent LEFT JOIN kids ON kids.id = node.id JOIN sub ON sub.id = node.id
""".replace("CRC", CRC_SQL.format("c"))
