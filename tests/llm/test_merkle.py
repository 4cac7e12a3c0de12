"""The Merkle manifest against trees built node by node."""

import hashlib
import zlib

import pytest

from fractus.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place string, G string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, n_chars=None):
    values = [r[0], r[3], r[2], r[4] if n_chars is None else n_chars, r[1]]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fanout):
    """The root, and for each leaf its siblings' digests and their sides from the leaf up."""
    proofs, level, where = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for leaf, at in enumerate(where):
            low = at // fanout * fanout
            proofs[leaf].append((at - low, level[low:at], level[at + 1 : low + fanout]))
        level = [digest(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        where = [at // fanout for at in where]
    return level[0], proofs


def brute(rows, fanout=2):
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    members = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in groups]
    inner = [tree([leaf_of(r) for r in m], fanout) for m in members]
    root, outer = tree([t[0] for t in inner], fanout)
    out = []
    for m, (sub, proofs), above in zip(members, inner, outer):
        for r, own in zip(m, proofs):
            siblings = [s for _, before, behind in own + above for s in before + behind]
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf_of(r, r[4] + 1) if changed else leaf_of(r)
            for _, before, behind in own + above:
                now = digest(*before, now, *behind)
            out.append((r[0], leaf_of(r), sub, root, digest(*siblings), now, now == root))
    return sorted(out, key=str)


def rows():
    base = [(i, f"text {i} é東" * (i % 4), ["en", "de", None, "", "fr"][i % 7 % 5], None if i % 6 == 0 else "s", None if i % 5 == 0 else i) for i in range(61)]
    odd = [(None, None, None, None, None), (None, "", "en", "", 0), (None, "", "en", "", 0), (3, "other", "en", "s", 3), (-4, "x" * 300_000, "zz", "s", 300_000)]
    return base + odd + [base[8]] * 37  # a group of equal rows


def frame(spark, some):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in some], DOCS)


@pytest.mark.parametrize("fanout,bucket", [(2, 4), (3, 9), (2, 4096)])
def test_against_trees_built_node_by_node(spark, fanout, bucket):
    docs = frame(spark, rows()).repartition(5)
    out = merkle.manifest(docs, fanout=fanout, bucket=bucket)
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof"), merkle.folded("leaf", "proof")).collect()
    want = [(i, leaf, sub, root, proof, root) for i, leaf, sub, root, proof, _, _ in brute(rows(), fanout)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_tampered_rows_are_found(spark):
    got = [tuple(r) for r in merkle.verified_manifest(frame(spark, rows())).collect()]
    assert sorted(got, key=str) == brute(rows())
    assert {v for *_, v in got} == {True, False}


def test_small_tables(spark):
    assert merkle.verified_manifest(frame(spark, [])).collect() == []
    one = rows()[1]
    (got,) = merkle.verified_manifest(frame(spark, [one])).collect()
    assert got.leaf == got.subroot == got.root == leaf_of(one) and got.proof_sha256 == digest("") and got.verified
