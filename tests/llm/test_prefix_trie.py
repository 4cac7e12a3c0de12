"""The prefix trie of conversations against one built from lists."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from fractus.llm.prefix_trie import prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, N_convs string, node string"


def order(turn):
    number, role, text = turn
    whole = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    return (number is not None, number or 0, whole[:16])


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=order)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(inside) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, inside in members.items():
        ends = ",".join(str(c) for c in inside if len(rebuilt[c]) == len(node))
        out.append((inside[0], len(node), min(members[node[:-1]]) if node else None, len(inside), children[node] if node in children else 0, leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, block):
    data = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CONVERSATIONS).repartition(4)
    return sorted(map(tuple, prefix_trie(data, block).drop("node", "parent").collect()), key=str)


def corpus(seed):
    """Families, copies over families, long conversations that share more than a block, ties and nulls."""
    rng = random.Random(seed)
    rows = []
    texts = [None, "", "é", "東京 a", "hello", "x" * 5000]
    for c in rng.sample(range(120), 70):
        turns = rng.choice([1, 2, 5, 9, 12])
        rows += [(c, k, rng.choice(["user", None]), rng.choice(texts)) for k in range(turns)]
    copy = [("user" if k % 2 else "assistant", f"turn {k}") for k in range(70)]
    for c, n in ((200, 70), (201, 70), (202, 40), (203, 22), (204, 16), (205, 70), (300, 33), (311, 18), (312, 24), (313, 25)):
        rows += [(c, k, *copy[k]) for k in range(n)]
    rows += [(207, k, *copy[k]) for k in range(20)] + [(207, k, "user", "own") for k in range(20, 50)]
    rows += [(401, None, "user", "no number"), (401, None, "user", "nor this"), (401, 0, "user", "tie"), (401, 0, "user", "tie"), (401, 0, "assistant", "tie"), (401, 2**60 + 1, "a", "late"), (401, 2**60, "a", "early")]
    rows += [(None, 0, "user", "nobody's")] * 3 + [(-3, k, *copy[k]) for k in range(12)] + [(-7, 0, "u", "t")]
    for c in range(500, 560):  # a first turn that most have, and equal conversations
        rows += [(c, 0, "user", "hello"), (c, 1, "assistant", f"{c % 3}")]
    return rows


@pytest.mark.parametrize("block", [16, 4096])
def test_against_lists(spark, block):
    rows = corpus(3)
    assert got(spark, rows, block) == brute(rows)


def test_small_tables(spark):
    assert got(spark, [], 16) == []
    for rows in ([(3, 0, "u", "t")], [(5, k, "u", "t") for k in range(60)], [(c, 0, None, None) for c in (1, 2)]):
        assert got(spark, rows, 16) == brute(rows)
    with pytest.raises(ValueError):
        prefix_trie(spark.createDataFrame([], CONVERSATIONS), 8)
