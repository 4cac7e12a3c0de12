"""Re-Pair goes on until no pair is frequent."""

import random

import numpy as np

from fractus.llm.token_files import TERMINALS, Shard, _adjacent, compress, expand, pack_shard, read_token_files, write_token_files


def test_copies_of_a_passage(spark, tmp_path):
    rng = random.Random(4)
    passage = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    docs = spark.createDataFrame([(i, f"{i} {passage}") for i in range(300)], "doc_id long, text string")
    write_token_files(docs.coalesce(1), str(tmp_path))
    shards = [Shard(bytes(r.block)) for r in spark.read.parquet(f"{tmp_path}/shards").collect()]
    assert sum(s.tokens for s in shards) > 300 * 100
    assert sum(len(s.symbols) for s in shards) < 300 * 8  # the number and the end of each, and a few symbols for the passage
    assert read_token_files(spark, str(tmp_path)).count() == 300


def test_no_frequent_pair_is_left():
    ids = np.random.default_rng(1).zipf(1.3, 60_000).clip(0, 2_000).astype(np.uint16)
    seq, rules, sizes = compress(ids, None, 20)
    assert (expand(seq, rules, sizes) == ids).all()
    assert np.unique(_adjacent(seq), return_counts=True)[1].max() < 20 and len(sizes) > 2


def test_symbols_wider_than_16_bits():
    ids = np.random.default_rng(1).integers(0, 300, 500_000).astype(np.uint16)
    seq, rules, sizes = compress(ids, None, 2)
    assert TERMINALS + len(rules) > 65536 and (expand(seq, rules, sizes) == ids).all()
    assert np.unique(_adjacent(seq), return_counts=True)[1].max() < 2
    shard = Shard(pack_shard(np.array([7]), np.array([len(ids)]), ids, None, 2))
    assert (shard.all() == ids).all() and (shard.slice(123_456, 234_567) == ids[123_456:234_567]).all()
