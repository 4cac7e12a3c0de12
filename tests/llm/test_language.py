"""Language ID: subwords and means against loops, training on small corpora, held-out accuracy."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fractus.llm import language

TEXTS = ["Ab, cde", "", None, "é东 x9y", "-- 12 --", "Z", "word " * 300_000]
DOCS = "doc_id long, text string, lang string, source string, score string, SCORE_ string"


def brute_subwords(text):
    """Runs of one to four bytes of a text between breaks that have a break at their ends at most and are none."""
    data = [b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 0 for b in b"\0" + (text or "").encode() + b"\0"]
    out = Counter()
    for n in (1, 2, 3, 4):
        for k in range(len(data) - n + 1):
            run = tuple(data[k : k + n])
            if any(run) and all(run[1:-1]):
                out[run] += 1
    return out


def test_subwords():
    found = [Counter() for _ in TEXTS]
    for text, bucket in language.text_subwords(pa.array(TEXTS[:-1]), 1 << 40):
        for t, b in zip(text.tolist(), bucket.tolist()):
            found[t][b] += 1
    for t, f in zip(TEXTS[:-1], found):
        assert sorted(f.values()) == sorted(brute_subwords(t).values())
    assert found[5] == Counter({b: 1 for b in found[5]}) and len(found[5]) == 4  # Z alone, with either break, with both


def test_long_texts_go_through_in_parts():
    column = pa.array(TEXTS)
    total = Counter()
    for text, bucket in language.text_subwords(column, 1 << 40):
        total.update(bucket[text == len(TEXTS) - 1].tolist())
    assert sorted(total.values()) == sorted(brute_subwords(TEXTS[-1]).values())


def test_means_are_means():
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b"], rng.normal(size=(64, 3)).astype(np.float32), rng.normal(size=(3, 2)).astype(np.float32), np.zeros(2, np.float32))
    got = model.means(pa.array(TEXTS[:-1]), model.table)
    sums, counts = np.zeros((6, 3)), np.zeros(6)
    for text, bucket in language.text_subwords(pa.array(TEXTS[:-1]), 64):
        for t, b in zip(text, bucket):
            sums[t] += model.table[b]
            counts[t] += 1
    assert np.allclose(got, sums / np.maximum(counts, 1)[:, None], atol=1e-5)


def made(spark, n=400):
    """Two invented languages by their syllables, and odd rows."""
    rng = random.Random(2)
    kinds = {"aa": ["lo", "mi", "ra", "te"], "bb": ["zun", "grk", "pfa", "öst"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60))), k, "s", "x", "y") for i, k in ((i, "ab"[i % 2] * 2) for i in range(n))]
    odd = [(None, "lomi rate", "aa", None, "x", "y"), (5001, None, "aa", "s", "x", "y"), (5002, "", "bb", "s", "x", "y"), (5003, "12 -- 3", None, "s", "x", "y"), (5004, "zungrk", None, "s", "x", "y"), (1, rows[1][1], "bb", "s", "x", "y")]
    return spark.createDataFrame(rows + odd + [(7, "lo " * 100_000, "aa", "s", "x", "y")], DOCS)


def test_made_languages(spark):
    out = language.identify(made(spark).repartition(3)).collect()
    assert {r.SCORE_ for r in out} == {"y"} and len(out) == 407
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in ("aa", "bb", "und")
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
    held = [r for r in out if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and sum(r.rejected for r in held) < 0.2 * len(held)
    by_text = {}
    assert all(by_text.setdefault(r.text, (r.lang_pred, r.score)) == (r.lang_pred, r.score) for r in out)
    assert {r.lang_pred for r in out if r.doc_id == 5004} == {"bb"}


def test_held_out_rows_teach_nothing(spark):
    docs = made(spark)
    changed = docs.withColumn("lang", F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2, "zz").otherwise(F.col("lang")))
    rows = [sorted(((r.doc_id or -1, r.text or "", r.lang_pred, r.score) for r in language.identify(d).collect())) for d in (docs, changed)]
    assert rows[0] == rows[1]


def test_nothing_to_learn(spark):
    none = language.identify(made(spark, 10).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in none} == {("und", 0.0, True)}
    assert language.identify(spark.createDataFrame([], DOCS)).collect() == []


def test_bounds_of_the_sample(spark):
    langs, texts, labels = language.training_sample(made(spark), 40, 1 << 20, 500, 1 << 12)
    assert langs == ["aa", "bb"] and np.bincount(labels).max() <= 20
    few = language.training_sample(made(spark), 40, 2000, 500, 1 << 12)[1]
    assert 1 <= len(few) < len(texts) and sum(8 * len(i) for i, _ in few) <= 2000 + 8 * max(len(i) for i, _ in few)
    assert language.training_sample(made(spark), 40, 1 << 20, 1, 1 << 12)[0] in (["aa"], ["bb"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_held_out_accuracy(spark):
    out = language.identify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    right, n = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.98
