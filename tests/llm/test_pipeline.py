"""The pipeline against brute force, and registered queries against their SQL."""

import os
import random
from collections import Counter

import pytest
from test_text_operators import brute_contamination, brute_lines, check_packing, prose, shingles, text_order

import corpus_pipeline
from fractus.llm import registry

SF = "/root/testdata/sf0.001"


def fixture():
    rng = random.Random(21)
    passage = prose(rng, 70)
    exam = prose(rng, 40)
    base = prose(rng, 120)
    short = " ".join(f"s{i}" for i in range(20))  # two lines: no window of three repeats
    rows = []
    for i in range(300):
        kind = i % 6
        text = prose(rng, rng.randrange(20, 90))
        if kind == 0:
            text += " scum " + prose(rng, 10)
        elif kind == 1:
            text += "\n" + passage + "\n" + prose(rng, 12)
        elif kind == 2:
            words = base.split()
            words[rng.randrange(len(words))] = "changed"
            words[rng.randrange(len(words))] = f"other{i}"
            text = " ".join(words)
        elif kind == 4 and i % 4 == 0:
            text = f"{short} end{i}"
        elif kind == 3 and i % 4 == 1:
            text += " " + exam[20:150] + " " + prose(rng, 5)
        rows.append((i, text, "en", "s", len(text)))
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, rows[10][1], "en", "s", 9)]
    # Ids that repeat: with a near copy and a text of its own, with one text, and none at all.
    twice, own = prose(rng, 60), prose(rng, 60)
    rows += [(303, f"{short} end303", "en", "s", 9), (303, own, "en", "s", 9), (304, twice, "en", "s", 9), (304, twice, "en", "s", 9), (None, prose(rng, 50), "en", "s", 9), (None, None, "en", "s", 9)]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(300)]
    items = [(1, exam), (2, prose(rng, 30)), (3, None)]
    return rows, labels, items


def brute_kept(rows):
    """Of each group of linked rows the one of the smallest id and, under one id, of the smallest hash."""
    sets, signed = [shingles(t) if i is not None else set() for i, t in rows], text_order(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    best = {}
    for k, (i, t) in enumerate(rows):
        if sets[k] and (find(k) not in best or (i, signed[t]) < best[find(k)][0]):
            best[find(k)] = (i, signed[t]), k
    return [row for k, row in enumerate(rows) if not sets[k] or best[find(k)][1] == k]


def test_pipeline(spark, tmp_path):
    rows, labels, items = fixture()
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    documents = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    clean = [(i, t) for i, t, *_ in rows if i is None or i >= 300 or i % 6]
    first = stages["toxicity"](spark, documents, path)
    assert first.columns == documents.columns
    assert Counter((r.doc_id, r.text) for r in first.collect()) == Counter(clean)

    after = brute_lines(clean)
    cut = [(i, t) for (i, _, gone, t), n in after.items() if not gone or t.strip(" \n") for _ in range(n)]
    second = stages["line dedup"](spark, first, path)
    assert second.columns == documents.columns
    got = second.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(cut) and len(cut) < len(clean)
    changed = {i for (i, _, gone, _) in after if gone and i != 303}
    assert changed and all(r.n_chars == len(r.text) for r in got if r.doc_id in changed)

    kept = brute_kept(cut)
    third = stages["n-gram Jaccard join"](spark, second, path)
    assert third.columns == documents.columns
    assert Counter((r.doc_id, r.text) for r in third.collect()) == Counter(kept) and len(kept) < len(cut)
    assert sum(i == 304 for i, _ in cut) == 2 and sum(i == 304 for i, _ in kept) == sum(i == 303 for i, _ in kept) == 1

    bad = {i for (i, _, _, _, _, hit) in brute_contamination(kept, items) if hit}
    left = [(i, t) for i, t in kept if i not in bad]
    fourth = stages["benchmark decontamination"](spark, third, path)
    assert Counter((r.doc_id, r.text) for r in fourth.collect()) == Counter(left) and bad

    pieces = corpus_pipeline.run(spark, path).collect()
    assert check_packing(pieces, left, 1024) == 0
    assert len(stages) == len(corpus_pipeline.STAGES) == 5


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    path = str(tmp_path)
    schema = "doc_id int, text string, lang string, source string, n_chars long, id int, th int, keep int, label int, row int, of int, at int, lines int, ids int"
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "some words of an item that stand nowhere else at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "en", "s", 9, *range(9)), (2, text, "en", "s", 9, *range(9)), (2, text, "en", "s", 9, *range(9))], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
        if name != "packing":
            assert stage(spark, docs.limit(0), path).columns == docs.columns
    assert stage(spark, docs, path).count() >= 3
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, path).collect()] == [1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    ordered = [df[names].astype(str).sort_values(names).reset_index(drop=True) for df in (got, want)]
    assert ordered[0].equals(ordered[1])
