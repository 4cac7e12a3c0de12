"""Operators on documents against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fractus.llm import decontamination, licenses, line_dedup, storage
from fractus.llm.media import decode_png, encode_png, media_columns, pad
from fractus.llm.ngram_join import ngram_components
from fractus.llm.packing import nnls, pack, plan
from fractus.llm.secrets import secret_scan
from fractus.llm.token_files import Shard, compress, expand, pack_shard, token_files
from fractus.llm.tokens import default_vocabulary, encoder
from fractus.llm.toxicity import toxicity

DOCS = "doc_id long, text string, lang string, n string, at string, rep string, hits string, label string"
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies in a large group, shared passages, repeated lines, edge cases."""
    rng = random.Random(seed)
    base, passage = prose(rng, 150).split(), prose(rng, 60)
    texts = [None, "", "  \n ", "one", "one two", "ONE two", "a b c d e", "A b c d e", "x" * 30_000, prose(rng, 9_000)]
    texts += [" ".join(base)] * 5
    for _ in range(130):  # near copies: some link with the base, some only with one another, some with none
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        texts.append(" ".join(words[: rng.randrange(110, 151)]))
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, rng.randrange(5, 60)) for _ in range(25)]
    texts += ["\n".join(prose(rng, rng.randrange(1, 30)) for _ in range(8)) for _ in range(25)]
    texts += ["Été ÉTÉ été straße 東京 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"] * 2
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, "one"), (None, "one"), (None, None), (7, texts[12])]  # repeated rows, ids and no ids
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", "h", "l") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# --- n-gram join --------------------------------------------------------------


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def test_ngram_components(spark, docs, rows, monkeypatch):
    import fractus.llm.ngram_join as join

    monkeypatch.setattr(join, "BLOCK_PROBES", 7)
    monkeypatch.setattr(join, "BLOCK_TEXTS", 16)
    got = Counter(tuple(r) for r in ngram_components(docs).collect())
    assert Counter({k: n for k, n in got.items() if k[0] is not None}) == brute_components(rows)
    assert sum(n for k, n in got.items() if k[0] is None) == 2
    assert all(k[2] is None for k in got if k[0] is None)
    # joined by shuffles instead of broadcasts
    monkeypatch.setattr(join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(join, "SHORT_LIST", 4)
    assert Counter(tuple(r) for r in ngram_components(docs).collect()) == got


def test_ngram_components_of_rows_that_share_an_id(spark):
    rng = random.Random(8)
    words = [f"u{i}" for i in range(5000)]
    a, b, c = (" ".join(rng.sample(words, 104)) for _ in range(3))
    half = " ".join(a.split()[:54] + b.split()[:54])
    near = lambda t: " ".join([*t.split()[:-1], "end"])
    rows = [(1, a), (1, b), (2, half), (3, near(a)), (4, near(b)), (5, c), (5, a), (6, near(c)), (6, near(c)), (7, c), (8, None), (8, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_components(docs).collect())
    assert got == brute_components(rows) and got[(2, 104, 2)] == 1 and got[(5, 100, 5)] == got[(5, 100, 1)] == 1


def test_ngram_components_of_nothing(empty):
    assert ngram_components(empty).count() == 0


# --- tokens, packing ----------------------------------------------------------


def true_ids(t):
    return np.array([*encoder(default_vocabulary()).tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder_equals_the_library():
    coder = encoder(default_vocabulary())
    rng = random.Random(3)
    odd = ["", "a", "\n", "a\nb", "a\n\nb", " a", "a ", "a  b", "a \nb", "a\tb", "x\rb", "it's don't", "a <|endoftext|> b", "日本 語\nテスト", "é\x85f", "'s 's\n's", "a b", "naïve, Ünïcode.\n…", None]
    odd += ["".join(rng.choice(["a", "é", " ", "\n", "'s", "1", ".", ",", "\t", "語", "Wort"]) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    for text, raw in zip(odd, coder.encode_batch(odd)):
        assert raw == true_ids(text)[:-1].astype("<u2").tobytes(), repr(text)


def test_re_pair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 5), (5000, 3), (20_000, 400)):
        ids = rng.integers(0, top, n).astype(np.uint16)
        seq, rules, sizes = compress(ids, 4, 3)
        assert (expand(seq, rules, sizes) == ids).all()
        shard = Shard(pack_shard(np.array([7]), np.array([n]), ids, 4, 3))
        assert (shard.all() == ids).all()
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (shard.slice(a, b) == ids[a:b]).all()
    assert len(compress(np.zeros(4096, np.uint16), 8, 2)[0]) < 64
    with pytest.raises(ValueError):
        Shard(pack_shard(np.array([7]), np.array([1]), np.zeros(1, np.uint16), 1, 2)[:-1] + b"!")


def test_token_files(docs, rows, empty):
    got = sorted(token_files(docs, shard_tokens=700).collect(), key=lambda r: r.start)
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = true_ids(t)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files(empty).count() == 0


def check_packing(got, rows, window):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    padding = sum(0 if n & (n - 1) == 0 else window - n for n in (sum(x[1] for x in p) for p in by_sequence.values()))
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(true_ids(t))
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        if len(ids[i]) > 1:
            assert sum(p[1] for p in pieces) == sum(map(len, ids[i]))
            continue
        at = 0
        for start, length, crc, n in sorted(pieces):
            assert start == at and n == len(ids[i][0]) and crc == zlib.crc32(ids[i][0][at : at + length].tobytes())
            at += length
        assert at == len(ids[i][0])
    return padding


def test_packing(spark, docs, rows, empty):
    for window in (64, 1024):
        assert check_packing(pack(docs, window).collect(), rows, window) == 0
    same = [(i, "w1 w2 w3 w4 w5") for i in range(50)]  # no combination fills a window
    assert check_packing(pack(frame(spark, same), 64).collect(), same, 64) == 0
    assert pack(empty).count() == 0
    with pytest.raises(ValueError):
        pack(docs, 100)


def test_nnls_and_plan():
    histogram = np.zeros(65, np.int64)
    histogram[[10, 54, 20, 24]] = [30, 20, 10, 5]
    x = nnls([(54, 10), (20, 20, 24)], histogram)
    assert abs(x[0] - 25) < 1e-3 and abs(x[1] - 5) < 1e-3
    chosen = plan(histogram, 64)
    assert sum(len(s[0]) for s in chosen.slots.values()) == 5
    assert plan(np.zeros(65, np.int64), 64).n_sequences == 0


# --- line dedup ---------------------------------------------------------------


def brute_lines(rows):
    line = re.compile(line_dedup.LINE.replace(r"\z", r"\Z"))
    split = [(i, t, [x for x in line.findall(t or "") if x]) for i, t in rows]
    key = lambda a, j: tuple(x.strip(" \n") for x in a[j : j + 3])
    signed = text_order(rows)
    order = lambda i, t: (i is not None, i or 0, signed[t])
    first = {}
    for i, t, a in split:
        for j in range(len(a) - 2):
            k = key(a, j)
            first[k] = min(first.get(k, (order(i, t), j)), (order(i, t), j))
    out = []
    for i, t, a in split:
        gone = {j + d for j in range(len(a) - 2) if first[key(a, j)] != (order(i, t), j) for d in range(3)}
        out.append((i, len(a), len(gone), "".join(x for j, x in enumerate(a) if j not in gone) if gone else t))
    return Counter(out)


def text_order(rows):
    """The order of texts under one id: Spark's hash of them."""
    from pyspark.sql import SparkSession

    texts = SparkSession.active().createDataFrame([(t,) for t in {t for _, t in rows}], "t string")
    return {r.t: r.h for r in texts.select("t", F.xxhash64("t").alias("h")).collect()}


def test_line_dedup(docs, rows, empty, monkeypatch):
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(got.columns)
    got = got.select("doc_id", "n_lines", "n_removed", "text")
    assert Counter(tuple(r) for r in got.collect()) == want
    monkeypatch.setattr(line_dedup, "BROADCAST_POSITIONS", -1)
    assert Counter(tuple(r) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text").collect()) == want
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_rows_that_share_an_id(spark):
    rng = random.Random(4)
    own, other, passage = ("".join(f"{prose(rng, 20)}\n" for _ in range(8)) for _ in range(3))
    rows = [(1, passage), (7, own), (7, "\n" + passage + "End."), (None, other), (None, "x\n" + passage), (None, other), (9, passage), (9, passage)]
    docs = spark.createDataFrame([(i, t, 0, 0, 0, 0) for i, t in rows], "doc_id long, text string, th int, OF int, at int, lines_ int")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    got = Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_removed", "text").collect())
    assert got == brute_lines(rows)
    left = {(i, t): n for i, _, n, t in got}
    assert left[7, own] == left[None, other] == left[None, "x\n" + passage] == 0 and left[7, "\nEnd."] > 0


def test_passages_without_newlines_are_found_at_any_place(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.choice((2, 3, 3, 4, 5, 6, 7, 8, 9)))) for _ in range(900)]
    said = lambda n: " ".join(rng.choice(words) + rng.choice([""] * 9 + [".", ","]) for _ in range(n))
    passages = [said(100) for _ in range(110)]
    rows = [(k, said(30) + " " + p + " " + said(30)) for k, p in enumerate(passages)]
    rows += [(1000 + k, said(30 + k % 11) + " " + p + " " + said(20)) for k, p in enumerate(passages)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].n_removed == 0 and got[k].text == rows[k][1] for k in range(110))
    cut = [1 - len(got[1000 + k].text) / len(rows[110 + k][1]) for k in range(110)]
    assert min(cut) > 0.2 and sum(cut) / 110 > 0.5  # the passage is 60 to 66 % of the text


def test_lines_add_up_to_the_text(spark):
    texts = ["", "a", "\n\na b\n", "A b c d e f. G h", " ".join("abcdefghijklmnop"), "a b unmistakably c  d unmistakably. E\nf g.", "g" * 30_000, "a " * 30_000, "abcdefghi " * 30_000, "x " * 40 + "\n\ny"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.array_join(line_dedup.lines_of(F.col("text")), "").alias("again")).collect()
    assert all(r.text == r.again for r in got)


# --- decontamination ----------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for item, t in items:
        w = WORD.findall(ascii_lower(t))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add(item)
    lengths = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w = WORD.findall(ascii_lower(t))
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= {str(x) for x in windows[k] if x is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_contamination(spark, docs, rows, empty, monkeypatch):
    rng = random.Random(9)
    long = rows[-4 - 30][1]
    items = [(1, None), (2, ""), (3, "One"), (4, rows[9][1][400:900]), (5, (long or "")[:200]), (6, "été straße"), (5, (long or "")[:200]), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (8, "nowhere found"), (9, prose(rng, 30)), (10, "w1 w2 w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute_contamination(rows, items)
    assert Counter(tuple(r) for r in decontamination.contamination(docs, bench).select(*names).collect()) == want
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert Counter(tuple(r) for r in decontamination.contamination(docs, bench).select(*names).collect()) == want
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_contamination_keeps_columns_of_any_name(spark):
    exam = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, "x " + exam), (1, "clean text"), (None, exam + " y"), (None, "clean too"), (2, exam), (2, exam), (3, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id int, text string, row int, ROW_ int, of int, at int, ids int")
    items = spark.createDataFrame([(5, exam), (6, exam)], "item_id long, text string")
    got = decontamination.contamination(docs, items)
    assert got.columns == [*docs.columns, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"]
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == brute_contamination(rows, [(5, exam), (6, exam)])


def brute_proximity(rows, items, slop):
    texts = [(i, WORD.findall(ascii_lower(t))) for i, t in rows]
    counts = Counter(w for _, t in texts for w in t)
    out = set()
    for item, t in items:
        w = WORD.findall(ascii_lower(t))
        for s in range(max(1, len(w) - 9) if w else 0):
            window = w[s : s + 10]
            known = [(j, x) for j, x in enumerate(window) if counts[x]]
            lead = min(((counts[x], x, window.index(x)) for _, x in known), default=None)
            for i, text in texts if lead else ():
                for p in (p for p, x in enumerate(text) if x == lead[1]):
                    start = p - lead[2]
                    if all(x in text[max(0, start + j - slop) : max(0, start + j + slop + 1)] for j, x in known):
                        out.add((i, str(item), start))
    return out


def test_proximity(spark):
    rng = random.Random(12)
    texts = [(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "alpha x x x beta gamma"), (4, "delta gamma beta"), (5, "x alpha unknown2 gamma")]
    items = [(7, "alpha beta gamma"), (8, "alpha absent gamma"), (9, "nowhere"), (10, "gamma gamma alpha")]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontamination.proximity_matches(docs, bench, slop=1).collect()}
    assert got == brute_proximity(texts, items, 1) and {(i, x) for i, x, _ in got} >= {(1, "7"), (2, "7"), (5, "8")} and not {(3, "7"), (4, "7")} & {(i, x) for i, x, _ in got}
    texts = [(i, " ".join(rng.choice("abcdef") for _ in range(40))) for i in range(12)]
    items = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 14)))) for i in range(10)]
    got = {tuple(r) for r in decontamination.proximity_matches(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_proximity(texts, items, 2) and got


# --- licences, secrets, media, toxicity ---------------------------------------


def test_licenses(spark, empty):
    mit = licenses.SENTENCES["mit-grant"] + "\nNoise here. " + licenses.SENTENCES["mit-condition"]
    rows = [(1, "Text. Licensed under the Apache License, Version 2.0.\nMore"), (2, mit), (3, licenses.SENTENCES["mit-condition"] + "\n" + licenses.SENTENCES["mit-grant"]), (4, None), (5, ""), (6, "license"), (None, "LICENSED UNDER CC BY-NC 4.0!")]
    got = {r.doc_id: (r.n_known, r.licenses) for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert got[1] == (1, "Apache-2.0") and got[2][1] == "MIT-text" and got[3][1] == "" and got[3][0] >= 2
    assert got[4] == got[5] == got[6] == (0, "") and got[None] == (1, "CC-BY-NC-4.0")
    assert licenses.license_scan(empty).count() == 0
    known = licenses.known_sentences(licenses.SENTENCES)
    needed = licenses.needed_words(known)
    assert all(any(w in s.split() for w in needed) for s in known)


def test_secret_rows(spark, docs, empty):
    assert secret_scan(docs).count() == docs.count()
    got = secret_scan(frame(spark, [(1, "é token=abcdefgh"), (None, None)])).collect()
    assert {(r.doc_id, r.n_assign, r.spans) for r in got} == {(1, 1, "assign:2:16"), (None, 0, "")}
    assert secret_scan(empty).count() == 0


def test_media(docs, rows, empty):
    got = media_columns(docs).collect()
    want = Counter()
    for i, t in rows:
        payload = pad((t or "").encode())
        want[(i, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({r.payload_sha256 for r in got}) == len({(r.media_sha256, r.feature) for r in got})
    assert media_columns(empty).count() == 0
    assert bytes(decode_png(encode_png(pad(b"abc")))) == pad(b"abc")


def test_media_member_is_fetched_again():
    from fractus.llm.media import RECORD, ArchiveReader

    record = np.array([(1, 5, 3, 10, 3, zlib.crc32(b"abc"))], RECORD)[0]
    answers = [b"xbc", b"abc"]
    assert ArchiveReader._again(lambda offset, size: answers.pop(0), record, "a") == b"abc"
    with pytest.raises(OSError):
        ArchiveReader._again(lambda offset, size: b"", record, "a", attempts=1)


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30) + [" scum them", " scum", " them", ""][i % 4]) for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity(frame(spark, [*rows, (None, None), (900, "")]), labels).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 800 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.9  # a pair of terms decides
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if not r.text}) == 1
    flat = toxicity(docs, labels.limit(0)).select("score").distinct().collect()
    assert len(flat) == 1
    assert toxicity(empty, labels).count() == 0
