"""The factorization machine against sums written out."""

import numpy as np
import pyarrow as pa
import pytest

from fractus.llm import toxicity as toxicity_module
from fractus.llm.secrets import Rule, Scanner
from fractus.llm.toxicity import BREAKS, PREFIXES, Machine, fit, shares_of_terms, terms_of, training_sample
from fractus.llm.shingles import term_hashes

BUCKETS = 1 << 16
TEXTS = ["you awful people", "People, awful people!", "", None, "kind words for everyone", "\u00e9t\u00e9 \u6771\u4eac awful", "a" * 5000, "kindness kindly kin"]


def brute_terms(text):
    """Hashed words of a text and their first 4, 5 and 6 bytes where they are longer, as a set."""
    words, now = [], bytearray()
    for b in (text or "").encode() + b" ":
        if BREAKS[b]:
            words += [bytes(now)] if now else []
            now = bytearray()
        else:
            now.append(b)
    out = set()
    for w in words:
        (whole, *parts), _ = term_hashes(pa.array([w], pa.binary()).cast(pa.large_binary()).view(pa.large_string()), BREAKS, PREFIXES)
        out.add(int(whole[0]) % BUCKETS)
        out |= {int(h[0]) % BUCKETS for h, n in zip(parts, PREFIXES) if len(w) > n}
    return out


def test_terms():
    term, text = terms_of(pa.array(TEXTS, pa.large_string()), BUCKETS)
    for i, t in enumerate(TEXTS):
        assert set(term[text == i].tolist()) == brute_terms(t)


def test_scores_are_the_sums_over_all_pairs():
    rng = np.random.default_rng(3)
    chosen = np.array(sorted(set().union(*map(brute_terms, TEXTS)))[::2])
    machine = Machine(BUCKETS, chosen, -0.3, rng.normal(size=len(chosen)), rng.normal(size=(len(chosen), 4)))
    got = machine.scores(pa.array(TEXTS, pa.large_string()), machine.places())
    for t, score in zip(TEXTS, got):
        at = [i for i, c in enumerate(chosen.tolist()) if c in brute_terms(t)]
        margin = -0.3 + sum(machine.linear[i] for i in at) + sum(machine.latent[i] @ machine.latent[j] for i in at for j in at if i < j)
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def test_a_pair_is_learnt():
    """Two terms that say nothing alone: toxic is the text that has both."""
    rng = np.random.default_rng(5)
    both = rng.integers(0, 2, (2000, 2)).astype(bool)
    terms = [np.array(sorted({*rng.integers(10, 40, 5).tolist(), *([1] if a else []), *([2] if b else [])})) for a, b in both]
    labels = (both[:, 0] ^ both[:, 1]).astype(int)  # no linear weights give this
    machine = fit(terms, labels, 64, rate=0.05, epochs=60)
    index = np.concatenate([np.searchsorted(machine.terms, t[np.isin(t, machine.terms)]) for t in terms])
    text = np.repeat(np.arange(len(terms)), [np.isin(t, machine.terms).sum() for t in terms])
    right = ((machine.margin(index, text, len(terms)) > 0) == labels).mean()
    assert {1, 2} <= set(machine.terms.tolist()) and right > 0.95


def test_shares_of_terms():
    """Every term of three texts counts, the more the more it tells of the class; none is left out."""
    rng = np.random.default_rng(4)
    labels = np.repeat([0, 1], 300)
    terms = [np.unique(np.r_[rng.integers(10, 400, 8), [1] if y else [2], 5, 6 if i < 2 else 5]) for i, y in enumerate(labels)]
    values, share = shares_of_terms(terms, labels, 512)
    of = dict(zip(values.tolist(), share.tolist()))
    assert 6 not in of and set(of) == {t for t in range(512) if sum(t in x for x in terms) >= 3}
    assert of[1] > 0.99 and of[2] > 0.99 and of[5] < 1e-6 and max(v for t, v in of.items() if t >= 10) < 0.75
    assert np.median([v for t, v in of.items() if t >= 10]) < 0.05


def test_gradient_is_that_of_the_loss():
    """One step of Adam moves each weight against the sign of the numeric gradient."""
    rng = np.random.default_rng(6)
    terms = [np.unique(rng.integers(0, 6, rng.integers(0, 5))) for _ in range(64)]
    labels = rng.integers(0, 2, 64)
    start = fit(terms, labels, 8, factors=2, epochs=1, least_steps=1, batch=64, rate=0.0, decay=0.0)
    moved = fit(terms, labels, 8, factors=2, epochs=1, least_steps=1, batch=64, rate=1e-3, decay=0.0)
    at = [np.searchsorted(start.terms, t) for t in terms]

    def loss(linear, latent):
        margin = np.array([start.bias + linear[i].sum() + sum(latent[a] @ latent[b] for a in i for b in i if a < b) for i in at])
        return np.mean(np.logaddexp(0, margin) - labels * margin)

    for name in ("linear", "latent"):
        old, new = getattr(start, name), getattr(moved, name)
        for k in np.ndindex(old.shape):
            up, down = ({n: getattr(start, n).copy() for n in ("linear", "latent")} for _ in range(2))
            up[name][k] += 1e-5
            down[name][k] -= 1e-5
            slope = (loss(**up) - loss(**down)) / 2e-5
            if abs(slope) > 1e-5:
                assert np.sign(new[k] - old[k]) == -np.sign(slope)


def test_sample_is_bounded_in_bytes(spark):
    """Texts of 20,000 words: few fit the bound, a single one always does."""
    words = [" ".join(f"w{i}x{j}" for j in range(20_000)) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    every, _ = training_sample(docs, labels, 100, 1 << 20)
    size = max(len(t) for t in every) * 4
    some, _ = training_sample(docs, labels, 100, 1 << 20, 2 * size + size // 2)
    one, y = training_sample(docs, labels, 100, 1 << 20, 10)
    assert len(every) > 2 and len(some) == 2 and len(one) == len(y) == 1


def test_fitted_in_a_task(spark, monkeypatch):
    """The driver gets weights, not the sample; they are those that the sample gives."""
    texts = [f"{'awful' if i % 3 == 0 else 'kind'} people {i % 7} of word{i % 5}" for i in range(300)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(302)], "doc_id long, toxic int")
    machine = fit(*training_sample(docs, labels, 12_000, 1 << 20), 1 << 20)
    want = machine.scores(pa.array(texts, pa.large_string()), machine.places())

    def here(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(toxicity_module, "shares_of_terms", here)  # workers have a module of their own
    got = toxicity_module.toxicity(docs, labels).select("doc_id", "score").collect()
    assert {r.doc_id: r.score for r in got} == dict(enumerate(want.tolist()))


def test_more_rules_than_bytes_have_bits():
    rules = tuple(Rule(f"k{i}", f"word{i}!") for i in range(20))
    found = Scanner(rules).scan([" ".join(f"word{i}!" for i in range(20))])[0]
    assert [k for _, k, _ in found] == list(range(20))
    with pytest.raises(ValueError):
        Scanner(rules * 4)
