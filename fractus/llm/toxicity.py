"""Toxicity by a factorization machine over hashed terms (operator 5).

Terms are the distinct words of a text and their first bytes (three lengths, so
that inflected forms meet), hashed. The machine adds to linear weights the
products of latent vectors of all pairs of terms, so that two terms that are
harmless alone can weigh together. It is fitted on a bounded sample of labelled
texts in a task, and the driver gets its weights alone; all texts are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import bounded, slices
from .shingles import term_hashes
from .storage import discard, materialize

#: Everything in ASCII that isn't a letter ends a word.
BREAKS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
PREFIXES = (4, 5, 6)
#: Bytes of text whose terms a task holds at once; a longer text is taken alone.
BATCH = 1 << 20


def terms_of(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all texts, with repeats, and the text that each belongs to."""
    arrays, ends = term_hashes(column, BREAKS, PREFIXES)
    text = np.repeat(np.arange(len(column)), np.diff(ends))
    terms, texts = [], []
    for k, hashes in enumerate(arrays):
        there = slice(None) if k == 0 else hashes != 0
        terms.append((hashes[there] % np.uint64(buckets)).astype(np.int64))
        texts.append(text[there])
    return np.concatenate(terms), np.concatenate(texts)


@dataclass
class Machine:
    """Weights of hashed terms (sorted); texts are sets of terms."""

    buckets: int
    terms: np.ndarray
    bias: float
    linear: np.ndarray
    latent: np.ndarray

    def margin(self, index: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Bias, weights and pair products of ``n`` texts; (text, index) are distinct and sorted by text."""
        out = np.full(n, self.bias)
        if len(index):
            out += np.bincount(text, self.linear[index], n)
            for f in range(self.latent.shape[1]):
                v = self.latent[index, f]
                out += 0.5 * (np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n))
        return out

    def scores(self, column: pa.Array, place: np.ndarray) -> np.ndarray:
        term, text = terms_of(column, self.buckets)
        index = place[term]
        known = index >= 0
        pair = np.unique(text[known] * len(self.terms) + index[known]) if known.any() else np.zeros(0, np.int64)
        width = max(1, len(self.terms))
        return 1 / (1 + np.exp(-np.clip(self.margin(pair % width, pair // width, len(column)), -40, 40)))

    def places(self) -> np.ndarray:
        """Index of each bucket's weights, -1 where it has none."""
        out = np.full(self.buckets, -1, np.int32)
        out[self.terms] = np.arange(len(self.terms))
        return out


def shares_of_terms(terms: list[np.ndarray], labels: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All terms of at least three texts, sorted, and by how much each counts, between 0 and 1.

    A term's evidence g is the likelihood ratio of its presence in both classes.
    Of p terms that mean nothing the most telling one reaches about ln p by
    chance (the universal threshold), so a term counts by g^2 / (g^2 + ln(p)^2):
    fully far above that, hardly below.
    """
    none = [np.zeros(0, np.int32)]
    both = np.bincount(np.concatenate(none + terms), minlength=buckets)  # the terms of a text are distinct
    yes = np.bincount(np.concatenate(none + [t for t, label in zip(terms, labels.tolist()) if label]), minlength=buckets)
    values = np.flatnonzero(both >= 3)
    yes, no = yes[values], both[values] - yes[values]
    n_no, n_yes = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    p, q = (yes + 0.5) / (n_yes + 1), (no + 0.5) / (n_no + 1)
    base = (yes + no + 1) / (n_yes + n_no + 2)
    gain = n_yes * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base))) + n_no * (q * np.log(q / base) + (1 - q) * np.log((1 - q) / (1 - base)))
    gain = np.maximum(gain, 0.0) ** 2
    return values, gain / (gain + max(1.0, np.log(max(1, len(values)))) ** 2)


def fit(terms: list[np.ndarray], labels: np.ndarray, buckets: int, factors: int = 4, epochs: int = 20, least_steps: int = 600, batch: int = 128, rate: float = 0.02, decay: float = 2e-5, seed: int = 17) -> Machine:
    """Adam on the logistic loss, over weights that count by :func:`shares_of_terms`. Without both classes the machine is the smoothed base rate alone."""
    n, positive = len(labels), int(labels.sum())
    bias = float(np.log((positive + 1) / (n - positive + 1)))
    if positive in (0, n):
        return Machine(buckets, np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, factors)))
    chosen, share = shares_of_terms(terms, labels, buckets)
    place = np.full(buckets, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    sets = [x[x >= 0] for x in (place[t] for t in terms)]
    del place
    rng = np.random.default_rng(seed)
    machine = Machine(buckets, chosen, bias, np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), factors)) * share[:, None])
    moments = [np.zeros_like(machine.linear), np.zeros_like(machine.linear), np.zeros_like(machine.latent), np.zeros_like(machine.latent), 0.0, 0.0]
    how = (share, share[:, None], 1.0)  # Adam's steps know no scale: a weight moves by its share of one
    step = 0
    for _ in range(max(epochs, -(-least_steps * batch // n))):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            sizes = np.array([len(sets[r]) for r in rows])
            index, text = np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
            some, starts = sizes > 0, (np.cumsum(sizes) - sizes)[sizes > 0]  # texts without terms have no stretch to sum
            latent, sums, margin = machine.latent[index], np.zeros((len(rows), factors)), np.full(len(rows), machine.bias)
            if len(index):
                sums[some] = np.add.reduceat(latent, starts)
                margin[some] += np.add.reduceat(machine.linear[index] - 0.5 * np.einsum("ij,ij->i", latent, latent), starts)
                margin += 0.5 * np.einsum("ij,ij->i", sums, sums)
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[rows]) / len(rows)
            # A term's gradient: the errors of its texts times the sums of their other terms.
            each, weighted = error[text], error[:, None] * sums
            g_linear = np.bincount(index, each, len(chosen))
            g_latent = decay * machine.latent - g_linear[:, None] * machine.latent
            for f in range(factors):
                g_latent[:, f] += np.bincount(index, weighted[:, f][text], len(chosen))
            g_linear += decay * machine.linear
            step += 1
            correct = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, (name, grad) in enumerate((("linear", g_linear), ("latent", g_latent), ("bias", error.sum()))):
                moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * grad
                moments[2 * k + 1] = 0.999 * moments[2 * k + 1] + 0.001 * grad**2
                setattr(machine, name, getattr(machine, name) - how[k] * (rate * correct) * moments[2 * k] / (np.sqrt(moments[2 * k + 1]) + 1e-8))
    return machine


def sampled_terms(docs: DataFrame, labels: DataFrame, sample: int, buckets: int, most_bytes: int = 96 << 20) -> tuple[DataFrame, DataFrame]:
    """(doc_id, toxic, terms) of labelled texts that aren't held out, distinct hashed terms as int32, and the written table that it is read from.

    Texts are taken by the order of a hash of their ids: at most ``sample`` and ``most_bytes`` of terms, but one text at least.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    usable = usable.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taken = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(taken), "doc_id")  # at most ``sample`` rows
    # Rows may repeat an id, even very often: one text of each, so that the bound holds.
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 2, BATCH):
            term, text = terms_of(some.column(2), buckets)
            pair = np.unique(text * buckets + term)
            text, term = pair // buckets, (pair % buckets).astype(np.int32)
            cuts = np.searchsorted(text, np.arange(some.num_rows + 1))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([term[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], ["doc_id", "toxic", "terms"])

    found = materialize(bounded(texts).mapInArrow(hashed, "doc_id long, toxic int, terms binary"), "toxic-terms")
    # At most ``sample`` sizes in a row: texts are taken while those before them are within the bound.
    before = F.sum(F.octet_length("terms")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = found.select("doc_id", before.alias("held"), F.octet_length("terms").alias("own")).where(f"held <= {most_bytes} OR held = own").select("doc_id")
    return found.join(F.broadcast(within), "doc_id").select("doc_id", "toxic", "terms"), found


def training_sample(docs: DataFrame, labels: DataFrame, sample: int, buckets: int, most_bytes: int = 96 << 20) -> tuple[list[np.ndarray], np.ndarray]:
    """:func:`sampled_terms` and their labels on the driver, by id, to look at."""
    some, found = sampled_terms(docs, labels, sample, buckets, most_bytes)
    rows = sorted(some.collect())
    discard(found)
    return [np.frombuffer(r[2], np.int32) for r in rows], np.array([1 if r[1] else 0 for r in rows], np.int64)


def learnt(docs: DataFrame, labels: DataFrame, sample: int, buckets: int, most_bytes: int) -> Machine:
    """The machine fitted on :func:`sampled_terms` in one task, as the sample is bounded: the driver, which also holds all plans, gets no terms of it."""
    some, found = sampled_terms(docs, labels, sample, buckets, most_bytes)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, sizes, classes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in (b for b in batches if b.num_rows):
            held = pc.fill_null(batch.column(2), b"").cast(pa.large_binary())
            ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
            if ends[-1] > ends[0]:
                stretches.append(np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.int32))  # the batch goes
            sizes.append(np.diff(ends) // 4)
            classes.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) != 0)
        terms, sizes = np.concatenate(stretches), np.concatenate(sizes)
        del stretches
        machine = fit(np.split(terms, np.cumsum(sizes)[:-1]) if len(sizes) else [], np.concatenate(classes).astype(np.int64), buckets)
        arrays = [pa.array([a.tobytes()], pa.binary()) for a in (machine.terms, machine.linear, machine.latent)]
        bias = pa.array([machine.bias], pa.float64())
        del terms, machine
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks
        yield pa.RecordBatch.from_arrays([bias, *arrays], ["bias", "terms", "linear", "latent"])

    rows = bounded(some).coalesce(1).sortWithinPartitions("doc_id").mapInArrow(fitted, "bias double, terms binary, linear binary, latent binary").collect()
    discard(found)
    if not rows:  # a table without partitions
        return fit([], np.zeros(0, np.int64), buckets)
    (one,) = rows
    terms, linear, latent = np.frombuffer(one.terms, np.int64), np.frombuffer(one.linear), np.frombuffer(one.latent)
    return Machine(buckets, terms, one.bias, linear, latent.reshape(len(terms), len(latent) // max(1, len(terms))))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12_000, buckets: int = 1 << 20, sample_bytes: int = 96 << 20) -> DataFrame:
    """``docs`` with held_out (boolean), score (double, 0 to 1) and predicted (int, 1 from 0.5 up).

    held_out: crc32 of the id as text is divisible by 5; such rows are never
    learnt from. The machine is fitted on at most ``sample`` labelled texts and
    ``sample_bytes`` of their hashed terms (4 bytes each; the bound of what the one
    task that fits it reads; the driver gets the weights, at most 48 bytes for each of
    ``buckets``), over all terms of three texts or more. Each counts by what it
    tells beyond chance (:func:`shares_of_terms`), so that rare ones add no noise.
    Null and empty texts get the score of no terms; equal texts equal scores. A
    null id is held out (its text counts as empty, whose crc32 is 0). Without labels, or with one
    class alone, every score is the smoothed base rate. Rows that repeat an id
    are scored each by its text. Columns of these names are replaced; all
    others are carried along but are never inputs of the score.
    """
    machine = learnt(docs, labels, sample, buckets, sample_bytes)
    place: list[np.ndarray] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not place:
            place.append(machine.places())
        parts = [machine.scores(some.column(0), place[0]) for some in slices([pa.RecordBatch.from_arrays([texts], ["text"])], 0, BATCH)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    del place[:]
    out = docs.drop("held_out", "score", "predicted").withColumn("score", score(F.col("text").cast("string")))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return out.withColumns({"held_out": held, "predicted": F.when(F.col("score") >= 0.5, 1).otherwise(0)})
