"""Language of texts: averaged embeddings of hashed subwords under a linear softmax (operator 12).

A text's subwords are the runs of one to four bytes of its words, the breaks on
either side of a word included; each is hashed to a row of an embedding table.
The mean of the rows goes through a linear softmax. Table and softmax are trained
by stochastic gradient descent in numpy on a bounded sample; a temperature, and
the probability below which a prediction counts as rejected, are set on a part
of the sample that isn't trained on. Texts are scored whole, where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import bounded, slices
from .shingles import buffers, mix
from .storage import materialize

SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
#: Bytes whose subwords are held at once; a longer text goes through in parts.
PART = 1 << 18
#: What a byte counts as: a letter of ASCII in lower case, a byte of any other character, else a break (0).
CODES = np.array([b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 0 for b in range(256)], np.uint64)


def subwords(codes: np.ndarray, starts: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size where the subwords begin (below ``starts``) and their buckets; none has a break but at its ends, or is one."""
    inside = codes != 0
    value = np.zeros(len(codes), np.uint64)
    for n in SIZES:
        count = len(codes) - n + 1
        if count <= 0:
            return
        value = value[:count] * np.uint64(257) + codes[n - 1 :]
        whole = inside[:count] | inside[n - 1 :] if n < 3 else inside[1 : 1 + count]
        for k in range(2, n - 1):
            whole = whole & inside[k : k + count]
        at = np.flatnonzero(whole[:starts])
        yield at, (mix(value[at] + np.uint64(n << 40)) % np.uint64(buckets)).astype(np.int64)


def text_subwords(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The text and the bucket of all subwords of a column's texts, a break on either side of each; ascending by text within an item."""
    data, offsets = buffers(column)
    base, n = int(offsets[0]), len(offsets) - 1
    first = offsets[:-1] - base + np.arange(n)  # of each text's leading break
    codes = np.zeros(int(offsets[-1]) - base + n + 1, np.uint64)
    if n:
        codes[np.arange(len(codes) - n - 1) + np.repeat(np.arange(n), np.diff(offsets)) + 1] = CODES[data[base : int(offsets[-1])]]
    for low in range(0, len(codes), PART):
        high = min(low + PART, len(codes))
        for at, bucket in subwords(codes[low : high + SIZES[-1] - 1], high - low, buckets):
            yield np.searchsorted(first, at + low, "right") - 1, bucket


@dataclass
class Model:
    """``table`` has a row for each bucket, ``weights`` a column for each language; ``temperature`` divides the logits, scores below ``least`` are rejected."""

    langs: list[str]
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def means(self, column: pa.Array, table: np.ndarray) -> np.ndarray:
        """Mean of the table's rows over the subwords of each text; zero without any."""
        total, count = np.zeros((len(column), table.shape[1])), np.zeros(len(column))
        for text, bucket in text_subwords(column, len(table)):
            if len(text):
                cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                total[text[cuts]] += np.add.reduceat(table[bucket], cuts, axis=0, dtype=np.float64)
                count += np.bincount(text, minlength=len(column))
        return total / np.maximum(count, 1)[:, None]

    def table_for_scores(self) -> tuple[np.ndarray, bool]:
        """The narrower of the embeddings and their logits, and whether it is the logits."""
        narrow = self.weights.shape[1] <= self.weights.shape[0]
        return (self.table @ self.weights if narrow else self.table), narrow

    def probabilities(self, column: pa.Array, table: np.ndarray, are_logits: bool) -> np.ndarray:
        mean = self.means(column, table)
        return softmax(((mean if are_logits else mean @ self.weights) + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: list[str], buckets: int, dim: int = 16, epochs: int = 8, rate: float = 0.5, drawn: int = 40, seed: int = 7) -> Model:
    """Stochastic gradient descent over texts (distinct buckets, counts); every other step sees ``drawn`` subwords of a text at most, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    model = Model(langs, rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32), np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    step, steps = 0, epochs * len(texts)
    for _ in range(epochs):
        for k in rng.permutation(len(texts)):
            index, count = texts[k]
            if step % 2 and len(index) > drawn:
                some = rng.integers(0, len(index), drawn)
                index, at = np.unique(index[some], return_index=True)
                count = count[some[at]]
            speed = rate * (1 - step / steps)
            step += 1
            share = (count / max(1, count.sum())).astype(np.float32)
            rows = model.table[index]
            mean = share @ rows
            error = softmax(mean @ model.weights + model.bias)
            error[labels[k]] -= 1
            # Rows share a step of the mean's size: each text moves its mean by the rate, however long it is.
            back = model.weights @ error
            model.table[index] = rows - speed * (share / max(1e-12, float(share @ share)))[:, None] * back
            model.weights -= speed * np.outer(mean, error)
            model.bias -= np.float32(0.1 * speed) * error
    return model


def calibrate(model: Model, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, most_wrong: float, drawn: int = 40, seed: int = 8) -> None:
    """Set the temperature of the least log loss, and the least score above which at most ``most_wrong`` of these predictions are wrong.

    Each text counts whole and with ``drawn`` of its subwords. That one text more
    would be wrong is taken into the loss, so that no score becomes certain.
    """
    if not len(texts):
        return
    rng = np.random.default_rng(seed)
    picked = [rng.choice(i, drawn, p=c / c.sum()) if len(i) else i for i, c in texts]
    logits = np.array([(c / max(1, c.sum())) @ model.table[i] for i, c in texts] + [model.table[i].mean(0) if len(i) else np.zeros(model.table.shape[1]) for i in picked]) @ model.weights + model.bias
    labels = np.concatenate([labels, labels])
    rows, doubt = np.arange(len(labels)), 1 / (len(labels) + 1)
    tried = np.geomspace(0.1, 10, 81)
    losses = []
    for t in tried:
        log = np.log(np.maximum(softmax(logits / t), 1e-12))
        losses.append(-((1 - doubt) * log[rows, labels] + doubt * log.mean(1)).mean())
    model.temperature = float(tried[int(np.argmin(losses))])
    p = softmax(logits / model.temperature)
    score, wrong = p.max(1), p.argmax(1) != labels
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(wrong[order]) <= most_wrong * np.arange(1, len(order) + 1))
    model.least = float(score[order[good[-1]]]) if len(good) else 1.0


def training_sample(docs: DataFrame, sample: int, sample_bytes: int, most_langs: int, buckets: int) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Languages, and the subword counts and languages of a sample of distinct texts, as evenly spread over languages as they allow.

    At most ``sample`` texts of the ``most_langs`` languages with the most
    distinct texts, and as many of them, by a hash, as ``sample_bytes`` hold.
    """
    usable = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("fold"))
    usable = usable.where((F.col("fold") % 4 != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    keys = materialize(usable.select("lang", "h").distinct(), "language-keys")
    counts = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not counts:
        return [], [], np.zeros(0, np.int64)
    quota = max(1, sample // len(counts))
    share = F.least(F.lit(1.0), 2.0 * quota / F.col("count"))
    near = keys.join(F.broadcast(keys.sparkSession.createDataFrame(counts)), "lang")  # at most ``most_langs`` rows
    near = near.withColumn("u", F.xxhash64(F.lit(12), "h")).where(F.pmod("u", F.lit(1 << 32)) < share * float(1 << 32))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "h"))  # about twice the quota a language
    chosen = materialize(near.withColumn("rank", rank).where(F.col("rank") <= quota).select("lang", "h", "u"), "language-sample")
    # One text of each, before its subwords are counted: copies may be very many.
    texts = usable.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h", "u").agg(F.min("text").alias("text"))  # at most ``sample`` rows

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "text", PART):
            sums = [np.zeros(buckets, np.int64) for _ in range(some.num_rows)]
            for text, bucket in text_subwords(some.column("text"), buckets):
                for k in np.unique(text).tolist():
                    sums[k] += np.bincount(bucket[text == k], minlength=buckets)
            there = [np.flatnonzero(s).astype(np.int32) for s in sums]
            packed = [(i.tobytes(), s[i].astype(np.int32).tobytes()) for i, s in zip(there, sums)]
            yield pa.RecordBatch.from_arrays([some.column("lang"), some.column("u"), *(pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1))], ["lang", "u", "buckets", "counts"])

    found = materialize(bounded(texts.select("lang", "u", "text")).mapInArrow(counted, "lang string, u long, buckets binary, counts binary"), "language-subwords")
    sizes = sorted(tuple(r) for r in found.select("u", 2 * F.octet_length("buckets")).collect())
    held = np.cumsum([s for _, s in sizes])
    last = sizes[max(0, int(np.searchsorted(held, sample_bytes, "right")) - 1)][0]
    rows = sorted(found.where(F.col("u") <= last).collect(), key=lambda r: (r.u, r.lang))
    langs = sorted({r.lang for r in rows})
    return langs, [(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int32)) for r in rows], np.array([langs.index(r.lang) for r in rows], np.int64)


def learn(docs: DataFrame, sample: int = 4000, sample_bytes: int = 96 << 20, most_langs: int = 500, buckets: int = 1 << 16, most_wrong: float = 0.01) -> Model | None:
    """A model of the languages of ``docs``; each fifth text of the sample calibrates it. None if there is nothing to learn from."""
    langs, texts, labels = training_sample(docs, sample, sample_bytes, most_langs, buckets)
    if not texts:
        return None
    apart = np.arange(len(texts)) % 5 == 4
    model = train([t for t, a in zip(texts, apart) if not a], labels[~apart], langs, buckets)
    calibrate(model, [t for t, a in zip(texts, apart) if a], labels[apart], most_wrong)
    return model


def identify(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with held_out (boolean), lang_pred (string), score (double) and rejected (boolean).

    held_out: crc32 of the id as text leaves 2 modulo 4; such rows are never
    learnt from, nor are those of null lang or of a text without letters. A null
    id counts as empty text (remainder 0). ``options`` of :func:`learn` bound
    what reaches the driver: at most ``sample`` distinct texts (the subword
    counts of ``sample_bytes`` of them, 8 bytes for each distinct subword), of at most
    ``most_langs`` languages. Null texts and texts without any letter are
    ``und``, with score 0 and rejected; so are all if there is nothing to learn from.
    Other texts get the likeliest learnt language and its calibrated
    probability; rejected are scores below the one above which at most
    ``most_wrong`` of the calibration texts were wrong. Equal texts get equal
    values. Columns of these names are replaced, all others carried along; lang, source and doc_id
    are never inputs of a prediction.
    """
    model = learn(docs, **options)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    docs = docs.drop("held_out", "lang_pred", "score", "rejected").withColumn("held_out", held)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    table, are_logits = model.table_for_scores()
    scorer = Model(model.langs, np.zeros((0, 0)), model.weights, model.bias, model.temperature, model.least)

    @F.arrow_udf("lang string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        parts = [scorer.probabilities(some.column(0), table, are_logits) for some in slices([pa.RecordBatch.from_arrays([texts], ["text"])], 0, PART)]
        p = np.concatenate(parts) if parts else np.zeros((0, len(scorer.langs)))
        best = p.argmax(1)
        return pa.StructArray.from_arrays([pa.array(np.array(scorer.langs, object)[best], pa.string()), pa.array(p[np.arange(len(p)), best])], ["lang", "score"])

    known = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    found = bounded(docs).withColumn("lang_pred", predicted(F.col("text").cast("string")))
    score = F.when(known, F.col("lang_pred.score")).otherwise(0.0)
    return found.withColumns({"score": score, "rejected": ~known | (F.col("lang_pred.score") < model.least), "lang_pred": F.when(known, F.col("lang_pred.lang")).otherwise(UNKNOWN)})
