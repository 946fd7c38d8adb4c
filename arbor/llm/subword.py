"""Supervised subword embeddings: hashed vectors of words, word pairs and character n-grams, averaged per document, with a softmax output.

The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. As the output is linear
in the averaged vectors, the learned vectors and output weights are folded into one score per feature and class; a text is
then scored by looking up all of its words and n-grams and averaging, in fixed point so that equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbor.llm import textbytes as tb
from arbor.llm.common import fresh, quoted, ship

U64 = np.uint64
FIXED = 2.0**20


@dataclass(frozen=True)
class SubwordTraining:
    """rows: bound of the labelled sample; longest: texts of more bytes aren't learned from; buckets: feature vectors; grams: lengths
    of character n-grams."""

    rows: int = 3000
    longest: int = 1 << 15
    buckets: int = 1 << 16
    dims: int = 16
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 6
    rate: float = 0.5
    seed: int = 11


@dataclass
class SubwordModel:
    """classes: values in order; scores: (buckets, classes) in fixed point; bias: logits of a text without features."""

    classes: list[str]
    scores: np.ndarray
    bias: np.ndarray
    grams: tuple[int, ...]


def features(data: np.ndarray, offsets: np.ndarray, grams: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features in turn, each as (buckets of the features in order, number in each document).

    Words are folded. A pair of neighbouring words is hashed in order, but all pairs of a word with itself share one vector,
    whatever the word. N-grams are of UTF-8 characters as they stand within a document, which may be of any length: they come
    in blocks.
    """
    shift = U64(64 - int(buckets).bit_length() + 1)
    words, n = tb.word_hashes(data, offsets)
    yield (words >> shift).astype(np.int64), n
    last = np.zeros(len(words), dtype=bool)
    last[np.cumsum(n)[n > 0] - 1] = True
    left, right = words[:-1][~last[:-1]], words[1:][~last[:-1]]
    yield (tb.mix(np.where(left == right, U64(0), left * U64(3) + right) + U64(1)) >> shift).astype(np.int64), np.maximum(n - 1, 0)
    docs, size, ahead = len(offsets) - 1, len(data), 4 * max(grams, default=0)
    for lo in range(0, size, tb.BLOCK):
        hi = min(lo + tb.BLOCK, size)
        part = data[lo : min(hi + ahead, size)]
        begins = (part & 0xC0) != 0x80
        inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, lo + len(part))] - lo
        begins[inner] = True  # a document begins with a character, whatever its bytes
        start = np.append(np.flatnonzero(begins), len(part))
        doc = np.searchsorted(offsets, start[:-1] + lo, side="right") - 1
        power, inverse = tb.powers(len(part))
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(tb.BYTE_CODE[part] * power[: len(part)], out=total[1:])
        mine = int(np.searchsorted(start[:-1], hi - lo))  # those that begin here; what follows only ends them
        for g in grams:
            m = max(0, min(mine, len(start) - g))
            ok = doc[:m] == doc[g - 1 : g - 1 + m]
            s, e, d = start[:m][ok], start[g : g + m][ok], doc[:m][ok]
            yield (tb.mix((total[e] - total[s]) * inverse[s] + U64(g)) >> shift).astype(np.int64), np.bincount(d, minlength=docs)


def train(texts: list[str], labels: list[str], p: SubwordTraining | None = None) -> SubwordModel:
    """A model of labelled texts; with fewer than two classes every text gets the only class (or none) with certainty."""
    p = p or SubwordTraining()
    classes = sorted(set(labels))
    if len(classes) < 2:
        return SubwordModel(classes, np.zeros((p.buckets, len(classes)), dtype=np.int64), np.zeros(len(classes)), p.grams)
    rng = np.random.default_rng(p.seed)
    target = np.array([classes.index(x) for x in labels])
    # features of all texts in two large arrays, which go back to the system when they are freed
    kinds_of, share_of, ends = np.empty(1 << 20, dtype=np.uint16 if p.buckets <= 1 << 16 else np.int32), np.empty(1 << 20, dtype=np.float32), [0]
    for t in texts:
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        ids = np.concatenate([f for f, _ in features(raw, np.array([0, len(raw)]), p.grams, p.buckets)])
        kinds, n = np.unique(ids, return_counts=True)
        ends.append(ends[-1] + len(kinds))
        while ends[-1] > len(kinds_of):
            kinds_of, share_of = (np.concatenate([x, np.empty_like(x)]) for x in (kinds_of, share_of))
        kinds_of[ends[-2] : ends[-1]], share_of[ends[-2] : ends[-1]] = kinds, n / max(1, len(ids))
    vectors = rng.uniform(-1 / p.dims, 1 / p.dims, (p.buckets, p.dims)).astype(np.float32)
    output = np.zeros((len(classes), p.dims), dtype=np.float32)
    prior = np.bincount(target, minlength=len(classes)) / len(target)
    bias = np.log(prior).astype(np.float32)
    steps, done = p.epochs * len(texts), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(texts)):
            ids, w = kinds_of[ends[i] : ends[i + 1]], share_of[ends[i] : ends[i + 1], None]
            rate = p.rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            mean = (vectors[ids] * w).sum(axis=0)
            z = output @ mean + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[target[i]] -= 1
            back = output.T @ error
            output -= rate * np.outer(error, mean)
            vectors[ids] -= (rate * len(ids) ** 0.5) * w * back
    return SubwordModel(classes, np.rint(vectors @ output.T * FIXED).astype(np.int64), bias.astype(np.float64), p.grams)


def logits(model: SubwordModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, classes) logits."""
    docs, k = len(offsets) - 1, len(model.classes)
    sums, total = np.zeros((docs, k), dtype=np.int64), np.zeros(docs, dtype=np.int64)
    diff = np.ascontiguousarray(model.scores[:, 1:] - model.scores[:, :1]) if k else model.scores
    for ids, n in features(data, offsets, model.grams, len(model.scores)):
        has = np.flatnonzero(n)
        total += n
        if len(has):
            begins = (np.cumsum(n) - n)[has]
            for c in range(k - 1):
                sums[has, c + 1] += np.add.reduceat(diff[:, c][ids], begins)
    return sums / FIXED / np.maximum(total, 1)[:, None] + model.bias


def probabilities(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _scoring(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: SubwordModel = shared.value
        k = len(model.classes)
        for batch in batches:
            data, offs = tb.buffers(batch.column(batch.num_columns - 1))
            found, words = [np.zeros((0, k))], [np.zeros(0, dtype=np.int64)]
            for lo, hi in tb.spans(offs, tb.BLOCK):
                part, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                found.append(probabilities(logits(model, part, at)) if k else np.zeros((hi - lo, 0)))
                inside = np.zeros(len(part) + 1, dtype=bool)
                inside[:-1] = tb.WORD_BYTE[part]
                begin = inside.copy()
                begin[1:] &= ~inside[:-1]
                begin[at[:-1]] = inside[at[:-1]]
                total = np.concatenate([[0], np.cumsum(begin)])
                words.append(total[at[1:]] - total[at[:-1]])
            p = np.concatenate(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(np.concatenate(words))], names=[*batch.schema.names[:-1], "posterior", "n_words"])

    return score


def predict(docs: DataFrame, model: SubwordModel, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: all of ``docs``) with posterior array<double> in the order of the model's classes, and
    n_words; columns of these names are replaced. A null text counts as empty; an empty text gets the shares of the classes
    among the labels.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("posterior", "n_words")]
    text = fresh(docs, "subword_text")
    inner = docs.select(*map(quoted, kept), quoted(text_col).cast("string").alias(text))
    schema = type(inner.schema)([f for f in inner.schema if f.name != text]).add("posterior", T.ArrayType(T.DoubleType())).add("n_words", "long")
    return inner.mapInArrow(_scoring(shared), schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, label: str, text_col: str = "text", p: SubwordTraining | None = None) -> tuple[list[str], list[str]]:
    """(texts, labels) of about ``p.rows`` labelled documents, at most twice as many, chosen by a hash of the id.

    labels(id, label): null ids and labels are left out; the sampled labels are bounded and so can be broadcast. Rows come
    in a fixed order. Documents with a null text count as empty; those of more than ``p.longest`` bytes are left out.
    """
    rows, seed, longest = (p := p or SubwordTraining()).rows, p.seed, p.longest
    known = labels.select(quoted(id_col).alias("id"), quoted(label).cast("string").alias("label")).where("id is not null and label is not null").distinct()
    n = known.count()
    if not n:
        return [], []
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
    chosen = known.where(u < min(1_000_000, -(-1_000_000 * rows // n))).orderBy(F.xxhash64("id", F.lit(seed)), "id", "label").limit(2 * rows)
    text = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    taken = text.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id", F.lit(seed)), "id", "label", F.xxhash64("text")).limit(2 * rows).collect()
    return [r["text"] for r in taken], [r["label"] for r in taken]
