"""Toxicity by multiple-instance learning: sentences are scored, a document's score is the noisy-or of its sentences.

Only documents carry labels. A sentence's score is a logistic function of hashed features of its words (the word and
its beginnings), and a document is toxic unless none of its sentences is. Screening counts in how many documents of either class a feature occurs; the weights of the features that tell the classes apart are
fitted by maximum likelihood. The labelled documents used are at most a documented number. The same sentence scores then
point to the offending sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from locusframe.llm.byte_words import WORD_BYTES, ByteText, byte_set
from locusframe.llm.common import bounded_batches, held_out, labelled_sample, text_slices

# Lengths in bytes of the word beginnings that are features besides the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 10)
BUCKETS = 1 << 20
_ENDS = byte_set((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F), (0x0A, 0x0A))
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


@dataclass(frozen=True)
class Model:
    """Weight per bucket and bias of a sentence."""

    weights: np.ndarray
    bias: float


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Buckets of all word features of a slice, the running sentence number of each, and the text of each sentence."""
    data = ByteText(texts, lower=True)
    starts, ends = data.words(WORD_BYTES)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    raw = np.cumsum(_ENDS[data.bytes])[starts]
    first = np.flatnonzero(np.diff(raw, prepend=-1))
    sentence = np.cumsum(np.diff(raw, prepend=raw[0]) != 0)
    owner = data.text_of(starts[first])
    hashes, at = [data.hashes(starts, ends)], [sentence]
    for k in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > k)
        hashes.append(data.hashes(starts[longer], starts[longer] + k) + np.uint64(k))
        at.append(sentence[longer])
    buckets = (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)
    return buckets, np.concatenate(at), owner, len(first)


def _screen(labelled: DataFrame, keep: int, support: int) -> list[int]:
    """The ``keep`` features whose share of toxic documents is furthest from chance, over the labelled rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            at = 0
            for part in text_slices(batch.column(0)):
                buckets, sentence, owner, _ = _features(part)
                pairs = np.unique(owner[sentence] * BUCKETS + buckets)
                docs, buckets = pairs // BUCKETS, pairs % BUCKETS
                for y in (0, 1):
                    seen[y] += np.bincount(buckets[toxic[at + docs] == y], minlength=BUCKETS)
                at += len(part)
        found = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[0, found]), pa.array(seen[1, found])], ["bucket", "clean", "toxic"])

    totals = labelled.groupBy("y").count().collect()
    n = {r.y: r["count"] for r in totals}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if not 0 < share < 1:
        return []
    df = F.col("clean") + F.col("toxic")
    surprise = F.abs(F.col("toxic") - df * share) / F.sqrt(df * share * (1 - share) + 1)
    counts = labelled.mapInArrow(count, "bucket long, clean long, toxic long")
    best = (counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(df >= support)
            .select("bucket", surprise.alias("s")).where("s > 3").orderBy(F.desc("s"), "bucket").limit(keep))
    return [r.bucket for r in best.collect()]


def _bags(sample: DataFrame, chosen: list[int]) -> tuple[np.ndarray, ...]:
    """The sample's sentences by their chosen features; a document's other sentences are only counted."""
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, at = batch.column(1).to_pylist(), 0
            for part in text_slices(batch.column(0)):
                buckets, sentence, owner, n = _features(part)
                spot = place[buckets]
                pairs = np.unique(sentence[spot >= 0] * len(chosen) + spot[spot >= 0])
                per_text = np.bincount(owner[pairs // len(chosen)], minlength=len(part))
                offsets = pa.array(np.append(0, np.cumsum(per_text)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pairs // len(chosen), pairs % len(chosen))]
                yield pa.RecordBatch.from_arrays([pa.array(toxic[at : at + len(part)], pa.int64()), pa.array(np.bincount(owner, minlength=len(part))), *lists],
                                                 ["toxic", "sentences", "of", "feature"])
                at += len(part)

    schema = "toxic long, sentences long, of array<int>, feature array<int>"
    rows = sample.mapInArrow(bags, schema).toArrow().combine_chunks()
    y, total = rows["toxic"].to_numpy(), rows["sentences"].to_numpy()
    lists = [pa.chunked_array(rows[c].chunks, pa.list_(pa.int32())) for c in ("of", "feature")]
    sizes = pc.list_value_length(lists[0]).to_numpy().astype(np.int64)
    of, feature = (pc.list_flatten(x).to_numpy().astype(np.int64) for x in lists)
    doc = np.repeat(np.arange(len(y)), sizes)
    pair = np.unique(doc * (1 << 40) + of % (1 << 40), return_inverse=True)
    return y, total, pair[0] >> 40, pair[1], feature


def _fit(y, total, doc, of, feature, n_features: int, rounds: int, decay: float) -> tuple[np.ndarray, float]:
    """Maximum likelihood of the noisy-or by Adam on all sentences of the sample."""
    theta = np.zeros(n_features + 1)
    theta[-1] = -5.0
    plain = total - np.bincount(doc, minlength=len(y))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = np.bincount(of, theta[feature], len(doc)) + theta[-1]
        risk = np.bincount(doc, np.logaddexp(0, z), len(y)) + plain * np.logaddexp(0, theta[-1])
        d_risk = np.where(y == 1, -1 / np.expm1(np.maximum(risk, 1e-3)), 1.0) / len(y)
        d_z = d_risk[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, d_z[of], n_features), d_z.sum() + (d_risk * plain).sum() / (1 + np.exp(-theta[-1])))
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = 40_000, keep: int = 4096, support: int = 4, rounds: int = 300,
          decay: float = 1e-5) -> Model:
    """Fit on the labelled rows that aren't held out.

    At most ``sample`` of them are used (see ``labelled_sample``). Without labelled rows of both classes every sentence
    scores 0.
    """
    rows = labelled_sample(docs, labels, "toxic", sample)
    chosen = _screen(rows, keep, support)
    weights = np.zeros(BUCKETS, np.float32)
    if not chosen:
        return Model(weights, -30.0)
    bags = _bags(rows, chosen)
    weights[chosen], bias = _fit(*bags, len(chosen), rounds, decay)
    return Model(weights, bias)


def _sentence_risks(weights: np.ndarray, bias: float, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """-log(1 - score) of every sentence with words, and the text that it belongs to."""
    buckets, sentence, owner, n = _features(texts)
    used = np.flatnonzero(weights[buckets])
    pairs = np.unique(sentence[used] * BUCKETS + buckets[used])
    z = np.bincount(pairs // BUCKETS, weights[pairs % BUCKETS], n) + bias
    return np.logaddexp(0, z), owner


def _shared(docs: DataFrame, model: Model):
    """The model for the workers, as plain values: BUCKETS weights, whatever the data."""
    return bounded_batches(docs).sparkSession.sparkContext.broadcast((model.weights, model.bias))


def scorer(docs: DataFrame, model: Model):
    """A function from a text column to the toxicity score of the whole text; texts without words score 0."""
    shared = _shared(docs, model)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = []
        for part in text_slices(texts):
            risk, owner = _sentence_risks(*shared.value, part)
            out.append(1 - np.exp(-np.bincount(owner, risk, len(part))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def _judge(docs: DataFrame, model: Model, threshold: float):
    """A function from a text column to its score, its number of offending sentences, and the place of the worst one."""
    shared = _shared(docs, model)

    @arrow_udf("score double, offending long, worst_sentence long")
    def judge(texts: pa.Array) -> pa.Array:
        score, offending, worst = [np.zeros(0)], [np.zeros(0, np.int64)], []
        for part in text_slices(texts):
            risk, owner = _sentence_risks(*shared.value, part)
            score.append(1 - np.exp(-np.bincount(owner, risk, len(part))))
            hot = 1 - np.exp(-risk) >= threshold
            offending.append(np.bincount(owner[hot], minlength=len(part)))
            first = np.searchsorted(owner, np.arange(len(part) + 1))
            worst += [int(np.argmax(risk[a:b])) if n else None for a, b, n in zip(first, first[1:], offending[-1])]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(score)), pa.array(np.concatenate(offending)), pa.array(worst, pa.int64())],
                                          ["score", "offending", "worst_sentence"])

    return judge


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Score every text: ``doc_id, held_out, score, predicted, offending, worst_sentence``.

    ``offending`` sentences score ``threshold`` or more by themselves, and ``worst_sentence`` is the place (from 0, among sentences with words) of
    the highest score where there are any, else null. A null text or one without words has no sentences and scores 0. Repeated rows and ids give a
    row each; other columns are ignored.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), _judge(docs, model, threshold)(F.col("text")).alias("_j"))
    return rows.select("doc_id", "held_out", "_j.score", (F.col("_j.score") >= threshold).cast("int").alias("predicted"), "_j.offending", "_j.worst_sentence")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The sentences that score ``threshold`` or more: ``doc_id, sentence (from 0), start, score, text``.

    Sentences end at ``. ! ?`` and line ends; ``start`` counts code points.
    """
    shared = _shared(docs, model)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, rows = batch.column(0), 0, []
            for part in text_slices(batch.column(1)):
                risk, owner = _sentence_risks(*shared.value, part)
                hot = np.flatnonzero(1 - np.exp(-risk) >= threshold)
                first = np.searchsorted(owner, np.arange(len(part)))
                for i in np.unique(owner[hot]):
                    spans = [m for m in SENTENCE.finditer(part[i]) if re.search(r"[0-9A-Za-z\u0080-\U0010ffff]", m[0])]
                    for s in hot[owner[hot] == i]:
                        m = spans[s - first[i]]
                        rows.append((ids[at + int(i)].as_py(), int(s - first[i]), m.start(), float(1 - np.exp(-risk[s])), m[0].strip()))
                at += len(part)
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (
                pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()))], ["doc_id", "sentence", "start", "score", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(locate, "doc_id long, sentence long, start long, score double, text string")
