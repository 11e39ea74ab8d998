"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of words), and only documents carry labels. Every passage becomes a vector of
shares: hashed triples of character kinds, hashed words, and how words repeat and look. A layer encodes it, gated attention
gives it a weight within its document, and the document's score is a logistic function of the weighted mean of its encoded
passages. All layers are fitted together from document labels on a sample of labelled documents of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from locusframe.llm.byte_words import INK_BYTES, ByteText
from locusframe.llm.common import bounded_batches, held_out, labelled_sample, materialise, text_slices

PASSAGE_WORDS = 64
KINDS, WORDS, LOOKS = 256, 256, 8
WIDTH = KINDS + WORDS + LOOKS
HIDDEN, GATE = 48, 24

Params = dict[str, np.ndarray]


def _byte_kinds() -> np.ndarray:
    """Lower case 1, upper case 2, digits 3, blanks 4, line ends 5, parts of longer characters 6, any other byte on its own."""
    kind = np.arange(16, 272, dtype=np.uint32)
    for k, (a, b) in enumerate(((0x61, 0x7A), (0x41, 0x5A), (0x30, 0x39), (0x20, 0x20), (0x0A, 0x0D), (0x80, 0xFF)), 1):
        kind[a : b + 1] = k
    return kind


_KIND = _byte_kinds()


def _shares(index: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """Square roots of the share of each of ``size`` values among those of each owner."""
    counts = np.bincount(owner * size + index, minlength=n * size).reshape(n, size).astype(np.float32)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of a slice (as bytes, 255 = 1) and the text of each; a text without words has one of zeros."""
    data = ByteText(texts, lower=False)
    starts, ends = data.words(INK_BYTES)
    text = data.text_of(starts) if len(starts) else np.zeros(0, np.int64)
    first = np.searchsorted(text, np.arange(len(texts)))
    word_no = np.arange(len(starts)) - first[text]
    count = np.bincount(text, minlength=len(texts))
    bags = np.maximum(1, -(-count // PASSAGE_WORDS))
    owner = np.repeat(np.arange(len(texts)), bags)
    base = np.concatenate([[0], np.cumsum(bags)])[:-1]
    n = len(owner)
    passage = base[text] + word_no // PASSAGE_WORDS
    out = np.zeros((n, WIDTH), np.float32)
    if len(starts):
        kinds = _KIND[data.bytes]
        triple = kinds[:-2] * np.uint32(2654435761) + kinds[1:-1] * np.uint32(40503) * np.uint32(65599) + kinds[2:] * np.uint32(2246822519)
        triple = ((triple ^ (triple >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(24)
        # a byte belongs to the passage of the last word that began before it
        begins = np.zeros(len(triple), np.int32)
        begins[starts[starts < len(triple)]] = 1
        spot = np.cumsum(begins) - 1
        inside = spot >= 0
        for k in (1, 2):  # no triple reaches into the next text
            inside[data.starts[1:] - k] = False
        out[:, :KINDS] = _shares(triple[inside].astype(np.int64), passage[spot[inside]], n, KINDS)
        h = data.hashes(starts, ends)
        out[:, KINDS : KINDS + WORDS] = _shares((h % np.uint64(WORDS)).astype(np.int64), passage, n, WORDS)
        size = (ends - starts).astype(np.float32)
        words = np.maximum(np.bincount(passage, minlength=n), 1)
        last, head = data.bytes[ends - 1], data.bytes[starts]
        as_before = np.append(False, (h[1:] == h[:-1]) & (passage[1:] == passage[:-1]))
        distinct = np.bincount(np.unique(passage.astype(np.uint64) << np.uint64(40) ^ (h >> np.uint64(24))) >> np.uint64(40), minlength=n)
        looks = (as_before, size <= 3, size > 12, (last < 0x30) | ((last > 0x39) & (last < 0x41)) | (last > 0x7A) & (last < 0x80),
                 (head >= 0x41) & (head <= 0x5A), (last >= 0x41) & (last <= 0x5A))
        for k, flag in enumerate(looks):
            out[:, KINDS + WORDS + k] = np.bincount(passage, flag, n) / words
        out[:, -2] = distinct[:n] / words
        out[:, -1] = np.minimum(1, np.bincount(passage, size, n) / words / 32)
    return np.rint(out * 255).astype(np.uint8), owner


def _start(rng: np.random.Generator) -> Params:
    def layer(a: int, b: int) -> np.ndarray:
        return (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

    return {"W": layer(WIDTH, HIDDEN) * 4, "b": np.zeros(HIDDEN, np.float32), "V": layer(HIDDEN, GATE), "U": layer(HIDDEN, GATE),
            "w": layer(GATE, 1)[:, 0], "beta": layer(HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32)}


def _forward(p: Params, x: np.ndarray, bag: np.ndarray) -> tuple:
    """Score of every bag; ``bag`` holds where each bag's passages begin."""
    sizes = np.diff(np.append(bag, len(x)))
    h = np.tanh(x @ p["W"] + p["b"])
    t, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    s = (t * u) @ p["w"]
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, bag), sizes))
    a = e / np.repeat(np.add.reduceat(e, bag), sizes)
    z = np.add.reduceat(h * a[:, None], bag)
    return 1 / (1 + np.exp(-(z @ p["beta"] + p["c"]))), z, a, h, t, u, sizes


def _gradient(p: Params, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> Params:
    score, z, a, h, t, u, sizes = _forward(p, x, bag)
    d = ((score - y) / len(y)).astype(np.float32)
    dz = np.repeat(d[:, None] * p["beta"], sizes, axis=0)
    da = (h * dz).sum(1)
    ds = a * (da - np.repeat(np.add.reduceat(a * da, bag), sizes))
    dg = ds[:, None] * p["w"]
    dt, du = dg * u * (1 - t * t), dg * t * u * (1 - u)
    dh = a[:, None] * dz + dt @ p["V"].T + du @ p["U"].T
    dpre = dh * (1 - h * h)
    return {"W": x.T @ dpre, "b": dpre.sum(0), "V": h.T @ dt, "U": h.T @ du, "w": (t * u).T @ ds, "beta": z.T @ d, "c": d.sum(keepdims=True)}


def _unit(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) / np.float32(255)


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4,
        seed: int = 1) -> Params:
    """All layers by Adam on the bags' labels."""
    rng = np.random.default_rng(seed)
    p = _start(rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        lr = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            own = [bags[i] for i in order[at : at + batch]]
            bag = np.concatenate([[0], np.cumsum([len(b) for b in own])])[:-1]
            grad = _gradient(p, _unit(np.concatenate(own)), bag, y[order[at : at + batch]])
            step += 1
            for k, g in grad.items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def train(docs: DataFrame, labels: DataFrame, sample: int = 6_000, most_passages: int = 150_000, epochs: int = 12) -> Params | float:
    """Fit on labelled rows that aren't held out: at most ``sample`` documents (see ``labelled_sample``) with at most ``most_passages`` passages.

    A sampled document takes part with all of its passages or, where they would exceed the bound, not at all. Where the labels hold one class
    or none, the result is a constant score: that class, or 0.5.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in text_slices(batch.column(0)):
                x, owner = passages(part)
                bags = [own.tobytes() for own in np.split(x, np.flatnonzero(np.diff(owner)) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column(1).slice(at, len(part)), batch.column(2).slice(at, len(part))],
                                                 ["bag", "y", "order"])
                at += len(part)

    rows = labelled_sample(docs, labels, "quality", sample).withColumn("order", F.xxhash64("text"))
    bags = rows.mapInArrow(pack, "bag binary, y long, order long")
    bags = materialise(bags.withColumn("at", F.monotonically_increasing_id()))
    total, chosen = 0, []
    for r in bags.select("at", "order", (F.octet_length("bag") / WIDTH).cast("long").alias("n")).orderBy("order", "at").collect():  # a row per sampled document
        if total + r.n <= most_passages:
            total += r.n
            chosen.append((r.at,))
    kept = docs.sparkSession.createDataFrame(chosen, "at long")
    rows = bags.join(F.broadcast(kept), "at").orderBy("order", "y").select("bag", "y").toArrow()  # in one order, however the files lie
    y = rows["y"].to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    return fit([np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, WIDTH) for b in rows["bag"]], y, epochs)


def score_texts(model: Params | float, texts: list[str]) -> np.ndarray:
    """Scores of a slice of texts, over all of their passages."""
    if isinstance(model, float):
        return np.full(len(texts), model)
    x, owner = passages(texts)
    return _forward(model, _unit(x), np.searchsorted(owner, np.arange(len(texts))))[0].astype(float)


def scorer(docs: DataFrame, model: Params | float):
    """A function from a text column to the quality score of the whole text; null is the empty text."""
    shared = bounded_batches(docs).sparkSession.sparkContext.broadcast(model)  # a fixed number of weights, whatever the data

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [score_texts(shared.value, part) for part in text_slices(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def quality(docs: DataFrame, model: Params | float, threshold: float = 0.3) -> DataFrame:
    """Score every text: ``doc_id, held_out, score, predicted``.

    A null text is the empty text, which is a bag of one empty passage. Repeated rows and ids give a row each; other
    columns are ignored.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), scorer(docs, model)(F.col("text")).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def attention(docs: DataFrame, model: Params) -> DataFrame:
    """Weight of every passage within its document: ``doc_id, passage (from 0), weight``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in text_slices(batch.column(1)):
                x, owner = passages(part)
                first = np.searchsorted(owner, np.arange(len(part)))
                weight = _forward(shared.value, _unit(x), first)[2].astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + owner)), pa.array(np.arange(len(owner)) - first[owner]),
                                                  pa.array(weight)], ["doc_id", "passage", "weight"])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, "doc_id long, passage long, weight double")
