import zlib

import numpy as np
import pytest

from llm_cases import odd_docs  # noqa: F401
from locusframe.llm import quality_mil, toxicity_mil

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def mid(spark):
    return spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")


def accuracy(scored, labels, column):
    rows = scored.join(labels, "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert rows.score.between(0, 1).all()
    return (held.predicted == held[column]).mean(), held[held[column] == 1].predicted.mean()


def test_toxicity(spark, mid, odd_docs):
    docs, labels = mid
    model = toxicity_mil.train(docs, labels)
    right, recall = accuracy(toxicity_mil.toxicity(docs, model), labels, "toxic")
    assert right >= 0.93 and recall >= 0.5
    odd = toxicity_mil.toxicity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count()
    assert all(r.score == 0 for r in odd if r.doc_id in (1, 2, 3))
    found = toxicity_mil.offending_sentences(docs, model).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) and all(texts[r.doc_id][r.start :].strip().startswith(r.text) for r in found.itertuples())
    # a document with an offending sentence is toxic by the noisy-or
    scores = {r.doc_id: r.score for r in toxicity_mil.toxicity(docs, model).collect()}
    assert all(scores[r.doc_id] >= r.score - 1e-9 for r in found.itertuples())


def test_noisy_or_of_sentences(spark):
    weights = np.zeros(toxicity_mil.BUCKETS, np.float32)
    buckets, *_ = toxicity_mil._features(["awful"])
    weights[buckets[0]] = 3.0
    model = toxicity_mil.Model(weights, -1.0)
    docs = spark.createDataFrame([(1, "Awful day. Good day! awful awful"), (2, None)], "doc_id long, text string")
    p, q = 1 / (1 + np.exp(-2.0)), 1 / (1 + np.exp(1.0))
    got = {r.doc_id: r.score for r in toxicity_mil.toxicity(docs, model).collect()}
    assert got[1] == pytest.approx(1 - (1 - p) ** 2 * (1 - q), abs=1e-6) and got[2] == 0


def test_quality(spark, mid, odd_docs):
    docs, labels = mid
    model = quality_mil.train(docs, labels)
    right, recall = accuracy(quality_mil.quality(docs, model), labels, "quality")
    assert right >= 0.9 and recall >= 0.95
    assert quality_mil.quality(odd_docs, model).count() == odd_docs.count()
    weights = quality_mil.attention(docs, model).groupBy("doc_id").sum("weight").toPandas()
    assert len(weights) == docs.count() and np.allclose(weights["sum(weight)"], 1, atol=1e-4)


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in quality_mil._start(rng).items()}
    x, bag, y = rng.random((7, quality_mil.WIDTH)), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = quality_mil._forward(p, x, bag)[0]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grad = quality_mil._gradient(p, x, bag, y)
    for k, g in grad.items():
        at = tuple(0 for _ in g.shape)
        keep = p[k][at]
        p[k][at] = keep + 1e-5
        up = loss()
        p[k][at] = keep - 1e-5
        down = loss()
        p[k][at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_without_usable_labels(spark, mid, odd_docs):
    docs, labels = mid
    for few in (labels.where("false"), labels.where("quality = 1 and toxic = 0"), labels.selectExpr("doc_id", "null as quality", "null as toxic")):
        few = few.selectExpr("doc_id", "cast(quality as int) quality", "cast(toxic as int) toxic")
        tox = toxicity_mil.toxicity(odd_docs, toxicity_mil.train(docs, few)).collect()
        assert all(r.predicted == 0 for r in tox)
        good = quality_mil.quality(odd_docs, quality_mil.train(docs, few)).collect()
        assert len(good) == odd_docs.count() and all(r.predicted == 1 for r in good)
    assert toxicity_mil.toxicity(docs.where("false"), toxicity_mil.train(docs.where("false"), labels)).count() == 0
    assert quality_mil.quality(docs.where("false"), quality_mil.train(docs.where("false"), labels)).count() == 0


def test_counted_sentences_are_those_located(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_mil.train(docs, labels)
    located = {}
    for r in toxicity_mil.offending_sentences(docs, model).collect():
        located.setdefault(r.doc_id, []).append((r.score, -r.sentence))
    scored = toxicity_mil.toxicity(docs, model).collect()
    assert {r.doc_id: (r.offending, r.worst_sentence) for r in scored if r.offending} == {
        i: (len(x), -max(x)[1]) for i, x in located.items()}
    assert all(r.worst_sentence is None for r in scored if not r.offending)


def test_a_document_too_long_for_the_bound_is_left_out_whole(spark):
    """With a bound of a few passages only short bags are fitted on; none is cut."""
    docs = spark.createDataFrame([(i, "good words here " * (2 if i % 2 else 3000)) for i in range(1, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    assert quality_mil.train(docs, labels, most_passages=20, epochs=1) == 1.0
    assert isinstance(quality_mil.train(docs, labels, epochs=1), dict)
