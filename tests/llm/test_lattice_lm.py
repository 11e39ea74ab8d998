import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from llm_cases import SF, odd_docs, records  # noqa: F401
from locusframe.llm.lattice_lm import Lattice, Pieces, scores

PATH = public_tokenizers.path("piece_bpe_32k.model")


def out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


@pytest.fixture(scope="module")
def table():
    return Pieces(PATH)


def paths(word, weight):
    """All segmentations of a word as lists of pieces, by recursion."""
    if not word:
        return [[]]
    return [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in weight for rest in paths(word[k:], weight)]


def spelling(word, weight):
    """Probability of a word by the sum over prefixes, one byte after another."""
    text = b" " + word
    p = [1.0] + [0.0] * len(text)
    for i in range(1, len(text) + 1):
        p[i] = sum(p[i - k] * weight.get(text[i - k : i], 0.0) for k in range(1, min(25, i) + 1))
    return p[-1]


def brute_force(rows, table, most=8, rounds=2, strength=1000.0):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split()
    by_kind = Counter(k for i, _, k in rows if not held(i))
    kinds = sorted(by_kind, key=lambda k: (-by_kind[k], k is not None, k))[:most]
    kind = {k: min(kinds.index(k), most - 1) if k in kinds else len(kinds) - 1 for _, _, k in rows}
    c, texts = [Counter() for _ in kinds], [0] * len(kinds)
    for i, t, k in rows:
        if not held(i):
            c[kind[k]].update(words(t))
            texts[kind[k]] += 1
    prior = dict(zip(table.spelled, table.prior))
    weights = []
    for own in c:
        weight = dict(prior)
        for _ in range(rounds):
            uses = Counter()
            for w in own:
                text = b" " + w
                up = [1.0] + [0.0] * len(text)
                arcs = [(i, j, text[i:j]) for j in range(1, len(text) + 1) for i in range(max(0, j - 25), j) if text[i:j] in weight]
                for i, j, piece in arcs:
                    up[j] += up[i] * weight[piece]
                down = [0.0] * len(text) + [1.0]
                for i, j, piece in sorted(arcs, reverse=True):
                    down[i] += down[j] * weight[piece]
                for i, j, piece in arcs:
                    uses[piece] += up[i] * weight[piece] * down[j] / up[-1]
            weight = {p: strength * prior[p] + uses[p] for p in prior}
            total = sum(weight.values())
            weight = {p: x / total for p, x in weight.items()}
        weights.append(weight)
    both = sum(c, Counter())
    n, v, docs = sum(both.values()), len(both), sum(texts)
    all_base = n + docs + v + (docs > 0) + 1
    found = []
    for i, t, _ in rows:
        ws = words(t)
        base = sum(math.log10((both[w] + 1) / all_base) for w in ws) + math.log10((docs + 1) / all_base)
        in_class = []
        for own, weight, m in zip(c, weights, texts):
            size, once, twice = sum(own.values()), *(sum(x == k for x in own.values()) for k in (1, 2))
            d, end = once / (once + 2 * twice) if once else 0.5, (m + 1) / (size + m + 2)
            score = math.log10(end) + math.log10((m + 1) / (docs + len(kinds)))
            for w in ws:
                s = spelling(w, weight)
                elsewhere = (both[w] / n + s) / 2 if n else s
                score += math.log10((1 - end) * ((max(own[w] - d, 0) + d * len(own) * elsewhere) / size if size else elsewhere))
            in_class.append(score)
        top = max(in_class)
        score = top + math.log10(sum(10 ** (x - top) for x in in_class))
        found.append((i, len(ws) + 1, sum(both[w] > 0 for w in ws) + (docs > 0), n + docs, base, score))
    return found


def close(got, want):
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    for g, w in zip(sorted(got, key=order), sorted(want, key=order)):
        assert g[:4] == w[:4] and np.allclose(g[4:], w[4:], rtol=1e-9)


def test_equals_brute_force(spark, odd_docs, table):
    # a run of 30,000 letters underflows the plain sums of the brute force, the others don't
    plain = odd_docs.select("doc_id", "text", "lang").where("doc_id is null or doc_id <> 5").cache()
    for docs in (plain, spark.read.parquet(f"{SF}/documents.parquet").limit(40).cache()):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
        # most words broadcast, and almost none; classes of their own, and all but one together
        for tier, most in ((1 << 15, 8), (2, 2)):
            close([tuple(r) for r in scores(docs, PATH, ~out(), F.col("lang"), most, tier).collect()], brute_force(rows, table, most))


def test_odd_rows_and_clashing_columns(spark, odd_docs):
    got = scores(odd_docs, PATH, ~out()).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(r.score) and r.score < 0 for r in got)
    docs = spark.createDataFrame([(1, "a b", 5, "x", 7.0)], "doc_id int, text string, row int, key string, score double")
    assert records(scores(docs, PATH, F.lit(True)), "doc_id", "n_tokens", "n_known", "train_tokens") == [(1, 3, 3, 3)]
    assert scores(odd_docs.where("false"), PATH, ~out()).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = scores(docs, PATH, F.lit(False)).first()
    assert (r.n_known, r.train_tokens) == (0, 0) and math.isfinite(r.score) and r.base_score == 0.0


def test_marginals_sum_all_segmentations(table):
    weight = dict(zip(table.spelled, table.prior))
    for word in (b"the", b"tion", "né".encode(), b"a"):
        want = sum(math.prod(weight[p] for p in path) for path in paths(b" " + word, weight))
        lattice = Lattice([b"x", word, b"other"], table)
        assert math.isclose(lattice.marginals(np.log(table.prior))[1], math.log(want), rel_tol=1e-9)
        used = Lattice([word], table).expected(np.log(table.prior))
        by_length = sum(used[i] * len(p) for i, p in enumerate(table.spelled))
        assert math.isclose(by_length, len(word) + 1, rel_tol=1e-9)


def test_long_words_stay_finite(table):
    assert np.isfinite(Lattice([b"x" * 30_000], table).marginals(np.log(table.prior))).all()


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = scores(docs, PATH, ~out(), F.col("lang")).join(docs.select("doc_id", out().alias("out")), "doc_id").where("out")
    r = got.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert r.score > r.base
