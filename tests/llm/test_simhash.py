import re

import numpy as np
import pandas as pd
import xxhash

from llm_cases import odd_docs  # noqa: F401
from locusframe.llm import simhash_golay as golay
from locusframe.llm.components import components


def brute_print(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    """Smallest id reachable; null ids take part and name nothing."""
    prints = np.array(prints, np.uint64)
    label = np.arange(len(ids))
    near = [np.flatnonzero(np.bitwise_count(prints ^ p) <= 4) for p in prints]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    out = {}
    for k, i in zip(label, ids):
        if i is not None:
            out[k] = min(out.get(k, i), i)
    return [out.get(k) for k in label]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [brute_print(t) for _, t in rows]
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute_components([i for i, _ in rows], prints))]
    got = [tuple(r) for r in golay.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_odd_documents(spark, odd_docs):
    check(odd_docs)
    assert golay.near_duplicates(odd_docs.where("false")).count() == 0


def test_whole_tables(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_decoder_and_keys_meet():
    table = golay.decoder()
    words = golay._codewords()
    assert (table >= 0).all() and min(bin(w).count("1") for w in words.tolist() if w) == 7
    rng = np.random.default_rng(2)
    for errors in range(5):
        a = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * 2 + rng.integers(0, 2, 400, dtype=np.uint64)
        b = a.copy()
        for i in range(len(b)):
            for k in rng.choice(64, errors, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(k)
        sent = set(zip(*(x.tolist() for x in golay.keys(a))))
        met = {n for n, k, s in zip(*(x.tolist() for x in golay.keys(b))) if (n, k, (1, 0, 2)[s]) in sent}
        assert len(met) == 400


def test_links_of_a_dense_group(spark):
    """Fingerprints around one centre: all links are found, and far fewer edges than links are made."""
    rng = np.random.default_rng(3)
    centre = 0x0123456789ABCDEF
    prints = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (600, 2)) if a != b}
    far = {int(x) for x in rng.integers(0, 1 << 62, 300)}
    frame = pd.DataFrame({"fp": np.array(sorted(prints | far), np.uint64).view(np.int64)})
    edges = golay.links(spark.createDataFrame(frame).repartition(4), 3)
    roots = components(edges).toPandas()
    assert roots.root.nunique() == 1 and len(roots) == len(prints)


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(5)
    pairs = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    pairs += [(2000 + i, 2000 + int(rng.integers(0, i))) for i in range(1, 100)]
    rng.shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {2000 + i: 2000 for i in range(100)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
