import hashlib
import random

import pytest

from llm_cases import SF, odd_docs  # noqa: F401
from locusframe.llm.prefix_hashes import (PrefixHashes, code_points, common_extension, common_extensions, edited_fingerprints, fingerprint_of,
                                          likeness, same_span, span_lengths)


def brute_extension(a, i, b, j):
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n


def test_spans_and_extensions():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choice("ab\U0001f642") for _ in range(rng.randrange(0, 40))) for _ in range(2))
        x, y = PrefixHashes(code_points(a)), PrefixHashes(code_points(b))
        for _ in range(20):
            i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
            assert common_extension(x, i, y, j) == brute_extension(a, i, b, j)
            n = rng.randrange(0, min(len(a) - i, len(b) - j) + 1)
            assert same_span(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])


def test_extension_column(spark):
    rows = [("banana", 1, "ananas", 0), (None, 0, "a", 0), ("a", 5, "a", 0), ("a", None, "a", 0), ("ab", -1, "ab", 0), ("x" * 9000, 0, "x" * 9000 + "y", 0)]
    got = common_extensions(spark.createDataFrame(rows, "a string, i int, b string, j int")).collect()
    assert {(r.a, r.i): r.extension for r in got} == {("banana", 1): 5, (None, 0): 0, ("a", 5): 0, ("a", None): 0, ("ab", -1): 0, ("x" * 9000, 0): 9000}


def check(docs):
    """Documents with distinct ids and texts in order; repeated ids follow in the order of the texts' hash."""
    ordered = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").orderBy("doc_id", "h").collect()
    got = {}
    for r in edited_fingerprints(docs).collect():
        got.setdefault((r.doc_id, r.edited_sha256), []).append(r)
    n = 0
    for k, r in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)].text
        cut = len(r.text) // 4
        edited = r.text[: len(r.text) - cut] + after[:cut]
        row = got[r.doc_id, hashlib.sha256(edited.encode()).hexdigest()].pop()
        own, new, nxt = (fingerprint_of(PrefixHashes(code_points(t))) for t in (r.text, edited, after))
        assert (row.n_chars, row.fingerprint, row.edited_fingerprint) == (len(r.text), own, new)
        assert (row.near_edited, row.near_next) == (likeness(own, new), likeness(own, nxt))
        assert row.common_prefix == brute_extension(r.text, 0, edited, 0)
        n += 1
    assert n == len(ordered) and not any(got.values())


def test_edited_texts(spark, odd_docs):
    check(odd_docs)
    check(spark.read.parquet(f"{SF}/documents.parquet"))
    check(spark.createDataFrame([(5, "only one document")], "doc_id long, text string"))
    assert edited_fingerprints(odd_docs.where("false")).count() == 0


def test_likeness_tells_shared_spans():
    rng = random.Random(7)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(2))
    prints = [fingerprint_of(PrefixHashes(code_points(t))) for t in (a, a[:3000] + b[:1000], b)]
    assert likeness(prints[0], prints[0]) == 1 and likeness(prints[0], prints[2]) == 0
    assert likeness(prints[0], prints[1]) == pytest.approx(0.6, abs=0.2)


def test_short_texts_share_spans_with_their_edits():
    rng = random.Random(8)
    for n in range(4, 40):
        text, other = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for _ in range(2))
        edited = text[: n - n // 4] + "#" * (n // 4)
        own, new, far = (fingerprint_of(PrefixHashes(code_points(t))) for t in (text, edited, other))
        assert likeness(own, own) == 1 and 0.1 < likeness(own, new) < 1
        assert likeness(own, far) < likeness(own, new)
    prints = {fingerprint_of(PrefixHashes(code_points(t))) for t in ("", "a", "ab", "ba", "abc", "cab", "abcd", "dcba")}
    assert len(prints) == 8
    assert span_lengths(0) == [0] and span_lengths(3) == [1, 3] and span_lengths(20) == [4, 16] and span_lengths(32) == [16]
