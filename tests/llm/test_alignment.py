import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from llm_cases import SF, odd_docs, records  # noqa: F401
from locusframe.llm.alignment import Pair, aligned_counts, groups, links
from locusframe.llm.pretokens import to_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text, lib, model, letters):
    """Ids and byte strings of either side by the libraries; none where a side spells something else."""
    if not text:
        return [], [], [], []
    whole = (" " + text).encode()
    a = lib.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    bytes_a = [to_bytes(letters[i]) if letters[i] != "<|endoftext|>" else letters[i].encode() for i in a]
    bytes_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return (a, b, bytes_a, bytes_b) if b"".join(bytes_a) == whole == b"".join(bytes_b) else ([], [], [], [])


def brute_force(rows):
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    letters = {i: t for t, i in lib.get_vocab().items()}
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    found, seen = [], Counter()
    for doc_id, text in rows:
        a, b, bytes_a, bytes_b = tokens(text, lib, model, letters)
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        parts, at_a, at_b = [], 0, 0
        for end in common:
            to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
            parts.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        pairs, j = [], 0
        for i, id_a in enumerate(a):
            lo, hi = ([0] + ends_a)[i], ends_a[i]
            while j and ([0] + ends_b)[j] > lo:
                j -= 1
            while ends_b[j] <= lo:
                j += 1
            k = j
            while k < len(b) and ([0] + ends_b)[k] < hi:
                pairs.append((id_a, b[k]))
                k += 1
        seen.update(set(pairs))
        found.append((doc_id, len(a), len(b), len(common), pairs, hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    best = Counter()
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    return sorted(((i, n_a, n_b, n, len(p), sum(seen[q] == best[q[0]] for q in p), sum(seen[q] for q in p), sha)
                   for i, n_a, n_b, n, p, sha in found), key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_equals_brute_force(spark, odd_docs):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate([
        "x▁y", "a\x00b", " ", "   ", " lead", "trail ", "two  spaces   three", "\n", "<s> <0x0A> </s>", "ﬁ ½ é 🙂🙂", "word " * 40])], "doc_id long, text string")
    for docs in (odd_docs.select("doc_id", "text").unionByName(more), spark.read.parquet(f"{SF}/documents.parquet").limit(60)):
        docs = docs.cache()
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = [tuple("null" if v is None else v for v in r) for r in brute_force(rows)]
        # all pairs broadcast, and almost none
        for tier in (1 << 20, 3):
            assert records(aligned_counts(docs, A, B, tier), *COLUMNS) == sorted(want, key=repr)


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", 7)], "doc_id int, text string, row int, key string, n_links int")
    assert records(aligned_counts(docs, A, B), "doc_id", "n_a", "n_b") == [(1, 2, 2)]


def test_empty_table(odd_docs):
    assert aligned_counts(odd_docs.where("false"), A, B).count() == 0


def test_groups_and_links_of_random_cuts():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, rng.choice([20, 80, 400]))
        a, b = (sorted({n, *(rng.randrange(1, n + 1) for _ in range(rng.randrange(n + 1)))}) for _ in range(2))
        if rng.random() < 0.3:
            b = a[: len(a) // 2] + [x for x in b if x > a[max(0, len(a) // 2 - 1)]] or a
            b = sorted({*b, n})
        to_a, to_b = (x.tolist() for x in groups(np.array(a), np.array(b)))
        common = sorted(set(a) & set(b))
        assert to_a == [a.index(c) + 1 for c in common] and to_b == [b.index(c) + 1 for c in common]
        i, j = links(np.array(a), np.array(b))
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(([0] + a)[x], ([0] + b)[y]) < min(a[x], b[y])]
        assert list(zip(i.tolist(), j.tolist())) == want


def test_chunks_encode_like_whole_texts():
    both = Pair(A, B)
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["".join(rng.choice([" ", "  ", "a", "b", "\n", "é", "日", "th", "ing", "1", ".", "<0x0A>", "<s>", "\t", "\x1c", "\x85", "\u00a0", "\u2028", "'s"])
                     for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ["", "x▁y", " "]
    texts += ["".join(map(chr, (rng.randrange(1, 0x234) for _ in range(20)))) for _ in range(500)]
    for limit in (1 << 20, 2000):  # with chunks that stay, and chunks that fall out within a slice
        both.chunks.limit = limit
        for at in range(0, len(texts), 500):
            for text, found in zip(texts[at : at + 500], both.ids(texts[at : at + 500])):
                if not text or "▁" in text:
                    assert found is None
                else:
                    assert found[0].tolist() == lib.encode(" " + text, add_special_tokens=False).ids and found[1].tolist() == both.model.encode(text)
