import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from llm_cases import SF, odd_docs  # noqa: F401
from locusframe.llm import byte_words
from locusframe.llm.bpe_automaton import Automaton, Codec, TwoAges, codec, decode_column, encode_column, round_trip
from locusframe.llm.common import per_process
from locusframe.llm.pretokens import Vocabulary
from locusframe.llm.token_counts import frequent_pretokens, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def expected_round_trip(rows):
    lib = Tokenizer.from_file(BYTE)
    out = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=key)


def test_round_trip_equals_the_library(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in round_trip(docs, BYTE).collect()), key=key) == expected_round_trip(rows)


def test_ids_decode_to_the_text(odd_docs):
    back = odd_docs.select("text", encode_column(odd_docs.text, BYTE).alias("ids")).select("text", decode_column("ids", BYTE).alias("b")).collect()
    assert all(r.b == (r.text or "") for r in back)


def test_counts_equal_the_library(spark, odd_docs):
    lib = Tokenizer.from_file(WORD)
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in docs.select("doc_id", "text").collect():
            n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
        # with a first tier of a few words, and without any
        for entries in (1 << 15, 3):
            assert sorted((tuple(r) for r in token_counts(docs, WORD, entries=entries).collect()), key=key) == sorted(want, key=key)


def test_empty_tables(spark, odd_docs):
    none = odd_docs.where("false")
    assert token_counts(none, WORD).count() == 0 and round_trip(none, BYTE).count() == 0


def test_frequent_words_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([("the the cat",), ("a cat",), (None,)], "text string").repartition(3)
    assert {r.word: r.seen for r in frequent_pretokens(docs, WORD).collect()} == {"the": 2, "cat": 2, "a": 1}


def naive_bpe(word, merges):
    parts = list(word)
    while True:
        best = min(((merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges), default=None)
        if best is None:
            return parts
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_automaton_equals_merging_by_rank():
    """Random vocabularies whose merges come from repeatedly joining a frequent pair, with many repeated letters."""
    rng = random.Random(4)
    for _ in range(20):
        corpus = [list("".join(rng.choice("aab") for _ in range(12))) for _ in range(30)]
        merges = {}
        for _ in range(12):
            pairs = [p for w in corpus for p in zip(w, w[1:])]
            if not pairs:
                break
            p = max(sorted(set(pairs)), key=pairs.count)
            merges[p] = len(merges)
            corpus = [naive_bpe("".join(w), merges) for w in corpus]
        vocab = Vocabulary.__new__(Vocabulary)
        vocab.word_end, vocab.merges = "", list(merges)
        names = dict.fromkeys(["a", "b", *(x + y for x, y in merges)])
        if len(names) < 2 + len(merges):  # two merges spell one token
            continue
        vocab.ids = {t: i for i, t in enumerate(names)}
        auto, spelled = Automaton(vocab), list(names)
        for _ in range(100):
            word = "".join(rng.choice("aab") for _ in range(rng.randrange(1, 25)))
            assert [spelled[i] for i in auto.encode(word.encode())] == naive_bpe(word, merges)


def test_a_codec_is_small():
    """Entries that nothing follows share the row of the entry that they fall back to; the library only splits."""
    vocab = Vocabulary(BYTE)
    auto = Automaton(vocab)
    rows = len(auto.table) // 256
    assert len(set(auto.row)) == rows < 0.7 * len(auto.row) and len(auto.row) == len(auto.ends)
    assert vocab._library.get_vocab_size() == 0


def test_a_workers_table_shares_blocks():
    """Pipeline (bpe): a worker held 256 numbers for each entry that something follows, and the merges after they were compiled."""
    for path in (BYTE, WORD):
        vocab = Vocabulary(path)
        full, small = Automaton(vocab), Automaton(vocab, compact=True)
        assert small.table.nbytes + small.block.nbytes < full.table.nbytes / 5 and len(small.row) == len(full.row)
        rng = random.Random(3)
        letters = [bytes([b]) for b in range(256)] if path == BYTE else [c.encode() for c in "abcdefghijklmnopqrstuvwxyz"]
        for w in [b"".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(2000)] + [b"unbelievable", b"tokenization"]:
            assert small.encode(w, bool(vocab.word_end)) == full.encode(w, bool(vocab.word_end))
    held = codec(BYTE)
    assert not held.vocab.ids and not held.vocab.merges and codec(BYTE) is held
    assert held.encode("the <|endoftext|> unbelievable \u4e2d") == Codec(BYTE).encode("the <|endoftext|> unbelievable \u4e2d")


def test_powers_are_no_longer_than_needed():
    """Pipeline: power tables were doubled, 32 MB of a worker for slices of a little over 1 MB."""
    per_process("tests", ("nothing",), list)  # tables of earlier tests go
    tables = byte_words._power_tables((1 << 20) + 5)
    assert all(len(t) <= (1 << 20) + byte_words.POWER_STEP for t in tables)
    assert all(int(tables[0][k]) == pow(int(byte_words.BASE), k, 1 << 64) for k in (0, 1, 77, 1 << 20))
    assert (tables[0][: 1 << 20] * tables[1][: 1 << 20] == 1).all()


def test_caches_stay_bounded():
    made = []
    cache = TwoAges(lambda w: made.append(w) or w * 2, 1000)
    for w in ["a", "b", "c", "d", "a", "e", "f", "g", "h", "a", "x" * 500]:
        assert cache[w] == 2 * w
    assert len(cache) <= 4 and len(cache.old) <= 4 and "x" * 500 not in cache
    assert made.count("b") == 1 and Codec(BYTE).encode("") == []


def test_words_run_over_the_tables():
    """Without the table of byte transitions, or without the states that arcs end in, words come out wrong or not at all."""
    want = {w: Codec(BYTE).encode(w) for w in (" tokenization", " the", "unbelievable")}
    for name, empty in (("table", lambda t: memoryview(bytes(4 * len(t))).cast("i")), ("state_of", lambda t: [0] * len(t))):
        codec = Codec(BYTE)
        auto = Automaton(codec.vocab)
        setattr(auto, name, empty(getattr(auto, name)))
        got = {}
        for w in want:
            try:
                got[w] = list(auto.encode(w.encode()))
            except (IndexError, RecursionError):
                got[w] = None
        assert got != want


def test_every_letter_of_the_short_patterns(spark):
    """Each code point below U+0234 alone, within a word and next to a digit, as the libraries split, lower and encode it."""
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    texts = [f"{c} a{c}b {c}1{c}{c} {c}'s" for c in map(chr, range(1, 0x234))]
    rng = random.Random(3)
    texts += ["".join(chr(rng.randrange(1, 0x234)) for _ in range(30)) for _ in range(500)]
    codec = Codec(BYTE)
    assert [codec.encode(t) for t in texts] == [byte.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, WORD).collect()}
    assert [got[i] for i in range(len(texts))] == [len(word.encode(t, add_special_tokens=False).ids) for t in texts]


def test_special_strings_as_text():
    lib = Tokenizer.from_file(BYTE)
    lib.encode_special_tokens = True
    text = "a<|endoftext|> b"
    assert Codec(BYTE).encode(text, specials=False) == lib.encode(text, add_special_tokens=False).ids
