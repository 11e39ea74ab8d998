"""Token counts of whole texts by a two-tier lookup on the map side.

First tier: the most frequent pre-tokens of the corpus with their token counts, one compact table (a blob of words and
one byte of length each) that is broadcast. Its size is bounded by ``entries`` and by ``WORD_BYTES``. It is measured over every
document: a task counts its pre-tokens in a table of bounded size and hands on its heaviest ones only.

Second tier: a pre-token that isn't in the table is encoded, and the worker remembers its count in a cache of
bounded size. Pre-tokens never travel between tasks, apart from those heaviest few; a document is one row throughout.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from locusframe.llm.bpe_automaton import Automaton, TwoAges
from locusframe.llm.common import bounded_batches, per_process, text_slices
from locusframe.llm.pretokens import Vocabulary

# Longest word of the first tier, in bytes; longest list of words that one task counts and hands on.
WORD_BYTES, TASK_COUNTS, TASK_SENDS = 48, 1 << 15, 1 << 12
# Bytes of the young half of a worker's cache.
CACHE = 24 << 20


def _vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    return per_process("counts", ("vocabulary", path), lambda: Vocabulary(path))


def _encoder(path: str) -> tuple[Vocabulary, Automaton]:
    return per_process("counts", ("encoder", path), lambda: (_vocabulary(path), Automaton(_vocabulary(path))))


def _special(_text: str) -> tuple[str]:
    """A special string is one token, whatever it spells; a tuple can't clash with a word."""
    return ("special",)


def frequent_pretokens(docs: DataFrame, path: str, entries: int = 1 << 15) -> DataFrame:
    """The most frequent pre-tokens over all documents: ``word, seen`` with at most ``entries`` rows.

    ``seen`` is a lower bound: when a task's table is full, the words seen once or least often leave it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = _vocabulary(path), Counter()
        for batch in batches:
            for part in text_slices(batch.column(0)):
                for t in part:
                    seen.update(vocab.split(t, _special))
                if len(seen) > 2 * TASK_COUNTS:
                    seen = Counter(dict(seen.most_common(TASK_COUNTS)))
        best = [(w, n) for w, n in seen.most_common(TASK_SENDS) if isinstance(w, str) and len(w.encode()) <= WORD_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())],
                                         ["word", "seen"])

    heavy = bounded_batches(docs).select("text").mapInArrow(count, "word string, seen long")
    return heavy.groupBy("word").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "word").limit(entries)


class _Lengths(dict):
    """Words of the broadcast table with their token counts; what is missing goes to the worker's cache."""

    def __init__(self, words: bytes, counts: bytes, path: str):
        super().__init__(zip(words.decode().split("\n") if counts else (), counts))
        self[("special",)] = 1
        self.vocab, self.auto = _encoder(path)
        marked = bool(self.vocab.word_end)
        self.cache = TwoAges(lambda word: len(self.auto.encode(word.encode("utf-8", "surrogatepass"), marked)), CACHE)

    def __missing__(self, word: str) -> int:
        return self.cache[word]


def token_counter(docs: DataFrame, path: str, entries: int = 1 << 15):
    """A function from a text column to its token count, with the first tier measured on ``docs``."""
    vocab, auto = _encoder(path)
    heavy = [(r.word, n) for r in frequent_pretokens(docs, path, entries).collect()  # at most `entries` short words
             if (n := len(auto.encode(r.word.encode(), bool(vocab.word_end)))) < 256 and "\n" not in r.word]
    shared = docs.sparkSession.sparkContext.broadcast(("\n".join(w for w, _ in heavy).encode(), bytes(n for _, n in heavy)))

    key = uuid.uuid4().hex

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        lengths = per_process("counts", ("lengths",), lambda: _Lengths(*shared.value, path), key)
        find, split = lengths.__getitem__, lengths.vocab.split
        return pa.array([sum(map(find, split(t, _special))) for part in text_slices(texts) for t in part], pa.int64())

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 2048, entries: int = 1 << 15) -> DataFrame:
    """Tokens of every text: ``doc_id, n_bytes, n_tokens, over_limit``.

    A null text is the empty text (0 bytes, 0 tokens). Repeated rows and ids give a row each; an empty table gives
    no rows; other columns are ignored.
    """
    count: "Column" = token_counter(docs, path, entries)
    return docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count(F.col("text")).alias("n_tokens"),
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
