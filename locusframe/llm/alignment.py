"""Alignment of two tokenizers' tokens over the same bytes, by skipping along the diagonal.

Both tokens of a text are arrays of byte offsets at which tokens end. Groups are cut where both end. From a common end on, the arrays
are compared at the current index shift in blocks of doubling length: a stretch in which tokens match one to one is
jumped in a logarithm of its length, and the block that differs is halved until the stretch ends. The irregular group behind it is
resolved by advancing whichever side is behind until both end together, which gives the new shift.

A link is a pair of tokens whose bytes overlap. How many documents hold a pair of ids linked is counted over the whole corpus, and every document
adds up the counts of its links (see ``two_tier``).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.bpe_automaton import TwoAges
from locusframe.llm.common import bounded_batches, materialise, per_process, text_slices
from locusframe.llm.pretokens import ODD, to_bytes
from locusframe.llm.two_tier import frequent, sums_by_row

# Bytes of the young half of the remembered chunks, and pairs that a task counts at a time.
WORD_CACHE, PAIRS_HELD = 120 << 20, 1 << 22
# Length of the first block of a stretch, and of the last one, within which its end is found token by token.
FIRST_BLOCK, NEAR = 4, 16
# Pairs in the broadcast tier.
FREQUENT_PAIRS = 1 << 20


def stretches(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Groups from the tokens' end offsets, as runs: numbers of tokens of either side up to a run's end, and its groups.

    A run of several groups is a stretch of one-to-one tokens, and an irregular group is a run by itself. The last offsets are equal, and offsets
    grow; tokens without bytes aren't allowed.
    """
    n = len(a)
    i = j = 0
    to_a: list[int] = []
    to_b: list[int] = []
    many: list[int] = []
    while i < n:
        if a[i] == b[j]:
            start, step = i, FIRST_BLOCK
            while (part := a[i : i + step]) and part == b[j : j + len(part)]:  # blocks of doubling length at the shift j - i
                i += len(part)
                j += len(part)
                step *= 2
            while step > NEAR:  # the stretch ends within a block: halve it
                step //= 2
                if (part := a[i : i + step]) and part == b[j : j + len(part)]:
                    i += len(part)
                    j += len(part)
            for x, y in zip(a[i : i + step], b[j : j + step]):
                if x != y:
                    break
                i += 1
                j += 1
            to_a.append(i)
            to_b.append(j)
            many.append(i - start)
        else:
            x, y = a[i], b[j]
            i += 1
            j += 1
            while x != y:  # the side that is behind moves on until both end together: the new shift
                if x < y:
                    x = a[i]
                    i += 1
                else:
                    y = b[j]
                    j += 1
            to_a.append(i)
            to_b.append(j)
            many.append(1)
    return to_a, to_b, many


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of either side up to the end of each group."""
    to_a, to_b, many = (np.array(x, np.int64) for x in stretches(a.tolist(), b.tolist()))
    back = np.repeat(np.cumsum(many), many) - 1 - np.arange(many.sum())  # groups from each one to the end of its run
    return np.repeat(to_a, many) - back, np.repeat(to_b, many) - back


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of all overlapping pairs. Between two neighbouring ends of either side lies exactly one pair."""
    cuts = np.concatenate([a, b])
    cuts.sort(kind="stable")
    cuts = cuts[np.append(cuts[1:] != cuts[:-1], True)] if len(cuts) else cuts
    return np.searchsorted(a, cuts), np.searchsorted(b, cuts)


# A run of spaces and what follows it. No piece of side B reaches over the space after it, so a text can be encoded chunk by chunk.
_CHUNK = re.compile(" +[^ ]*")
# Fixed value: the split of byte-level BPE, in the syntax of the library that encodes by ranks.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Pair:
    """Both tokenizers of an alignment in one worker: byte-level BPE (A) and sentencepiece (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.library_a = Tokenizer.from_file(path_a)
        self.library_a.encode_special_tokens = True
        special = {t.content: i for i, t in self.library_a.get_added_tokens_decoder().items()}
        vocab = self.library_a.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocab.values(), default=0))
        for letters, i in vocab.items():
            self.bytes_a[i] = letters.encode() if letters in special else to_bytes(letters)
        # the same merges by rank, which is faster; ids are ranks. Texts of other scripts keep the file's own library, whose Unicode tables may differ.
        ranks = {self.bytes_a[i]: i for letters, i in vocab.items() if letters not in special}
        self.ranked_a = tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        spelled = [self.model.id_to_piece(i) for i in range(len(self.model))]
        if any(re.search("[^▁]▁", p) for p in spelled):
            raise ValueError(f"{path_b} has pieces that reach over a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)]
        self.space = self.model.piece_to_id("▁")
        self.fresh: dict[str, bytes | None] = {}
        self.chunks = TwoAges(lambda chunk: self.fresh[chunk], WORD_CACHE)
        self.length_a, self.length_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # decimal ids and what follows them: within a group, and at the end of its side
        self.written = [f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))] + [f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))]

    def side_a(self, text: str) -> np.ndarray | None:
        """Ids of a space and a text; none where they spell something else (byte-level BPE can only leave bytes out)."""
        spaced = " " + text
        ids = self.library_a.encode(spaced, add_special_tokens=False).ids if ODD.search(spaced) else self.ranked_a.encode_ordinary(spaced)
        ids = np.array(ids, np.int32)
        return ids if self.length_a[ids].sum() == len(spaced.encode("utf-8", "surrogatepass")) else None

    def _encode(self, chunks: list[str]) -> None:
        """Ids of side B of new chunks, as bytes of 32 bit numbers; none where they spell something else."""
        for chunk, ids in zip(chunks, self.model.encode([c[1:] for c in chunks], num_threads=1)):
            if chunk == " ":  # the model adds no space to nothing
                ids = [self.space]
            same = b"".join(map(self.bytes_b.__getitem__, ids)) == chunk.encode("utf-8", "surrogatepass")
            self.fresh[chunk] = array("i", ids).tobytes() if same else None

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides of a slice of texts; none for texts that are empty or that a side spells differently."""
        cut = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        self.fresh = {}
        young, old = self.chunks, self.chunks.old
        self._encode([c for c in set().union(*cut) if c not in young and c not in old])
        out = []
        for text, chunks in zip(texts, cut):
            try:
                found = list(map(self.chunks.__getitem__, chunks))
            except KeyError:  # what was remembered fell out of both halves while the slice was read
                self._encode(list(set(chunks).difference(self.fresh)))
                found = list(map(self.chunks.__getitem__, chunks))
            a = self.side_a(text) if chunks and None not in found else None
            out.append(None if a is None else (a, np.frombuffer(b"".join(found), np.int32)))
        return out

    def align(self, found: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, str]:
        """Ids of either side, the number of groups, the linked pairs as ``a * size_b + b``, and the digest of the groups."""
        if found is None:
            none = np.zeros(0, np.int32)
            return none, none, 0, np.zeros(0, np.int64), ""
        a, b = found
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        to_a, to_b = groups(ends_a, ends_b)
        at_a, at_b = links(ends_a, ends_b)
        return a, b, len(to_a), a[at_a].astype(np.int64) * len(self.bytes_b) + b[at_b], self._digest(a, b, to_a, to_b)

    def _digest(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> str:
        """sha256 of the groups as ``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[to_a - 1] = last_b[to_b - 1] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, to_b)[group_a]] = last_a * len(self.bytes_a) + a
        order[np.arange(len(b)) + to_a[group_b]] = 2 * len(self.bytes_a) + last_b * len(self.bytes_b) + b
        return hashlib.sha256("".join(map(self.written.__getitem__, order.tolist()))[:-1].encode()).hexdigest()


def pair(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers per worker process and files."""
    return per_process("alignment", ("pair", path_a, path_b), lambda: Pair(path_a, path_b))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Aligned tokens of every text: ``row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and the document's distinct linked pairs
    ``pairs`` (``a * size_b + b``, ascending) with how often each is linked, ``times``.

    ``row`` numbers the rows. Texts that are null, empty, or spelled differently by a tokenizer have no tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        for batch in batches:
            at = 0
            for part in text_slices(batch.column(2)):
                numbers: list[tuple[int, int, int, int]] = []
                digests, pairs, times = [], [], []
                for ids in both.ids(part):
                    a, b, n, linked, digest = both.align(ids)
                    found, often = np.unique(linked, return_counts=True)
                    numbers.append((len(a), len(b), n, len(linked)))
                    digests.append(digest)
                    pairs.append(found)
                    times.append(often)
                offsets = np.append(0, np.cumsum([len(p) for p in pairs])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x), t)) for x, t in ((pairs, pa.int64()), (times, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)),
                     *(pa.array(list(c), pa.int64()) for c in zip(*numbers)), pa.array(digests, pa.string()), *lists],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                at += len(part)

    rows = bounded_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
                                " pairs array<long>, times array<int>")


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``key, count_sum, n_best``: in how many documents a pair of ids is linked, and 1 where no pair of its A id is in more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held or [np.zeros(0, np.int64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["key", "n"])

        for batch in batches:
            held.append(_flat(batch.column(0)))
            if sum(map(len, held)) >= PAIRS_HELD:
                yield counted()
        yield counted()

    seen = aligned.select("pairs").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("count_sum"))
    counts = materialise(seen.withColumn("a", F.floor(F.col("key") / F.lit(size_b))))
    most = counts.groupBy("a").agg(F.max("count_sum").alias("most"))  # a row per id of the vocabulary at most
    return counts.join(F.broadcast(most), "a").select("key", "count_sum", (F.col("count_sum") == F.col("most")).cast("long").alias("n_best"))


def aligned_counts(docs: DataFrame, path_a: str, path_b: str, tier: int = FREQUENT_PAIRS) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``count_sum`` adds up over the links in how many documents their ids are linked; ``n_best`` are the links whose ids are linked in as many documents
    as any pair of the same A id. Texts that are null, empty, or spelled differently by a tokenizer have zeros and an empty digest. Repeated rows
    and ids give (and count as) a row each; null ids stay null; other columns are ignored; an empty table gives no rows.
    """
    import sentencepiece

    size_b = len(sentencepiece.SentencePieceProcessor(model_file=path_b))
    aligned = materialise(align(docs, path_a, path_b))
    values = materialise(pair_counts(aligned, size_b))
    is_frequent, _ = frequent(values, "count_sum", tier)
    heavy = values.where(is_frequent).toArrow()  # at most `tier` rows
    order = np.argsort(heavy["key"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(heavy[c].to_numpy()[order] for c in ("key", "count_sum", "n_best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_docs, best = shared.value
        for batch in batches:
            rows, pairs, times = batch.column(0).to_numpy(), _flat(batch.column(1)), _flat(batch.column(2)).astype(np.int64)
            owner = np.repeat(np.arange(len(rows)), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hot = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = []
            for value in (n_docs, best):
                total = np.zeros(len(rows), np.int64)
                np.add.at(total, owner[hot], times[hot] * value[at[hot]])
                sums.append(total)
            none = pa.nulls(int((~hot).sum()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(x), pa.array(y) if isinstance(y, np.ndarray) else y]) for x, y in (
                    (rows, rows[owner[~hot]]), (-1 - rows, pairs[~hot]), (np.zeros(len(rows), np.int64), times[~hot]), (sums[0], none), (sums[1], none))],
                ["row", "key", "n", "count_sum", "n_best"])

    parts = aligned.select("row", "pairs", "times").mapInArrow(look_up, "row long, key long, n long, count_sum long, n_best long")
    sums = sums_by_row(parts, values.where(~is_frequent), ["count_sum", "n_best"])
    return aligned.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
