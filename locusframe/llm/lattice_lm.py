"""Language-model scores of whole texts by subword lattices.

A word is a lattice over the bytes of a space and the word: every piece of an existing subword vocabulary that fits is an arc. A piece's weight
starts from its score in the vocabulary file (scores are ranks, so a weight falls with the rank as in Zipf's law) and is brought
to the training texts by expectation and maximisation over their distinct words; the vocabulary itself stays as it is. A forward recursion in log
space adds up all segmentations, which gives the marginal probability ``S`` of spelling the word.

A word of the training texts has one more arc that spans it whole, weighted by its count. Counts give up a discount ``D`` (estimated from how
many words occur once and twice) to words spelled or met elsewhere. Training texts fall into classes, such as languages, with weights of their own,
and the marginal of a word in class k over all paths is ``(max(c_k - D_k, 0) + D_k * V_k * (c / N + S_k) / 2) / N_k`` for ``V_k``
distinct words and ``N_k`` words. A text is its words and an end, in one class that the score doesn't know: the probability of the text is the
sum over the classes. The probabilities of all texts add up to one at most.

Word counts are the only thing that is gathered, and they grow with the corpus: they stay a table, and documents look their
words up in two tiers (see ``two_tier``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.byte_words import ByteText
from locusframe.llm.common import bounded_batches, materialise, per_process, text_slices
from locusframe.llm.two_tier import frequent, sums_by_row

# Distinct words that a task counts at a time, words of a lattice batch and its bytes, and the broadcast tier.
WORDS_HELD, LATTICE_WORDS, LATTICE_BYTES, FREQUENT_WORDS, FREQUENT_BYTES = 1 << 18, 4096, 1 << 18, 1 << 15, 64


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lowered: runs of anything but ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Pieces:
    """The pieces of a sentencepiece file that can lie within a word after its space, by their beginnings."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled: dict[bytes, float] = {}
        single: list[bytes] = []
        for i in range(len(model)):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            text = model.id_to_piece(i)
            if model.is_byte(i):
                single.append(bytes([int(text[3:5], 16)]))
                continue
            piece = text.replace("▁", " ").encode()
            if b" " not in piece[1:]:
                spelled[piece] = 1 / (1 - min(0.0, model.get_score(i)))
        least = min(spelled.values(), default=1.0)
        for b in single:  # bytes are the way out for characters without a piece
            spelled.setdefault(b, least)
        self.spelled = list(spelled)
        weights = np.array(list(spelled.values()))
        self.prior = weights / weights.sum()
        number = {p: i for i, p in enumerate(self.spelled)}
        beginnings: list[dict[bytes, int]] = []
        for p in self.spelled:
            for k in range(1, len(p) + 1):
                if len(beginnings) < k:
                    beginnings.append({})
                beginnings[k - 1].setdefault(p[:k], number.get(p[:k], -1))
        self.levels = []
        for level in beginnings:
            hashes = np.array([_hash(b) for b in level], np.uint64)
            order = np.argsort(hashes)
            self.levels.append((hashes[order], np.array(list(level.values()))[order]))


def _hash(piece: bytes) -> np.uint64:
    data = ByteText.of([piece])
    return data.hashes(np.zeros(1, np.int64), np.array([len(piece)]))[0]


def pieces(path: str) -> Pieces:
    """One table per worker process and file."""
    return per_process("words", ("pieces", path), lambda: Pieces(path))


class Lattice:
    """The lattices of a batch of words side by side: nodes are bytes, arcs are pieces."""

    def __init__(self, words: list[bytes], table: Pieces):
        data = ByteText.of([b" " + w for w in words])
        self.first, self.last = data.starts, data.starts + data.lengths - 1
        self.nodes = len(data.bytes)
        word = np.repeat(np.arange(len(words)), data.lengths)
        room = self.last[word] - np.arange(self.nodes)
        alive = np.flatnonzero(room > 0)
        start, end, piece = [], [], []
        for k, (hashes, number) in enumerate(table.levels, 1):
            alive = alive[room[alive] >= k]
            if not len(alive):
                break
            h = data.hashes(alive, alive + k)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            here = hashes[at] == h
            alive, at = alive[here], at[here]
            found = number[at] >= 0
            start.append(alive[found])
            end.append(alive[found] + k)
            piece.append(number[at[found]])
        self.start, self.end, self.piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (start, end, piece))
        self.rise = self.end - self.first[word[self.start]]
        self.fall = self.last[word[self.start]] - self.start

    def _sweep(self, begin: np.ndarray, source: np.ndarray, target: np.ndarray, level: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Log of the summed weights of all paths from ``begin`` to each node, level by level over all words at once."""
        total = np.full(self.nodes, -np.inf)
        total[begin] = 0.0
        order = np.argsort(level * np.int64(self.nodes) + target)
        source, target, weight, level = source[order], target[order], weight[order], level[order]
        cuts = np.append(np.flatnonzero(np.diff(level, prepend=-1)), len(level))
        for a, b in zip(cuts[:-1], cuts[1:]):
            x, to = total[source[a:b]] + weight[a:b], target[a:b]
            group = np.flatnonzero(np.diff(to, prepend=-1))
            top = np.maximum.reduceat(x, group)
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                total[to[group]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, np.diff(np.append(group, b - a)))), group))
        return total

    def forward(self, log_weight: np.ndarray) -> np.ndarray:
        return self._sweep(self.first, self.start, self.end, self.rise, log_weight[self.piece])

    def marginals(self, log_weight: np.ndarray) -> np.ndarray:
        """Log probability of each word over all segmentations."""
        return self.forward(log_weight)[self.last]

    def expected(self, log_weight: np.ndarray) -> np.ndarray:
        """How often each piece is used over all words, every segmentation counted by its probability."""
        weight = log_weight[self.piece]
        up = self.forward(log_weight)
        down = self._sweep(self.last, self.end, self.start, self.fall, weight)
        whole = np.repeat(up[self.last], self.last - self.first + 1)
        return np.bincount(self.piece, np.exp(up[self.start] + weight + down[self.end] - whole[self.start]), len(log_weight))


def _batches(column: pa.Array) -> Iterator[list[bytes]]:
    step = max(1, min(LATTICE_WORDS, LATTICE_BYTES * len(column) // max(1, column.nbytes)))
    for at in range(0, len(column), step):
        yield column.slice(at, step).to_pylist()


@dataclass(frozen=True)
class Totals:
    """What the training texts of a class (or all) amount to: words, distinct words, texts, words that occur once and twice."""

    words: int
    distinct: int
    texts: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once else 0.5

    @property
    def base_all(self) -> int:
        """Denominator of the add-one score; the end is a token of its own."""
        return self.words + self.texts + (self.distinct + (self.texts > 0)) + 1

    def end(self) -> float:
        """Probability that a text ends rather than goes on with a word."""
        return (self.texts + 1) / (self.words + self.texts + 2)

    def log10(self, c: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """Log10 probability of words that the class holds ``c`` times; ``elsewhere``: log of what the discount is spread by."""
        with np.errstate(divide="ignore"):  # no word arc: a weight of zero
            whole = np.log(np.maximum(c - self.discount, 0) / max(1, self.words))
        spread = np.log(self.discount * self.distinct / self.words) if self.words else 0.0
        return (np.logaddexp(whole, spread + elsewhere) + np.log1p(-self.end())) / np.log(10)


def class_number(kind: Column, kinds: list[str | None]) -> Column:
    """Place of a value among ``kinds``; any other value belongs to the last one."""
    out = F.lit(len(kinds) - 1)
    for k, value in reversed(list(enumerate(kinds[:-1]))):
        out = F.when(kind.eqNullSafe(F.lit(value)), k).otherwise(out)
    return out.cast("int")


def _c(kinds: int) -> list[str]:
    return [f"c{k}" for k in range(kinds)]


def word_counts(docs: DataFrame, kind: Column, kinds: int) -> DataFrame:
    """``key`` (the word as bytes), ``n`` in all rows, and ``c0 ..`` in the rows of each class; rows of no class (-1) aren't learned from.

    A task counts before it sends.
    """
    names = ["key", "n", *_c(kinds)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(kinds + 1)]

        def counted() -> pa.RecordBatch:
            words = list(set().union(*seen))
            columns = np.array([list(map(s.__getitem__, words)) for s in seen], np.int64).reshape(kinds + 1, -1)
            for s in seen:
                s.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *map(pa.array, [columns.sum(0), *columns[:-1]])], names)

        for batch in batches:
            numbers, at = batch.column(1).to_pylist(), 0
            for part in text_slices(batch.column(0)):
                for text in part:
                    seen[numbers[at]].update(words_of(text))
                    at += 1
                if sum(map(len, seen)) > WORDS_HELD:
                    yield counted()
        yield counted()

    schema = "key binary, " + ", ".join(f"{c} long" for c in names[1:])
    rows = bounded_batches(docs).select("text", kind.alias("kind")).mapInArrow(count, schema)
    return rows.groupBy("key").agg(*(F.sum(c).alias(c) for c in names[1:]))


def fit_pieces(lexicon: DataFrame, path: str, kinds: int, rounds: int = 2, strength: float = 1000.0) -> np.ndarray:
    """Log weights of the pieces, a row for each class: ``rounds`` of expectation and maximisation over its distinct words, from the
    vocabulary's scores, which also count as ``strength`` uses."""
    prior = pieces(path).prior
    context = lexicon.sparkSession.sparkContext
    weight = np.tile(prior, (kinds, 1))
    for _ in range(rounds):
        shared = context.broadcast(np.log(weight))  # a number per piece and class

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, total = pieces(path), np.zeros(shared.value.shape)
            for batch in batches:
                for k in range(kinds):
                    own = batch.column(0).filter(pc.greater(batch.column(1 + k), 0))
                    for words in _batches(own):
                        total[k] += Lattice(words, table).expected(shared.value[k])
            kind, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(piece), pa.array(total[kind, piece])], ["kind", "piece", "uses"])

        uses = lexicon.select("key", *_c(kinds)).mapInArrow(expect, "kind long, piece long, uses double")
        uses = uses.groupBy("kind", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        weight = np.tile(strength * prior, (kinds, 1))
        weight[uses["kind"].to_numpy(), uses["piece"].to_numpy()] += uses["uses"].to_numpy()
        weight /= weight.sum(axis=1, keepdims=True)
    return np.log(weight)


def word_values(lexicon: DataFrame, path: str, log_weight: np.ndarray, totals: list[Totals], overall: Totals) -> DataFrame:
    """``key, n, n_known, base_score, s0 ..``: log10 probabilities of every word by the add-one base and by its lattice in each class."""
    shared = lexicon.sparkSession.sparkContext.broadcast(log_weight)
    names = ["key", "n", *sums_of(len(totals))]

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for batch in batches:
            spelled = [np.stack([lattice.marginals(w) for w in shared.value]) for lattice in (Lattice(x, table) for x in _batches(batch.column(0)))]
            spelled = np.concatenate([*spelled, np.zeros((len(totals), 0))], axis=1)
            counts = np.stack([batch.column(2 + k).to_numpy() for k in range(len(totals))]).astype(float)
            c = counts.sum(0)
            with np.errstate(divide="ignore"):
                met = np.log(c / max(1, overall.words))
            half = np.log(0.5) if overall.words else 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array((c > 0).astype(np.int64)), pa.array(np.log10((c + 1) / overall.base_all)),
                 *(pa.array(t.log10(counts[k], np.logaddexp(met, spelled[k]) + half)) for k, t in enumerate(totals))], names)

    schema = "key binary, n long, n_known long, " + ", ".join(f"{c} double" for c in names[3:])
    return lexicon.select("key", "n", *_c(len(totals))).mapInArrow(value, schema)


def sums_of(kinds: int) -> list[str]:
    return ["n_known", "base_score", *(f"s{k}" for k in range(kinds))]


def scores(docs: DataFrame, path: str, learn: Column, kind: Column | None = None, most_kinds: int = 8, tier: int = FREQUENT_WORDS,
           rounds: int = 2) -> DataFrame:
    """Per document ``doc_id, n_tokens, n_known, train_tokens, base_score, score``; the model learns from the rows where ``learn`` holds.

    ``kind`` names the class of a row to learn from, such as its language; the most frequent ``most_kinds - 1`` values are classes, all others
    are one more. The class of a row is no input of its score. A null text is the empty text: no words and an end. A null id or kind takes part like any
    other; repeated rows and ids give a row each and are counted as often; other columns are ignored; an empty table gives no rows. Without
    training texts words are spelled by the vocabulary's scores alone. A word of any length is one lattice; it takes some 150 bytes of memory a byte.
    """
    learn = F.coalesce(learn, F.lit(True))
    kind = F.lit(None).cast("string") if kind is None else kind
    seen = docs.where(learn).groupBy(kind.alias("kind")).count().orderBy(F.desc("count"), "kind").limit(most_kinds).collect()
    kinds = [r.kind for r in seen] or [None]
    number = class_number(kind, kinds)
    lexicon = materialise(word_counts(docs, F.when(learn, number).otherwise(-1), len(kinds)))
    texts = {r.kind: r["count"] for r in docs.where(learn).groupBy(number.alias("kind")).count().collect()}

    def totals(c: Column, n: int) -> list[Column]:
        return [F.coalesce(F.sum(c), F.lit(0)), *(F.count(F.when(x, 1)) for x in (c > 0,)), F.lit(n), *(F.count(F.when(c == k, 1)) for k in (1, 2))]

    every = sum((F.col(c) for c in _c(len(kinds))), F.lit(0))
    found = lexicon.agg(*(x.alias(f"_{k}_{i}") for k, c in enumerate([*map(F.col, _c(len(kinds))), every])
                          for i, x in enumerate(totals(c, texts.get(k, 0) if k < len(kinds) else sum(texts.values()))))).first()
    *each, overall = (Totals(*found[5 * k : 5 * k + 5]) for k in range(len(kinds) + 1))
    sums = sums_of(len(kinds))
    values = materialise(word_values(lexicon, path, fit_pieces(lexicon, path, len(kinds), rounds), each, overall))
    is_frequent, _ = frequent(values, "n", tier)
    is_frequent = is_frequent & (F.octet_length("key") <= FREQUENT_BYTES)
    heavy = values.where(is_frequent).toArrow()  # at most `tier` short words
    shared = docs.sparkSession.sparkContext.broadcast((heavy["key"].to_pylist(), np.stack([heavy[c].to_numpy().astype(float) for c in sums], axis=1)))
    end = [float(overall.texts > 0), float(np.log10((overall.texts + 1) / overall.base_all)), *(float(np.log10(t.end())) for t in each)]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, value = shared.value
        place = {w: i for i, w in enumerate(words)}
        for batch in batches:
            at = 0
            for part in text_slices(batch.column(2)):
                rows, ids = batch.column(0).slice(at, len(part)).to_pylist(), batch.column(1).slice(at, len(part))
                at += len(part)
                n_tokens, known = [], []
                rare_rows, rare, rare_n = [], [], []
                for row, text in zip(rows, part):
                    all_words = words_of(text)
                    n_tokens.append(len(all_words) + 1)
                    spots, times = [], []
                    for word, k in Counter(all_words).items():
                        spot = place.get(word)
                        if spot is None:
                            rare_rows.append(row)
                            rare.append(word)
                            rare_n.append(k)
                        else:
                            spots.append(spot)
                            times.append(k)
                    known.append(np.array(times, float) @ value[spots] + end if spots else np.array(end))
                known = np.stack(known) if known else np.zeros((0, len(end)))
                none = len(rare)
                # the document's own row has a key with a line end, which no word holds
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows + rare_rows, pa.int64()), pa.array([b"\n%d" % r for r in rows] + rare, pa.binary()),
                     pa.array([0] * len(rows) + rare_n, pa.int64()), pa.concat_arrays([ids, pa.nulls(none, pa.int64())]),
                     pa.array(n_tokens + [None] * none, pa.int64()),
                     pa.concat_arrays([pa.array(np.rint(known[:, 0]).astype(np.int64)), pa.nulls(none, pa.int64())]),
                     *(pa.concat_arrays([pa.array(known[:, k]), pa.nulls(none, pa.float64())]) for k in range(1, len(end)))],
                    ["row", "key", "n", "doc_id", "n_tokens", *sums])

    rows = bounded_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.mapInArrow(look_up, "row long, key binary, n long, doc_id long, n_tokens long, n_known long, "
                            + ", ".join(f"{c} double" for c in sums[1:]))
    added = sums_by_row(parts, values.where(~is_frequent), sums, own=["doc_id", "n_tokens"])
    in_class = [F.col(f"s{k}") + float(np.log10((t.texts + 1) / (overall.texts + len(kinds)))) for k, t in enumerate(each)]
    top = F.greatest(*in_class) if len(in_class) > 1 else in_class[0]
    score = top + F.log10(sum((F.pow(F.lit(10.0), s - top) for s in in_class), F.lit(0.0)))
    return added.select("doc_id", "n_tokens", "n_known", F.lit(overall.words + overall.texts).cast("long").alias("train_tokens"), "base_score",
                        score.alias("score"))
