"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, one after another, into a deterministic automaton whose arcs are labelled with tokens. It
starts as one state with an arc per byte. The gadget of a merge ``u v`` gives ``u`` a state of its own, a copy of
the state that ``u`` led to but without the arc ``v``, adds an arc ``uv`` wherever an arc ``u`` leaves, and spells the new label into
the table of byte transitions. Arcs with one label always end in one state, so ``state_of`` holds the end of every arc; a
state is the token that it was copied for and the step of its copy. A path that spells a word is its tokenization.

A word is encoded by running over its bytes, one step of the byte table each. A position's entry names the arcs whose labels
end there, and the accepted path of every prefix is unique, so the first of them that leaves the state at its start is
the last arc of the prefix. Ids are turned back to text by emitting the labels of their arcs.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from locusframe.llm.common import bounded_batches, per_process, text_slices
from locusframe.llm.pretokens import Vocabulary, to_bytes

# Bytes of the young half of a worker's words with their ids, and the arc tests that it keeps before it starts anew.
WORD_CACHE, ARC_CACHE = 40 << 20, 1 << 16


class Automaton:
    """The compiled automaton of a vocabulary. ``word_end`` marks the last symbol of every word, where there is one.

    ``compact`` keeps one copy of blocks that rows of the byte table share: a step takes two lookups, the table a sixth of the memory.
    """

    def __init__(self, vocab: Vocabulary, compact: bool = False):
        size = max(vocab.ids.values()) + 1
        self.size = size
        self.label: list[bytes] = [b""] * size
        end = vocab.word_end
        self.marked = [False] * size
        known = []
        for letters, token in vocab.ids.items():
            self.marked[token] = bool(end) and letters.endswith(end)
            try:
                self.label[token] = to_bytes(letters[: -len(end)] if self.marked[token] else letters)
            except KeyError:  # a special string: no arc has it
                continue
            known.append(token)
        self.length = list(map(len, self.label))
        self.left, self.right, self.made = [-1] * size, [-1] * size, [-1] * size
        self.rule: dict[int, int] = {}
        # state 0 has an arc for every byte; any other is the copy made for an arc at a step
        self.copied_for, self.copied_at = [-1], [-1]
        self.state_of = [0] * size
        # the byte table while it grows: parent, byte and depth of each entry, and the arcs that end there
        self._edges: dict[int, int] = {}
        self._parent, self._byte = [0], [0]
        self._arcs_at: dict[int, list[int]] = {}
        self._entry = [0] * size
        for token in known:
            if self.length[token] == 1:
                self._spell(token, 0, self.label[token])
        for step, (a, b) in enumerate(vocab.merges):
            self._gadget(vocab.ids[a], vocab.ids[b], vocab.ids[a + b], step)
        self._known_arcs: dict[int, bool] = {}
        self._fill_table(compact)

    def _spell(self, token: int, entry: int, label: bytes) -> None:
        """Extend the byte table by a label, from an entry on, and let ``token`` end there."""
        for b in label:
            key = entry << 8 | b
            after = self._edges.get(key)
            if after is None:
                after = self._edges[key] = len(self._parent)
                self._parent.append(entry)
                self._byte.append(b)
            entry = after
        self._entry[token] = entry
        self._arcs_at.setdefault(entry, []).append(token)

    def _gadget(self, u: int, v: int, uv: int, step: int) -> None:
        if not self._leaves(self.state_of[u], v):  # no path has u before v: the merge changes nothing
            return
        after = self.state_of[v]
        self.copied_for.append(u)
        self.copied_at.append(step)
        self.state_of[u] = len(self.copied_for) - 1
        self.left[uv], self.right[uv], self.made[uv], self.state_of[uv] = u, v, step, after
        self.rule[u * self.size + v] = step
        self._spell(uv, self._entry[u], self.label[v])

    def _leaves(self, state: int, t: int) -> bool:
        """Whether a state has an arc ``t``.

        A copy made for ``u`` lost the arc of its own merge and those of earlier copies for ``u``. A ``t`` younger than the
        state has its arc where its left part had one; a younger ``u`` led to the state of its right part when it was made.
        """
        if state == 0:
            return True
        made, rule, size = self.made, self.rule, self.size
        u, lost_until, now = self.copied_for[state], self.copied_at[state], 1 << 60
        while True:
            if rule.get(u * size + t, now) <= lost_until:
                return False
            if made[t] >= max(made[u], 0):
                lost_until, t = min(lost_until, made[t]), self.left[t]  # the copies cut until then are among those that got its arc
            elif made[u] >= 0:
                lost_until, u = made[u] - 1, self.right[u]
            else:
                return True

    def _fill_table(self, compact: bool) -> None:
        """The byte table as arrays: from every entry (a beginning of labels) and byte to the longest beginning that ends
        there, and for each entry the arcs whose labels end there, longest first, without and with the word's end.

        An entry that no longer beginning follows goes on as the one that it falls back to, so only the others have a row; ``row`` holds where
        an entry's row starts. A row is sixteen blocks of sixteen bytes, and a block in which nothing follows the entry is that of the entry it
        falls back to; ``block`` holds where each block starts in ``table``.
        """
        n = len(self._parent)
        parent, byte = np.array(self._parent), np.array(self._byte)
        del self._edges, self._parent, self._byte, self._entry
        depth = np.zeros(n, np.int64)
        for k in range(1, n):  # a parent comes before its children
            depth[k] = depth[parent[k]] + 1
        inner = np.zeros(n, bool)
        inner[0] = inner[parent[1:]] = True
        row = np.cumsum(inner) - 1
        fail = np.zeros(n, np.int64)
        block = np.zeros((int(inner.sum()), 16), np.int32)
        own_blocks = row[parent[1:]] << 4 | byte[1:] >> 4
        table, filled = np.zeros((1 + len(np.unique(own_blocks)), 16), np.int32), 1
        self.ends: list[tuple[int, ...]] = [()] * n
        self.word_ends: list[tuple[int, ...]] = [()] * n
        level = np.zeros(1, np.int64)
        for d in range(1, int(depth.max(initial=0)) + 2):
            if d > 1:
                row[level] = np.where(inner[level], row[level], row[fail[level]])
                own = level[inner[level]]
                block[row[own]] = block[row[fail[own]]]
            after = np.flatnonzero(depth == d)
            named, high, low = row[parent[after]], byte[after] >> 4, byte[after] & 15
            if d > 1:
                fail[after] = table[block[named, high], low]
            changed, which = np.unique(named << 4 | high, return_inverse=True)
            at = filled + np.arange(len(changed))
            table[at] = table[block.reshape(-1)[changed]]
            table[at[which], low] = after
            block.reshape(-1)[changed] = at
            filled += len(changed)
            level = after
        for k in np.argsort(depth, kind="stable").tolist():
            own, less = self._arcs_at.get(k, ()), int(fail[k])
            self.ends[k] = tuple(t for t in own if not self.marked[t]) + self.ends[less] if own else self.ends[less]
            self.word_ends[k] = tuple(t for t in own if self.marked[t]) + self.word_ends[less] if own else self.word_ends[less]
        del self._arcs_at
        self.row = memoryview((row << 8).astype(np.int32))
        if not compact:
            table, block = table[block], np.arange(block.size, dtype=np.int32)
        self.block = memoryview((block << 4).reshape(-1))
        self.table = memoryview(table.reshape(-1))

    def encode(self, word: bytes, marked: bool = False) -> tuple[int, ...]:
        """The labels of the accepted path that spells ``word``; ``marked``: its last symbol carries the word's end."""
        n = len(word)
        last, states = [-1] * (n + 1), [0] * (n + 1)
        table, block, row, ends, length = self.table, self.block, self.row, self.ends, self.length
        state_of, size, known = self.state_of, self.size, self._known_arcs
        entry = 0
        for i, b in enumerate(word, 1):
            entry = table[block[(row[entry] | b) >> 4] | b & 15]
            for t in self.word_ends[entry] if marked and i == n else ends[entry]:
                state = states[i - length[t]]
                if state:
                    has = known.get(state * size + t)
                    if has is None:
                        if len(known) >= ARC_CACHE:
                            known.clear()
                        has = known[state * size + t] = self._leaves(state, t)
                    if not has:
                        continue
                elif i > length[t] and last[i - length[t]] < 0:
                    continue
                last[i], states[i] = t, state_of[t]
                break
        out = []
        while n > 0:
            out.append(last[n])
            n -= length[last[n]]
        return tuple(reversed(out))


class TwoAges(dict):
    """A cache bounded in bytes: when the young half reaches ``limit`` it becomes the old one, and an old word that is asked
    for turns young again. ``make`` finds what neither half has; a word too long for a half isn't kept."""

    def __init__(self, make: Callable[[object], object], limit: int):
        super().__init__()
        self.make, self.limit, self.old, self.bytes = make, limit, {}, 0

    def __missing__(self, word):
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        # about what Python takes for the entry, the word and up to one number a character
        cost = 220 + 9 * len(word)
        if cost <= self.limit:
            if self.bytes + cost > self.limit:
                self.old = dict(self)
                self.clear()
                self.bytes = 0
            self.bytes += cost
            self[word] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary in one worker."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        auto = Automaton(self.vocab, compact=True)

        one = list(range(auto.size))  # cached words share their numbers

        def ids(word):
            if isinstance(word, tuple):
                return (word[1],)
            return tuple(map(one.__getitem__, auto.encode(word.encode("utf-8", "surrogatepass"))))

        self.words = TwoAges(ids, WORD_CACHE)
        self.labels = auto.label + [b""] * (1 + max(self.vocab.specials.values(), default=0) - auto.size)
        for text, token in self.vocab.specials.items():
            self.labels[token] = text.encode()
        self.decimals = [str(i) for i in range(len(self.labels))]

    def encode(self, text: str, specials: bool = True) -> list[int]:
        """Token ids; special strings are ordinary text unless ``specials``."""
        split = self.vocab.split(text, lambda s: ("special", self.vocab.specials[s])) if specials else self.vocab.plain(text)
        return list(itertools.chain.from_iterable(map(self.words.__getitem__, split)))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One codec per worker process and file, without the lists that its automaton was made from."""

    def make() -> Codec:
        c = Codec(path)
        c.vocab.ids, c.vocab.merges = {}, []
        return c

    return per_process("bpe", ("codec", path), make)


def encode_column(text: Column, path: str) -> Column:
    """Token ids of a text column as ``array<int>``; null is the empty text and has no ids."""

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.encode(t) for part in text_slices(texts) for t in part], pa.list_(pa.int32()))

    return ids(text)


def decode_column(ids: Column, path: str) -> Column:
    """Text of an ``array<int>`` column; special tokens appear as their strings, null as the empty text."""

    @arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.decode(x or ()) for x in lists.to_pylist()], pa.string())

    return text(ids)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text and decode the ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Encoding and decoding run in one pass in the workers, so that ids of long texts never travel. A null text is
    the empty text (no tokens); repeated rows and repeated ids give a row each; other columns are ignored.
    """

    @arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pa.Array) -> pa.Array:
        c = codec(path)
        n, first, second = [], [], []
        for part in text_slices(texts):
            for t in part:
                ids = c.encode(t)
                n.append(len(ids))
                first.append(hashlib.sha256(",".join(map(c.decimals.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                                          ["n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded_batches(docs).select("doc_id", digest(F.col("text")).alias("_d")).select("doc_id", "_d.*")
