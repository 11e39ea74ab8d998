"""Near-duplicates by SimHash, searched with keys from the binary Golay code.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. The perfect Golay code of length 23 has a codeword
within three bits of every word, so a segment (padded with zeros) is decoded to a 12 bit index. The indices of a
segment and of all words one bit away are its *near* keys, one to six of them; segments at most two bits apart share
one, and the *own* index of one of two segments a bit apart is a near key of the other.

Two fingerprints at most four bits apart spread their differing bits over three segments in one of these ways:

* some segment X is equal, and another one, Y, differs in at most two bits: they share (X, a near key of Y);
* no segment is equal, so two of them, X and Y, differ in one bit each and the third, Z, in at most two: own X and near Y
  of one meet near X and own Y of the other, and Z has a near key in common.

Every distinct fingerprint sends its keys of both kinds; equal keys meet, and candidates are verified by their bits. A key group
is read as a stream, and from its links a task keeps a spanning forest, so that a dense group of m fingerprints gives m - 1 edges and not
m^2 / 2. Connected components of these edges are those of all links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from locusframe.llm.common import bounded_batches, materialise, per_process, text_slices
from locusframe.llm.components import components

SEGMENTS = (22, 21, 21)
TOLERANCE = 4
# Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
# Fingerprints of one key group that are compared with each other at a time.
BLOCK = 2048


def _codewords() -> np.ndarray:
    """The 4096 codewords: multiples of the generator polynomial."""
    message = np.arange(4096, dtype=np.int64)
    word = np.zeros(4096, np.int64)
    for bit in range(12):
        word ^= np.where((message >> bit) & 1, GENERATOR << bit, 0)
    return word


def decoder() -> np.ndarray:
    """Index of the nearest codeword of each of the 2^23 words (every word has one within three bits)."""
    table = np.full(1 << 23, -1, np.int16)
    words = _codewords()
    for weight in range(4):
        for flips in itertools.combinations(range(23), weight):
            table[words ^ sum(1 << f for f in flips)] = np.arange(4096, dtype=np.int16)
    return table


def _near(segment: np.ndarray, bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own index of each segment, and the sorted indices of it and all words a bit away (repeats are -1)."""
    around = np.stack([segment, *(segment ^ (1 << b) for b in range(bits))], axis=1)
    found = np.sort(table[around].astype(np.int64), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return table[segment].astype(np.int64), found


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of an array of fingerprints (uint64): number of the fingerprint, key, side.

    Side 2 meets side 2; side 0 meets side 1. A key holds its kind in the top bits, so kinds never meet.
    """
    table = per_process("simhash", ("golay",), decoder)
    cut, at = [], 64
    for bits in SEGMENTS:
        at -= bits
        cut.append(((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64))
    own, near = zip(*(_near(c, bits, table) for c, bits in zip(cut, SEGMENTS)))
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    number = np.arange(len(prints))
    kind = 0
    for x, y in itertools.permutations(range(3), 2):  # X equal, Y at most two bits apart
        row, col = np.nonzero(near[y] >= 0)
        out.append((number[row], (kind << 58) | (cut[x][row] << 12) | near[y][row, col], 2))
        kind += 1
    for z in range(3):  # X and Y one bit apart each, Z at most two
        x, y = (s for s in range(3) if s != z)
        zr, zc = np.nonzero(near[z] >= 0)
        for side, (a, b) in enumerate(((own[x][:, None], near[y]), (near[x], own[y][:, None]))):
            wide = (a << 12 | b) if side == 0 else (a << 12 | np.broadcast_to(b, a.shape))
            ok = (near[y] if side == 0 else near[x]) >= 0
            r, c = np.nonzero(ok[zr])
            out.append((number[zr][r], (kind << 58) | (wide[zr][r, c] << 12) | near[z][zr, zc][r], side))
        kind += 1
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]),
            np.concatenate([np.full(len(o[0]), o[2], np.int8) for o in out]))


def fingerprint_of(text: str, size: int = 4) -> bytes:
    """SimHash of the words' shingles, 8 bytes with the highest bit first; zeros where there are no words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    if len(words) <= size:
        pieces = [line]
    else:
        starts = [0, *(e + 1 for e in ends[:-1])]
        pieces = [line[a:b] for a, b in zip(starts, ends[size - 1:])]
    bits = np.frombuffer(b"".join(map(xxhash.xxh64_digest, pieces, itertools.repeat(42))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 4096):
        ones += np.unpackbits(bits[at : at + 4096], axis=1).sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(bits)).tobytes()


def fingerprint(text: Column) -> Column:
    """64 bit SimHash of a text column as a signed long; null is the empty text, whose fingerprint is 0."""

    @arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        packed = b"".join(fingerprint_of(t) for part in text_slices(texts) for t in part)
        return pa.array(np.frombuffer(packed, ">i8").astype(np.int64), pa.int64())

    return simhash(text)


def _send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 1024):
            part = prints[at : at + 1024]
            number, key, side = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(part[number])], ["key", "side", "fp"])


class _Forest:
    """Union-find over the fingerprints of one key group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        while (b := up.get(a, a)) != a:
            up[a] = up.get(b, b)
            a = b
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[a] = b
        return a != b


def _group_links(side: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within one key group, block against block."""
    forest, edges = _Forest(), []
    left, right = (fp, fp) if side[0] == 2 else (fp[side == 0], fp[side == 1])
    for i in range(0, len(left), BLOCK):
        a = left[i : i + BLOCK]
        for j in range(i if side[0] == 2 else 0, len(right), BLOCK):
            b = right[j : j + BLOCK]
            near = np.bitwise_count(a[:, None].view(np.uint64) ^ b[None, :].view(np.uint64)) <= TOLERANCE
            for x, y in zip(*np.nonzero(near)):
                p, q = int(a[x]), int(b[y])
                if p != q and forest.join(p, q):
                    edges.append((p, q))
    return edges


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by key. Rows of the last key of a batch wait for the next batch."""

    def groups() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            key, side, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(key):
                continue
            held.append((key, side, fp))
            if key[-1] == held[0][0][0]:
                continue
            key, side, fp = (np.concatenate(c) for c in zip(*held))
            end = int(np.searchsorted(key, key[-1]))
            held = [(key[end:], side[end:], fp[end:])]
            yield from split(key[:end], side[:end], fp[:end])
        if held:
            yield from split(*(np.concatenate(c) for c in zip(*held)))

    def split(key: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(first[1:], len(key))
        for k in np.flatnonzero(last - first > 1):
            yield side[first[k] : last[k]], fp[first[k] : last[k]]

    edges: list[tuple[int, int]] = []
    for side, fp in groups():
        edges += _group_links(side, fp)
        if len(edges) >= 65536:
            yield _edge_batch(edges)
            edges = []
    yield _edge_batch(edges)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(sorted(set(edges)), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def links(prints: DataFrame, partitions: int | None = None) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) that connect the same groups as all links do."""
    spark = prints.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = prints.select("fp").mapInArrow(_send_keys, "key long, side byte, fp long")
    return sent.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fingerprint (16 hex digits), component_id``.

    Documents whose fingerprints differ in at most four bits are linked, and ``component_id`` is the smallest id that links
    reach from a document. Null and empty texts have fingerprint zero, which is linked like any other. Repeated rows give a row
    each; a null id takes part but never names a component, so a component of null ids only has a null name.
    """
    printed = materialise(bounded_batches(docs).select("doc_id", fingerprint(F.col("text")).alias("fp")))
    classes = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    members = named.join(ids, "root").select("fp", "component_id")
    return printed.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
