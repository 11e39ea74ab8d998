"""Document fingerprints from prefix polynomial hashes.

The hash of the first i code points of a text is the sum of ``code * base^position`` modulo a prime, for two primes.
Differences of the prefix array give the hash of any span, up to a power of the base, so spans are compared in constant time, and
binary search over span comparisons finds the longest common extension of two positions. A fingerprint keeps the smallest mixed hashes
of all spans of a fixed length (every span of the text, not a sample): equal texts have equal fingerprints, and the
share of common values among the smallest of two fingerprints estimates the share of common spans. Texts of fewer than two such
spans have shorter spans as well, so that a change of a few letters leaves common ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from locusframe.llm.common import bounded_batches, materialise, per_process, text_slices

# Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
# Code points of a span, and values that a fingerprint keeps.
SPAN, KEPT = 16, 64


def _tables(n: int) -> list[list[np.ndarray]]:
    """Powers of the bases and their inverses for positions below n, kept by the process."""
    held = per_process("prefix hashes", ("prefix powers",), lambda: [[np.ones(1, np.uint64)] * 2, [np.ones(1, np.uint64)] * 2])
    size = len(held[0][0])
    if size < n:
        size = 1 << int(n - 1).bit_length()
        for k, (p, b) in enumerate(zip(PRIMES, BASES)):
            for j, step in enumerate((b, pow(b, -1, p))):
                out = np.ones(size, np.uint64)
                have = 1
                while have < size:  # doubling: the second half is the first one times a power
                    out[have : 2 * have] = out[:have] * np.uint64(pow(step, have, p)) % np.uint64(p)
                    have *= 2
                held[k][j] = out
    return held


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHashes:
    """Prefix arrays of one text under both primes."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        tables = _tables(self.n + 1)
        self.sums, self.inverse = [], []
        for (power, inverse), p in zip(tables, PRIMES):
            terms = (codes.astype(np.uint64) + np.uint64(1)) * power[: self.n] % np.uint64(p)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))
            self.inverse.append(inverse)

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes (62 bits) of the spans of one length that begin at ``starts``."""
        h = []
        for k, p in enumerate(PRIMES):
            raw = (self.sums[k][starts + length] - self.sums[k][starts]) % np.uint64(p)
            h.append(raw * self.inverse[k][starts] % np.uint64(p))
        return (h[0] << np.uint64(31)) | h[1]


def same_span(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    """Whether the spans of one length at position i of one text and j of another are equal."""
    for k, p in enumerate(PRIMES):
        x = int(a.sums[k][i + length]) - int(a.sums[k][i])
        y = int(b.sums[k][j + length]) - int(b.sums[k][j])
        if (x * int(a.inverse[k][i]) - y * int(b.inverse[k][j])) % p:
            return False
    return True


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common extension of position i of one text and j of another, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if same_span(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread span hashes over 32 bits, so that the smallest are a fair choice."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(32)


def span_lengths(n: int) -> list[int]:
    """Lengths of the spans of a text of n code points: ``SPAN``, for texts of fewer than two spans also a quarter of it, for those of less
    than half a span single code points; a text shorter than a span is a span itself."""
    lengths = {min(SPAN, n)}
    if SPAN // 4 <= n < 2 * SPAN:
        lengths.add(SPAN // 4)
    if 0 < n < SPAN // 2:
        lengths.add(1)
    return sorted(lengths)


def fingerprint_of(arrays: PrefixHashes) -> str:
    """The ``KEPT`` smallest distinct values of the text's spans in hexadecimal, ascending."""
    values = _mix(np.concatenate([arrays.spans(np.arange(arrays.n - length + 1), length) for length in span_lengths(arrays.n)]))
    for keep in (4 * KEPT, len(values)):  # repeats are rare: four times as many values mostly hold enough distinct ones
        few = np.partition(values, keep)[:keep] if keep < len(values) else values
        found = np.unique(few)
        if len(found) >= KEPT:
            break
    return found[:KEPT].astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of common spans of two texts as their fingerprints tell (1.0 for equal ones)."""
    x, y = (np.frombuffer(bytes.fromhex(f), ">u4") for f in (a, b))
    least = np.union1d(x, y)[:KEPT]
    return float(np.isin(least, np.intersect1d(x, y)).mean()) if len(least) else 1.0


def likeness_column(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns, null where one is null."""

    @arrow_udf("double")
    def like(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else likeness(p, q) for p, q in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    return like(a, b)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column; null is the empty text."""

    @arrow_udf("string")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(PrefixHashes(code_points(t))) for part in text_slices(texts) for t in part], pa.string())

    return prints(text)


def common_extensions(pairs: DataFrame) -> DataFrame:
    """Add ``extension`` to rows with texts ``a``, ``b`` and positions ``i``, ``j`` (from 0): how far the texts agree from there on.

    Null texts are empty; a position that is null, negative or past the end agrees in nothing.
    """

    @arrow_udf("long")
    def extend(a: pa.Array, i: pa.Array, b: pa.Array, j: pa.Array) -> pa.Array:
        out = []
        for x, p, y, q in zip(*(c.to_pylist() for c in (a, i, b, j))):
            x, y = (PrefixHashes(code_points(t or "")) for t in (x, y))
            inside = p is not None and q is not None and 0 <= p <= x.n and 0 <= q <= y.n
            out.append(common_extension(x, p, y, q) if inside else 0)
        return pa.array(out, pa.int64())

    return pairs.withColumn("extension", extend("a", "i", "b", "j"))


class _Doc:
    """A document on its way through a task: code points, prefix arrays, fingerprint."""

    def __init__(self, doc_id: int | None, text: str):
        self.id, self.text, self.codes = doc_id, text, code_points(text)
        self.arrays = PrefixHashes(self.codes)
        self.print = fingerprint_of(self.arrays)


def _compare(doc: _Doc, after: _Doc) -> tuple:
    """The result row of a document, given the next one."""
    cut = doc.arrays.n // 4
    codes = np.concatenate([doc.codes[: doc.arrays.n - cut], after.codes[:cut]])
    edited = PrefixHashes(codes)
    edited_print = fingerprint_of(edited)
    digest = hashlib.sha256(codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return (doc.id, doc.arrays.n, digest, bytes.fromhex(doc.print), bytes.fromhex(edited_print), likeness(doc.print, edited_print), likeness(doc.print, after.print),
            common_extension(doc.arrays, 0, edited, 0))


# fingerprints stay bytes in the scratch table, half as long as their digits
_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, "
           "near_next double, common_prefix long")
_WALKED = _RESULT + ", is_edge boolean, first_id long, first_order long, first_text string, last_text string"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(),
          pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _rows_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(",")]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES)], names)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare every document of a sorted partition with the next one; the partition's ends go on as one row."""
    first, last = None, None
    for batch in batches:
        ids, order, at, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, []
        for part in text_slices(batch.column(2)):
            for k, text in enumerate(part, at):
                doc = _Doc(ids[k], text)
                if last is None:
                    first = (ids[k], order[k], text)
                else:
                    rows.append((*_compare(last, doc), False, None, None, None, None))
                last = doc
            at += len(part)
        yield _rows_batch(rows, _WALKED)
    if last is not None:
        yield _rows_batch([(last.id, None, None, None, None, None, None, None, True, *first, last.text)], _WALKED)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_compare(_Doc(i, a), _Doc(None, b)) for i, a, b in zip(*(c.to_pylist() for c in batch.columns))]
        yield _rows_batch(rows, _RESULT)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last ``n_chars // 4`` code points replaced by the first as many (or all) of the next document in
    order of ``doc_id`` (after the last: the first). Columns: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, common_prefix``, the last being the longest common extension of both texts' starts.

    Null texts are empty. A null id comes before all others; rows that repeat an id follow each other in the order of a hash of their
    texts, and each counts as a document. A single document is its own next one. Other columns are ignored.

    Texts are shuffled once, into sorted ranges of ids. A task reads its range as a stream and holds two documents; what is
    left are the pairs that span two ranges, one for each range, which meet in a join of that many rows.
    """
    text = F.coalesce("text", F.lit(""))
    base = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_order"), text.alias("text"))
    keys = ["doc_id", "_order"]
    walked = materialise(base.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_walk, _WALKED))
    names = [c.split()[0] for c in _RESULT.split(", ")]
    edges = walked.where("is_edge").select("doc_id", "first_id", "first_order", "first_text", "last_text")
    # one row per range from here on
    in_order = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_order")
    place = edges.select("first_id", "first_order").withColumn("place", F.row_number().over(in_order))
    n = place.select(F.max("place").alias("ranges"))
    same = (F.col("e.first_id").eqNullSafe(F.col("p.first_id"))) & (F.col("e.first_order") == F.col("p.first_order"))
    placed = edges.alias("e").join(place.alias("p"), same).select("e.*", "p.place")
    after = placed.join(F.broadcast(n)).select(F.when(F.col("place") == 1, F.col("ranges")).otherwise(F.col("place") - 1).alias("place"),
                                               F.col("first_text").alias("next_text"))
    closed = placed.select("place", "doc_id", "last_text").join(after, "place").select("doc_id", "last_text", "next_text").mapInArrow(_close, _RESULT)
    shown = {n: F.lower(F.hex(n)) for n in ("fingerprint", "edited_fingerprint")}
    return walked.where("not is_edge").select(*names).unionByName(closed).withColumns(shown)
