"""Approximate nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors get one more component that makes all norms equal, so that the largest inner product is the smallest Euclidean
distance. A table projects them on Gaussian directions and cuts each projection into cells of one width; a bucket is a
tuple of cells. A query visits its own bucket and perturbed ones (steps of one cell in some directions), in the order of
their estimated success: perturbations are ranked by how near the query lies to the cell borders that they cross. What the tables
find is merged and ranked by exact inner products.

Directions, cell width and the number of visited buckets are fitted on a sample of bounded size, against brute force on
that sample: the fewest buckets that reach the wanted recall in the mean. These are visited first, and then each query is judged by itself: the
distance of its last answer bounds those of the true ones, and the chance that the visited buckets hold an entry at that distance
follows from the normal distribution of projections. A query below the wanted recall, or with too few candidates, goes on through as many
further perturbations as it needs; where all of them aren't enough it is compared with every entry, block by block. Every vector is indexed;
equal vectors are one entry with its members' smallest ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import materialise

# Index entries of a bucket that one group of rows holds (larger buckets are split), and queries compared with them at a time.
SLAB, QUERIES = 8192, 512
# Queries that one copy of the entries serves where every entry is compared, and entries of a block there at least.
GROUP, LEAST = 4096, 512
# Rows with vectors that a task sends at a time.
SENT = 16_384
# Queries whose best candidates a task holds before it hands them on.
HELD = 20_000


@dataclass(frozen=True)
class Tables:
    """Directions (tables x dimensions x K), offsets, cell width, all perturbations, the common norm, and how many are visited first."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    sets: list
    norm: float
    first: int


def perturbation_sets(k: int) -> list[tuple[int, ...]]:
    """All sets of steps, by expected cost. A step is the rank of its border among the query's 2k borders, nearest first.

    The expected square of the j-th smallest of the distances (in cells) follows from uniform order statistics; the borders of
    one direction have ranks j and 2k + 1 - j, so a set holds at most one of these.
    """
    j = np.arange(1, k + 1)
    near = j * (j + 1) / (4 * (k + 1) * (k + 2))
    far = (1 - j / (k + 1) + j * (j + 1) / (4 * (k + 1) * (k + 2)))[::-1]
    cost = np.concatenate([near, far])
    out, heap = [()], [(cost[0], (0,))]
    while heap:
        c, s = heapq.heappop(heap)
        if len({min(r, 2 * k - 1 - r) for r in s}) == len(s):
            out.append(s)
        last = s[-1] + 1
        if last < 2 * k:
            heapq.heappush(heap, (c - cost[last - 1] + cost[last], (*s[:-1], last)))
            heapq.heappush(heap, (c + cost[last], (*s, last)))
    return out


def _cells(t: Tables, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of vectors in one table, and how far (in cells) each projection lies above its lower border."""
    p = (x @ t.directions[table] + t.offsets[table]) / t.width
    cell = np.floor(p)
    return cell.astype(np.int64), p - cell


def _bucket(cells: np.ndarray, table: int) -> np.ndarray:
    """64 bit name of a bucket."""
    h = np.full(cells.shape[:-1], table + 1, np.uint64)
    for k in range(cells.shape[-1]):
        h = (h ^ cells[..., k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _steps(t: Tables, above: np.ndarray) -> np.ndarray:
    """The direction and sign of the border of every rank, for each query: rank r is direction s % K, down if s < K."""
    return np.argsort(np.concatenate([above, 1 - above], axis=1), axis=1, kind="stable")


def _probes(t: Tables, x: np.ndarray, table: int, since: int, until: int) -> np.ndarray:
    """Names of the buckets of perturbations ``since`` to before ``until``, one row per query."""
    cell, above = _cells(t, x, table)
    k = cell.shape[1]
    rank = _steps(t, above)
    out = np.empty((len(x), until - since), np.int64)
    rows = np.arange(len(x))
    for n, chosen in enumerate(t.sets[since:until]):
        moved = cell.copy()
        for r in chosen:
            s = rank[:, r]
            moved[rows, s % k] += np.where(s < k, -1, 1)
        out[:, n] = _bucket(moved, table)
    return out


def _below(z: np.ndarray) -> np.ndarray:
    """Normal distribution function."""
    return np.array([math.erfc(v) / 2 for v in (z * -math.sqrt(0.5)).ravel().tolist()]).reshape(z.shape)


def success(t: Tables, x: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The chance that the buckets visited so far hold an entry at a distance from each query (rows), by perturbations visited (columns).

    The two projections on one direction differ by a normal number with the distance for its standard deviation.
    """
    sd = np.maximum(distance / t.width, 1e-9)[:, None]
    missed = np.ones((len(x), len(t.sets)))
    for table in range(len(t.directions)):
        _, above = _cells(t, x, table)
        edge = [_below((e - above) / sd) for e in (-1, 0, 1, 2)]
        own = edge[2] - edge[1]
        moves = np.concatenate([edge[1] - edge[0], edge[3] - edge[2]], axis=1) / np.maximum(np.concatenate([own, own], axis=1), 1e-300)
        moves = np.take_along_axis(moves, _steps(t, above), axis=1)
        each = own.prod(1)[:, None] * np.stack([moves[:, list(s)].prod(1) for s in t.sets], axis=1)
        missed *= 1 - np.minimum(1, np.cumsum(each, axis=1))
    return 1 - missed


def _lift(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Vectors with the component that gives all the same norm; queries get 0, as their norm changes no order."""
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, norm * norm - (x * x).sum(1)))
    return np.column_stack([x, extra])


def fit(sample: np.ndarray, norm: float, recall: float, k: int, tables: int, neighbours: int, seed: int = 7) -> Tables:
    """Directions and cell width from a sample, and the fewest perturbations that reach ``recall`` on it."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] + 1
    directions = rng.standard_normal((tables, dim, k))
    lifted = _lift(sample, norm, False)
    spread = float(np.mean([(lifted @ d).std() for d in directions])) or 1.0
    t = Tables(directions, rng.uniform(0, 2 * spread, (tables, k)), 2 * spread, perturbation_sets(k), norm, 1)
    asked = sample[: min(512, len(sample))]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(neighbours, len(sample) - 1)]
    place = {frozenset(s): n for n, s in enumerate(t.sets)}
    found = np.full(best.shape, len(t.sets))
    for table in range(tables):
        base, _ = _cells(t, lifted, table)
        own, above = _cells(t, _lift(asked, norm, True), table)
        rank = np.argsort(_steps(t, above), axis=1)  # rank of each border
        for i in range(len(asked)):
            for c, j in enumerate(best[i]):
                step = base[j] - own[i]
                if np.abs(step).max() <= 1:
                    moved = np.flatnonzero(step)
                    ranks = frozenset(rank[i][np.where(step[moved] < 0, moved, moved + k)].tolist())
                    found[i, c] = min(found[i, c], place[ranks])
    order = np.sort(found.ravel())
    need = int(order[min(len(order) - 1, int(np.ceil(recall * len(order))))]) + 1 if len(order) else 1
    return replace(t, first=min(len(t.sets), need))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _floats(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def _best(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` largest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:keep]
    return ids[order], scores[order]


class _Held:
    """The best candidates so far of the queries that a task has met."""

    def __init__(self, keep: int):
        self.keep, self.found = keep, {}

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        old = self.found.get(query)
        if old is not None:
            ids, scores = np.concatenate([old[0], ids]), np.concatenate([old[1], scores])
            ids, first = np.unique(ids, return_index=True)
            scores = scores[first]
        self.found[query] = _best(scores, ids, self.keep)

    def batch(self) -> pa.RecordBatch:
        ids, scores = [x[0] for x in self.found.values()], [x[1] for x in self.found.values()]
        out = pa.RecordBatch.from_arrays([pa.array(list(self.found), pa.int64()), pa.array(ids, pa.list_(pa.int64())),
                                          pa.array(scores, pa.list_(pa.float64()))], ["query", "ids", "scores"])
        self.found = {}
        return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Pieces of sorted batches, each of one key (the first ``keys`` columns); True where a key begins."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(keys)])
        cuts = np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(batch))):
            key = tuple(cols[:, a])
            yield key != last, batch.slice(a, b - a)
            last = key


def _compare(keep: int):
    """Rows (bucket, slab, kind, id, vector), sorted: entries (kind 0) before the queries (kind 1) that visit them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, vectors = _Held(keep), [], []
        for new, piece in _runs(batches, 2):
            if new:
                names, vectors = [], []
            kind = piece.column(2).to_numpy(zero_copy_only=False)
            entries = int(np.searchsorted(kind, 1))
            if entries:
                names.append(piece.column(3).slice(0, entries).to_numpy(zero_copy_only=False))
                vectors.append(_matrix(piece.column(4).slice(0, entries)))
            if entries == len(piece) or not names:
                continue
            if len(names) > 1:
                names, vectors = [np.concatenate(names)], [np.concatenate(vectors)]
            index, base = names[0], vectors[0]
            asked = piece.slice(entries)
            for at in range(0, len(asked), QUERIES):
                part = asked.slice(at, QUERIES)
                q = _matrix(part.column(4))
                scores = q @ base.T
                top = np.argpartition(-scores, min(keep, len(index)) - 1, axis=1)[:, :keep]
                exact = (q[:, None, :] * base[top]).sum(2)  # in one fixed order of summation, whatever the block
                for i, query in enumerate(part.column(3).to_pylist()):
                    held.add(query, index[top[i]], exact[i])
            if len(held.found) > HELD:
                yield held.batch()
        yield held.batch()

    return run


def _merge(keep: int):
    """Rows (query, ids, scores) sorted by query: one row per query with its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(keep)
        for batch in batches:
            for query, ids, scores in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if query not in held.found and len(held.found) >= 4096:
                    yield held.batch()
                held.add(query, np.array(ids, np.int64), np.array(scores))
        yield held.batch()

    return run


def _usable(vector: str) -> "F.Column":
    """Not null, no null or non-finite component, not all zeros."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query, neighbours: int = 20, recall: float = 0.96, k: int = 6, tables: int = 2,
            sample: int = 16_384) -> DataFrame:
    """The ``neighbours`` rows of largest inner product with every query: ``query_id, rank (from 1), vec_id, score``.

    ``vectors`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on them. Candidates are all rows but the query's own; ties go
    to the smaller id. Vectors that are null, zero, hold nulls or non-finite numbers, or whose length isn't the most frequent
    one (ties: the longest) take no part, nor do null ids; a repeated id counts once for each different vector. With at most ``neighbours``
    candidates all of them are returned. ``recall`` holds for each query: one whose estimated recall is below it visits further buckets,
    and at last every entry.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable("v"))
    dim = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")).alias("sq"))
    dim = dim.orderBy(F.desc("n"), F.desc("d")).first()
    spark = vectors.sparkSession
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    keep = neighbours + 1  # a query's own row may be among its best
    rows = rows.where(F.size("v") == dim.d).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2"))
    # equal vectors: one entry, known by its smallest id, with the few smallest members that any answer can name
    by_id = Window.partitionBy("h1", "h2").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("rn", F.row_number().over(by_id)).withColumn("entry", F.first("vec_id").over(by_id)).where(F.col("rn") <= keep)
    ranked = materialise(ranked.select("h1", "h2", "entry", "vec_id", "rn", F.when(F.col("rn") == 1, F.col("v")).alias("v")))
    entries = ranked.where("rn = 1").select("h1", "h2", F.col("vec_id").alias("entry"), "v")
    asked = rows.where(is_query).select("vec_id", "h1", "h2")
    wanted = materialise(entries.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("entry", "v"))
    # a bounded sample of entries, to fit the tables on
    drawn = entries.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("v").toArrow()
    t = fit(_matrix(drawn["v"].combine_chunks()), float(np.sqrt(dim.sq)), recall, k, tables, neighbours)
    shared = spark.sparkContext.broadcast((t.directions, t.offsets, t.width, t.sets, t.norm, t.first))  # a few thousand numbers
    total, n = entries.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows_of(names: np.ndarray, ids: pa.Array, x: np.ndarray, who: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(who), SENT):
            part = who[at : at + SENT]
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + SENT]), ids.take(pa.array(part)), _floats(x[part])], ["bucket", "id", "v"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tables(*shared.value)
        for batch in batches:
            for at in range(0, len(batch), SENT):
                part = batch.slice(at, SENT)
                x = _matrix(part.column(1))
                for table in range(len(own.directions)):
                    yield from rows_of(_bucket(_cells(own, _lift(x, own.norm, False), table)[0], table), part.column(0), x, np.arange(len(x)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each query the buckets of perturbations ``since`` to before ``until``."""
        own = Tables(*shared.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                x = _matrix(part.column(1))
                since, until = (part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
                low, high = int(since.min()), int(until.max())
                step = np.arange(low, high)
                who, which = np.nonzero((step >= since[:, None]) & (step < until[:, None]))
                for table in range(len(own.directions)):
                    yield from rows_of(_probes(own, _lift(x, own.norm, True), table, low, high)[who, which], part.column(0), x, who)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries that ``until`` perturbations don't serve, with the number that does (or all, where none does)."""
        own = Tables(*shared.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                x = _matrix(part.column(1))
                until, last = (part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
                square = (x * x).sum(1) + own.norm ** 2 - 2 * last.astype(np.float64)  # NaN without enough candidates
                chance = success(own, _lift(x, own.norm, True), np.sqrt(np.maximum(0, square)))
                enough = chance >= recall
                enough[:, :-1] &= np.arange(1, len(own.sets)) >= until[:, None]
                need = np.where(enough.any(1), enough.argmax(1) + 1, len(own.sets))
                ok = enough[np.arange(len(x)), until - 1]
                keep_rows = np.flatnonzero(~ok)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep_rows)), _floats(x[keep_rows]), pa.array(until[keep_rows].astype(np.int32)),
                                                  pa.array(need[keep_rows].astype(np.int32))], ["entry", "v", "since", "until"])

    shape = "bucket long, id long, v array<double>"
    best = "query long, ids array<long>, scores array<double>"
    index = entries.select("entry", "v").mapInArrow(send, shape)
    sizes = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    filled = materialise(sizes.select("bucket", F.ceil(F.col("n") / SLAB).cast("int").alias("slabs")))
    placed = index.join(filled.where("slabs > 1"), "bucket", "left").select(
        "bucket", F.coalesce(F.pmod(F.xxhash64("id"), F.col("slabs")).cast("int"), F.lit(0)).alias("slab"), F.lit(0).alias("kind"), "id", "v")

    def compared(base: DataFrame, queries: DataFrame) -> DataFrame:
        met = base.unionByName(queries).repartition(n, "bucket", "slab").sortWithinPartitions("bucket", "slab", "kind")
        return met.mapInArrow(_compare(keep), best)

    def visited(queries: DataFrame) -> DataFrame:
        # a probe of an empty bucket ends here; one of a split bucket goes to each part
        probes = queries.select("entry", "v", "since", "until").mapInArrow(probe, shape).join(filled, "bucket").select(
            "bucket", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab"), F.lit(1).alias("kind"), "id", "v")
        return compared(placed, probes)

    def against_all(queries: DataFrame, count: int) -> DataFrame:
        groups, blocks = -(-count // GROUP), max(-(-total // SLAB), min(n, -(-total // LEAST)))
        base = entries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("bucket"), F.pmod(F.xxhash64("entry"), F.lit(blocks))
                              .cast("int").alias("slab"), F.lit(0).alias("kind"), F.col("entry").alias("id"), "v")
        return compared(base, queries.select(F.pmod(F.xxhash64("entry"), F.lit(groups)).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
                                             .alias("slab"), F.lit(1).alias("kind"), F.col("entry").alias("id"), "v"))

    def merged(parts: DataFrame) -> DataFrame:
        return parts.repartition(n, "query").sortWithinPartitions("query").mapInArrow(_merge(keep), best)

    def unserved(queries: DataFrame, found: DataFrame) -> DataFrame:
        """Queries (``entry, v, until``) that need more than they have visited. What holds all entries is served."""
        last = found.select(F.col("query").alias("entry"), F.size("ids").alias("n"), F.when(F.size("ids") >= keep, F.element_at("scores", keep)).alias("last"))
        open_ = queries.join(last, "entry", "left").where(F.coalesce("n", F.lit(0)) < total)
        judged = open_.select("entry", "v", "until", F.coalesce("last", F.lit(float("nan"))).alias("last"))
        return materialise(judged.mapInArrow(judge, "entry long, v array<double>, since int, until int"))

    found = materialise(merged(visited(wanted.select("entry", "v", F.lit(0).alias("since"), F.lit(t.first).alias("until")))))
    more = unserved(wanted.select("entry", "v", F.lit(t.first).alias("until")), found)
    further = more.where("since < until")
    if further.count():
        found = materialise(merged(found.unionByName(visited(further))))
    rest = unserved(more.select("entry", "v", "until"), found)
    count = rest.count()
    if count:
        found = merged(found.unionByName(against_all(rest, count)))
    # entries back to members, the few best of each query's entry, then one list per query without its own row
    pairs = found.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("_p")).select(
        "query", F.col("_p.ids").alias("entry"), F.col("_p.scores").alias("score"))
    members = pairs.join(ranked.select("entry", "vec_id"), "entry")
    lists = members.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, keep)
                                         .alias("best"))
    keyed = entries.select("h1", "h2", F.col("entry").alias("query")).join(lists, "query").select("h1", "h2", "best")
    answers = asked.join(keyed, ["h1", "h2"]).select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda x: x.vec_id != F.col("vec_id")), 1, neighbours).alias("best"))
    return answers.select("query_id", F.posexplode("best").alias("_at", "_b")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_b.vec_id").alias("vec_id"), (-F.col("_b.minus")).alias("score"))
