"""Which markers, and which sets of markers, a trained network responds to."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.draws import normal
from locusframe.operators.network import Network, activate, matrix_of, slope, weight_product

SET_BATCH = 1 << 14


def garson_importance(weights: DataFrame, activation: str | None = None) -> DataFrame:
    """Product over layers of absolute weights: one score per marker and output. With ``activation`` the
    weights of hidden layers pass through it first."""
    return weight_product(weights, absolute=True, activation=activation).select(
        F.col("i").alias("marker"), F.col("k").alias("output"), F.col("w").alias("importance"))


def unrank_sets(index: np.ndarray, n: int, k: int) -> np.ndarray:
    """The ``index``-th k-subsets of 0..n-1 in lexicographic order, one per row."""
    left, out, low = index.copy(), np.zeros((len(index), k), np.int64), np.zeros(len(index), np.int64)
    for place in range(k):
        rest = k - place - 1
        # sets whose next member is below m, for all m at once
        starts = np.array([math.comb(n - m, rest + 1) for m in range(n + 1)], dtype=np.int64)
        target = starts[low] - left
        # member m satisfies starts[m] >= target > starts[m + 1]
        member = len(starts) - 1 - np.searchsorted(starts[::-1], target, side="left")
        left = target * 0 + (starts[member] - target)
        out[:, place] = member
        low = member + 1
    return out


def interaction_scan(spark: SparkSession, net: Network, order: int = 3, strength: float = 1.0) -> DataFrame:
    """Outputs of the network for every set of ``order`` markers set to ``strength``, all others 0: a row per set and output.

    Sets are numbered, a distributed range hands out the numbers evenly, and a task turns its numbers
    into sets: no join, no set is stored before it is scored.
    """
    n, shipped = len(net.markers), spark.sparkContext.broadcast(vars(net))
    total = math.comb(n, order)
    slices = max(1, min(total // SET_BATCH + 1, 100_000))

    def score(batches):
        model = Network(**shipped.value)
        names = np.asarray(model.markers, np.int32)
        for batch in batches:
            index = batch.column("id").to_numpy()
            for at in range(0, len(index), SET_BATCH):
                sets = unrank_sets(index[at:at + SET_BATCH], n, order)
                first = strength * model.w[0][sets].sum(axis=1) + model.b[0]
                out = _from_first_layer(model, first)
                width = out.shape[1]
                yield pa.record_batch({
                    "markers": _lists(np.repeat(names[sets], width, axis=0)), "output": pa.array(np.tile(np.arange(width, dtype=np.int32), len(sets))),
                    "score": pa.array(out.ravel()), "strength": pa.array(np.abs(out).ravel())})

    return spark.range(0, total, 1, slices).mapInArrow(score, "markers array<int>, output int, score double, strength double")


def _lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    ends = np.arange(0, rows.size + 1, max(rows.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel().astype(np.int32)))


def _from_first_layer(net: Network, pre: np.ndarray) -> np.ndarray:
    for layer in range(1, len(net.w)):
        pre = activate(net.activation, pre) @ net.w[layer] + net.b[layer]
    return pre


def strongest_interactions(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Sets by decreasing strength: the whole ranking, or the k strongest."""
    ranked = scores.orderBy(F.desc("strength"), "markers")
    return ranked if k is None else ranked.limit(k)


# Sets of the most important markers that are scored first, for a bound that holds from the start.
FIRST_SETS = 1 << 16


class SetBounds:
    """Bounds on the strength of all sets that begin with some members, and the strengths of whole sets.

    Markers are taken by falling importance, so that what a set can still gain falls quickly. A set's members are places in that
    order, ascending. The first layer adds up members; what the ``r`` members still to come can add to a neuron lies between its r
    smallest and r largest weights among later places. Activations rise, so intervals pass through the layers end by end.
    """

    def __init__(self, net: Network, order: int, strength: float, output: int, digits: int | None):
        self.net, self.output, self.digits, self.n = net, output, digits, len(net.markers)
        reach = np.abs(net.w[0])
        for w in net.w[1:-1]:
            reach = reach @ np.abs(w)
        if len(net.w) > 1:
            reach = reach @ np.abs(net.w[-1][:, output])
        else:
            reach = reach[:, output]
        self.at = np.argsort(-reach, kind="stable")
        self.w = strength * net.w[0]
        placed = self.w[self.at]
        self.high = self._later(placed, order - 1)
        self.low = [-x for x in self._later(-placed, order - 1)]
        self.placed = placed

    @staticmethod
    def _later(w: np.ndarray, most: int) -> list[np.ndarray]:
        """Sums of the r largest weights at each place and after it, for r = 1 .. ``most``."""
        sums, rest, total = [], w, 0.0
        for _ in range(most):
            top = np.maximum.accumulate(rest[::-1])[::-1]
            total = total + top
            sums.append(total)
            # what a place pushes out of the largest so far, or doesn't get in
            rest = np.minimum(rest, np.vstack([top[1:], np.full((1, w.shape[1]), -np.inf)]))
        return sums

    def bound(self, members: np.ndarray, left: int) -> np.ndarray:
        """Upper bounds on the strength of sets with ``members`` (one row each) and ``left`` later ones."""
        pre = self.placed[members].sum(axis=1) + self.net.b[0]
        last = members[:, -1] + 1
        low, high = pre + self.low[left - 1][last], pre + self.high[left - 1][last]
        for w, b in zip(self.net.w[1:], self.net.b[1:]):
            low, high = activate(self.net.activation, low), activate(self.net.activation, high)
            up, down = np.maximum(w, 0.0), np.minimum(w, 0.0)
            low, high = low @ up + high @ down + b, high @ up + low @ down + b
        bound = np.maximum(np.abs(low[:, self.output]), np.abs(high[:, self.output]))
        return self.rounded(bound * (1 + 1e-12) + 1e-12)

    def score(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members as positions in ``markers``, ascending, and scores; added up as the whole scan adds them up."""
        sets = np.sort(self.at[members], axis=1)
        return sets, _from_first_layer(self.net, self.w[sets].sum(axis=1) + self.net.b[0])[:, self.output]

    def rounded(self, strength: np.ndarray) -> np.ndarray:
        return strength if self.digits is None else np.round(strength, self.digits)


def _start_bound(bounds: SetBounds, k: int, order: int) -> float:
    """A strength that at least k sets reach: the k-th of sets of the most important markers."""
    n = order
    while n < bounds.n and math.comb(n + 1, order) <= FIRST_SETS:
        n += 1
    sets = unrank_sets(np.arange(math.comb(n, order)), n, order)
    if len(sets) < k:
        return -1.0
    strength = bounds.rounded(np.abs(bounds.score(sets)[1]))
    return float(np.partition(strength, len(strength) - k)[len(strength) - k])


def promising_beginnings(spark: SparkSession, net: Network, k: int, order: int = 3, strength: float = 1.0, output: int = 0,
                         digits: int | None = None) -> DataFrame:
    """``(places, bound)``: all members but the last of the sets that may be among the k strongest.

    Beginnings grow by one member a step; those whose bound is below what k sets are known to reach are dropped. Between the steps they are
    spread over the tasks anew. The number of sets they stand for is the sum of ``markers - 1 - last place``.
    """
    n = len(net.markers)
    bounds = SetBounds(net, order, strength, output, digits)
    floor = _start_bound(bounds, k, order)
    shipped = spark.sparkContext.broadcast((vars(net), floor))
    tasks = 4 * spark.sparkContext.defaultParallelism

    def step(left: int):
        def extend(batches):
            parts, least = shipped.value
            own = SetBounds(Network(**parts), order, strength, output, digits)
            for batch in batches:
                if not batch.num_rows:
                    continue
                begun = matrix_of(batch.column("places")) if "places" in batch.schema.names else np.zeros((batch.num_rows, 0), np.int64)
                lone = batch.column("id").to_numpy() if "id" in batch.schema.names else None
                for row in range(batch.num_rows):
                    first = lone[row] if lone is not None else begun[row, -1] + 1
                    stop = first + 1 if lone is not None else n - left
                    for at in range(int(first), int(stop), SET_BATCH):
                        new = np.arange(at, min(at + SET_BATCH, stop))
                        sets = np.column_stack([np.repeat(begun[row:row + 1], len(new), axis=0), new]).astype(np.int64)
                        bound = own.bound(sets, left)
                        keep = bound >= least
                        if keep.any():
                            yield pa.record_batch({"places": _lists(sets[keep]), "bound": pa.array(bound[keep])})
        return extend

    found = spark.range(0, max(n - order + 1, 0), 1, tasks).mapInArrow(step(order - 1), "places array<int>, bound double")
    for left in range(order - 2, 0, -1):
        found = found.repartition(tasks, "places").select("places").mapInArrow(step(left), "places array<int>, bound double")
    return found.repartition(tasks, "places")


def top_interactions(spark: SparkSession, net: Network, k: int, order: int = 3, strength: float = 1.0, output: int = 0,
                     digits: int | None = None) -> DataFrame:
    """The k sets of ``order`` markers with the strongest response of ``output``: ``(markers, score, strength)``, strongest first.

    The same sets as ``strongest_interactions`` of the whole scan, ties by markers, found without scoring all sets: only beginnings that can
    still reach the k strongest are completed, the most promising of a task first, and a task keeps its k best. Strengths that
    agree to ``digits`` decimals are ties where that is given.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if order < 2 or order > len(net.markers):
        scan = interaction_scan(spark, net, order, strength).filter(F.col("output") == output).drop("output")
        return strongest_interactions(scan if digits is None else scan.withColumn("strength", F.round("strength", digits)), k)
    shipped, n = spark.sparkContext.broadcast(vars(net)), len(net.markers)

    def complete(batches):
        own = SetBounds(Network(**shipped.value), order, strength, output, digits)
        names = np.asarray(own.net.markers, np.int32)
        best, score, strong = np.zeros((0, order), np.int32), np.zeros(0), np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            for begun, bound in zip(matrix_of(batch.column("places")), batch.column("bound").to_numpy()):
                for at in range(int(begun[-1]) + 1, n, SET_BATCH):
                    if len(best) == k and bound < strong[-1]:
                        break
                    new = np.arange(at, min(at + SET_BATCH, n))
                    sets, value = own.score(np.column_stack([np.repeat(begun[None], len(new), axis=0), new]).astype(np.int64))
                    size = own.rounded(np.abs(value))
                    if len(best) == k:
                        hit = size >= strong[-1]
                        sets, value, size = sets[hit], value[hit], size[hit]
                    best, score, strong = np.vstack([best, names[sets]]), np.append(score, value), np.append(strong, size)
                    first = np.lexsort((*best.T[::-1], -strong))[:k]
                    best, score, strong = best[first], score[first], strong[first]
        if len(best):
            yield pa.record_batch({"markers": _lists(best), "score": pa.array(score), "strength": pa.array(strong)})

    begun = promising_beginnings(spark, net, k, order, strength, output, digits).sortWithinPartitions(F.desc("bound"))
    return strongest_interactions(begun.mapInArrow(complete, "markers array<int>, score double, strength double"), k)


def input_gradient(net: Network, x: np.ndarray, guided: bool = True) -> np.ndarray:
    """Gradient of the largest output with respect to the inputs, per row. ``guided`` lets only
    positive errors pass back through a hidden activation."""
    out, pre, _ = net.forward(x)
    back = np.zeros_like(out)
    back[np.arange(len(x)), out.argmax(axis=1)] = 1.0
    for layer in range(len(net.w) - 1, -1, -1):
        back = back @ net.w[layer].T
        if layer:
            if guided:
                back = np.maximum(back, 0.0)
            back = back * slope(net.activation, pre[layer - 1])
    return back


def _per_marker(rows: DataFrame, net: Network, gradient) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(vars(net))

    def run(batches):
        model = Network(**shipped.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("x"))
            iids = batch.column("iid").to_numpy()
            g = gradient(model, x, iids)
            yield pa.record_batch({
                "iid": pa.array(np.repeat(iids, x.shape[1])),
                "marker": pa.array(np.tile(np.asarray(model.markers, np.int32), len(iids))), "g": pa.array(g.ravel())})

    return rows.select("iid", "x").mapInArrow(run, "iid long, marker int, g double")


def saliency(rows: DataFrame, net: Network, guided: bool = True) -> DataFrame:
    """``(iid, marker, g)``: gradient at each individual of ``(iid, x)``."""
    return _per_marker(rows, net, lambda model, x, _: input_gradient(model, x, guided))


# Noisy inputs that a task holds at a time.
NOISY_CELLS = 1 << 21


def smoothgrad(rows: DataFrame, net: Network, spread: float = 0.15, samples: int = 50, mode: str = "absolute",
               seed: int = 1, guided: bool = True) -> DataFrame:
    """Mean gradient over noisy copies of each individual; noise is scaled by the individual's range.

    Copies are made where the individual is and never shuffled. The noise of sample s at the k-th of p inputs is the normal draw of
    ``functions.draws`` for (seed, iid, s * p + k), so it depends on nothing else, and other engines can repeat it.
    """
    def smooth(model, x, iids):
        out, p = np.zeros_like(x), x.shape[1]
        many = max(1, NOISY_CELLS // (samples * p))
        for at in range(0, len(x), many):
            part = x[at:at + many]
            noise = normal(seed, iids[at:at + many, None], np.arange(samples * p)[None]).reshape(len(part), samples, p)
            wide = spread * (part.max(axis=1) - part.min(axis=1))
            noisy = part[:, None] + noise * wide[:, None, None]
            g = input_gradient(model, noisy.reshape(-1, p), guided).reshape(noisy.shape)
            out[at:at + many] = (np.abs(g) if mode == "absolute" else g * g if mode == "squared" else g).mean(axis=1)
        return out

    return _per_marker(rows, net, smooth)


def mean_saliency(per_individual: DataFrame) -> DataFrame:
    return per_individual.groupBy("marker").agg(F.avg(F.abs("g")).alias("saliency"))


def activation_map(sets: DataFrame, net: Network, layer: int, strength: float = 1.0, with_all: bool = True,
                   subtract_null: bool = False) -> DataFrame:
    """Absolute response of every neuron of ``layer`` to artificial individuals with one marker set each.

    ``sets(set_id, markers)``; ``with_all`` adds set -1, where a marker counts once per set it is in.
    """
    if with_all:
        every = sets.select(F.explode("markers").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
        lone = sets.select("set_id", F.explode("markers").alias("m")).groupBy("set_id", "m").agg(F.lit(1).cast("long").alias("n"))
        cells = lone.unionByName(every.select(F.lit(-1).cast(dict(sets.dtypes)["set_id"]).alias("set_id"), "m", "n"))
    else:
        cells = sets.select("set_id", F.explode("markers").alias("m")).distinct().withColumn("n", F.lit(1).cast("long"))
    members = cells.groupBy("set_id").agg(F.collect_list(F.struct("m", "n")).alias("c"))
    shipped = sets.sparkSession.sparkContext.broadcast(vars(net))

    def respond(model, x):
        _, pre, _ = model.forward(x)
        return pre[layer] if layer == len(model.w) - 1 else activate(model.activation, pre[layer])

    def run(batches):
        model = Network(**shipped.value)
        place = {m: k for k, m in enumerate(model.markers)}
        null = respond(model, np.zeros((1, len(place)))) if subtract_null else 0.0
        for batch in batches:
            ids = batch.column("set_id").to_pylist()
            x = np.zeros((len(ids), len(place)))
            for row, cells_ in enumerate(batch.column("c").to_pylist()):
                for cell in cells_:
                    x[row, place[cell["m"]]] += strength * cell["n"]
            out = np.abs(respond(model, x) - null)
            neuron = np.tile(np.arange(out.shape[1], dtype=np.int32), len(ids))
            yield pa.record_batch({"set_id": pa.array(np.repeat(ids, out.shape[1]), pa.int64()),
                                   "neuron": pa.array(neuron), "activation": pa.array(out.ravel())})

    return members.select(F.col("set_id").cast("long").alias("set_id"), "c").mapInArrow(
        run, "set_id long, neuron int, activation double")
