"""Dense feed-forward networks on z-scored genotypes: training, search and prediction.

Training is data-parallel: individuals stay distributed, parameters travel to the tasks, each task
returns one summed gradient per model and Spark adds them. Several models can be trained side by
side: a step scans the data once for all of them, which is how the hyper-parameter search works.
Model size is bounded (``MAX_PARAMETERS``); the number of individuals is not.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.ranking import hash_order
from locusframe.operators.align import minibatches
from locusframe.session import materialise

MAX_PARAMETERS = 1 << 25
CHUNK = 4096
FAN_IN = 64
# Codes of the hidden activations and the slope of the leaky one.
ACTIVATIONS = {1: "sigmoid", 2: "relu", 3: "linear", 4: "softplus", 5: "leaky"}
LEAK = 0.001


def activate(name: str, x: np.ndarray) -> np.ndarray:
    if name == "sigmoid":
        return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))
    if name == "relu":
        return np.maximum(x, 0.0)
    if name == "softplus":
        return np.logaddexp(0.0, x)
    if name == "leaky":
        return np.where(x > 0, x, LEAK * x)
    return x


def slope(name: str, x: np.ndarray) -> np.ndarray:
    """Derivative of the activation at pre-activation ``x``."""
    if name == "sigmoid":
        s = activate(name, x)
        return s * (1.0 - s)
    if name == "relu":
        return (x > 0).astype(float)
    if name == "softplus":
        return activate("sigmoid", x)
    if name == "leaky":
        return np.where(x > 0, 1.0, LEAK)
    return np.ones_like(x)


def softmax(scores: np.ndarray) -> np.ndarray:
    """Probabilities of the classes, row by row."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix, without a loop over rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def targets(column: pa.Array) -> np.ndarray:
    """Phenotypes of a batch: one per row, or a row of several."""
    return matrix_of(column) if pa.types.is_nested(column.type) else column.to_numpy(zero_copy_only=False)


@dataclass
class Network:
    """Weights ``w[l]`` (inputs x outputs) and biases ``b[l]`` per layer; the last layer is linear.

    ``markers`` names the inputs in order. With the loss ``softmax`` the outputs are scores of classes (0, 1, ..), one of which is y;
    with ``squared`` each output has its own y.
    """

    markers: list[int]
    w: list[np.ndarray]
    b: list[np.ndarray]
    activation: str = "sigmoid"
    loss: str = "squared"

    @property
    def size(self) -> int:
        return sum(x.size for x in (*self.w, *self.b))

    def forward(self, x: np.ndarray, masks=None) -> tuple[np.ndarray, list, list]:
        """Output, pre-activations and layer inputs."""
        pre, inputs, out = [], [], x
        for layer, (w, b) in enumerate(zip(self.w, self.b)):
            inputs.append(out)
            s = out @ w + b
            pre.append(s)
            out = s if layer == len(self.w) - 1 else activate(self.activation, s)
            if masks is not None and layer < len(self.w) - 1:
                out = out * masks[layer]
        return out, pre, inputs

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for pair in zip(self.w, self.b) for x in pair])

    def with_flat(self, theta: np.ndarray) -> "Network":
        at, w, b = 0, [], []
        for wl, bl in zip(self.w, self.b):
            w.append(theta[at:at + wl.size].reshape(wl.shape))
            at += wl.size
            b.append(theta[at:at + bl.size].reshape(bl.shape))
            at += bl.size
        return replace(self, w=w, b=b)

    def linear(self) -> "Network":
        """The same network with its hidden activations removed."""
        return replace(self, activation="linear")


def layer_widths(hidden: int, first: int, reduction: int = 1) -> list[int]:
    """Widths of hidden layers: halved after every ``reduction`` layers, stopping below 2 neurons."""
    widths, width = [], first
    for depth in range(1, hidden + 1):
        widths.append(width)
        if depth % reduction == 0:
            width //= 2
        if width < 2:
            break
    return widths


def init_network(markers: list[int], widths: list[int], outputs: int = 1, activation: str = "sigmoid",
                 seed: int = 1, loss: str = "squared") -> Network:
    """Seeded initial weights, scaled by the number of inputs."""
    sizes = [len(markers), *widths, outputs]
    total = sum((a + 1) * b for a, b in zip(sizes[:-1], sizes[1:]))
    if total > MAX_PARAMETERS:
        raise ValueError(f"{total} parameters exceed the bound of {MAX_PARAMETERS}")
    rng = np.random.default_rng(seed)
    w = [rng.standard_normal((a, b)) * np.sqrt(1.0 / a) for a, b in zip(sizes[:-1], sizes[1:])]
    return Network(list(markers), w, [np.zeros(b) for b in sizes[1:]], activation, loss)


def network_table(spark: SparkSession, net: Network) -> DataFrame:
    """``layer_weight(layer, i, j, w)``; i is the marker in layer 0 and -1 for a bias."""
    frames = []
    for layer, (w, b) in enumerate(zip(net.w, net.b)):
        i, j = np.indices(w.shape)
        rows = np.asarray(net.markers)[i] if layer == 0 else i
        frames.append(pd.DataFrame({"layer": layer, "i": rows.ravel(), "j": j.ravel(), "w": w.ravel()}))
        frames.append(pd.DataFrame({"layer": layer, "i": -1, "j": np.arange(len(b)), "w": b}))
    return spark.createDataFrame(pd.concat(frames)).selectExpr("int(layer) as layer", "int(i) as i", "int(j) as j", "w")


def load_network(weights: DataFrame, activation: str = "sigmoid", loss: str = "squared") -> Network:
    """A network from its weight table (size checked)."""
    table = weights.limit(MAX_PARAMETERS + 1).toPandas()
    if len(table) > MAX_PARAMETERS:
        raise ValueError(f"more than {MAX_PARAMETERS} weights")
    w, b, markers = [], [], []
    for layer, part in table.groupby("layer"):
        cells, bias = part[part.i >= 0], part[part.i < 0]
        rows = np.sort(cells.i.unique())
        if layer == 0:
            markers = [int(m) for m in rows]
        width = int(part.j.max()) + 1
        m = np.zeros((len(rows), width))
        m[np.searchsorted(rows, cells.i), cells.j] = cells.w
        v = np.zeros(width)
        v[bias.j] = bias.w
        w.append(m)
        b.append(v)
    return Network(markers, w, b, activation, loss)


def wide(z: DataFrame, markers: list[int], value: str = "z") -> DataFrame:
    """One row per individual, ``(iid, x)`` with x in the order of ``markers``.

    The number of inputs is bounded by the model size, and with it the size of a row.
    """
    place = {m: k for k, m in enumerate(markers)}
    names = z.sparkSession.createDataFrame([(m, k) for m, k in place.items()], "marker int, _at int")
    cells = z.join(names, "marker").groupBy("iid").agg(
        F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v")))).alias("c"))
    return cells.select("iid", F.col("c.v").alias("x"))


# Rows of a minibatch that one task takes, and folders of a training table.
SMALL_BATCH, MAX_FOLDERS = 8192, 4096


def training_table(z: DataFrame, pheno: DataFrame, markers: list[int], batch_size: int = 0, seed: int = 1,
                   tasks: int | None = None) -> DataFrame:
    """Shuffled, numbered and stored training rows ``(iid, x, y, batch_id, is_remainder)``.

    Rows are sorted by batch inside each file, so a step on one batch skips the row groups of others. Minibatches of up to ``SMALL_BATCH`` rows
    have folders (at most ``MAX_FOLDERS``, a column ``folder``), so that a step reads no others' file and is one task.
    """
    numbered = minibatches(pheno.select("iid", "y"), batch_size, seed)
    rows = wide(z, markers).join(numbered, "iid").select("iid", "x", "y", "batch_id", "is_remainder")
    if 0 < batch_size <= SMALL_BATCH:
        together = -(-(pheno.count() // batch_size + 1) // MAX_FOLDERS)
        foldered = rows.withColumn("folder", F.expr(f"cast(batch_id div {together} as int)"))
        return materialise(foldered.repartition("folder").sortWithinPartitions("folder", "batch_id"), "folder")
    n = tasks or z.sparkSession.sparkContext.defaultParallelism
    return materialise(rows.repartition(n, hash_order("iid", seed)).sortWithinPartitions("batch_id"))


@dataclass
class TrainingPlan:
    """How a network is trained. ``momentum < 0`` switches it off.

    Penalties: ``l2`` on the first layer (times batch size / individuals with ``l2_by_batch``); on the last
    hidden layer ``l1``, ``ortho`` (distance of W'W from the identity), ``cosine`` (squared cosines between
    neurons) and ``decorrelation`` (covariance of its activations over the batch).
    """

    epochs: int = 100
    learn_rate: float = 0.005
    momentum: float = -1.0
    optimizer: str = "sgd"
    l2: float = 0.0
    l2_by_batch: bool = False
    l1: float = 0.0
    ortho: float = 0.0
    cosine: float = 0.0
    decorrelation: float = 0.0
    dropout: float = 0.0
    decay: float = 0.0
    decay_after: int = 10
    eval_every: int = 10
    seed: int = 1


@dataclass
class Step:
    """Optimiser state of one model."""

    first: np.ndarray
    second: np.ndarray
    top: np.ndarray
    count: int = 0


@dataclass
class Trained:
    network: Network
    history: list = field(default_factory=list)

    @property
    def best(self) -> tuple[float, int]:
        """Highest test metric and its epoch."""
        scored = [(-1.0 if np.isnan(h[2]) else h[2], h[0]) for h in self.history if h[2] is not None]
        return max(scored, key=lambda s: (s[0], -s[1])) if scored else (-1.0, -1)


def penalty_gradient(net: Network, plan: TrainingPlan, share: float = 1.0) -> np.ndarray:
    """Gradient of the penalties on weights; ``share`` is the part of the individuals in the batch."""
    grads = [np.zeros_like(w) for w in net.w]
    if plan.l2:
        grads[0] += plan.l2 * (share if plan.l2_by_batch else 1.0) * net.w[0]
    inner = max(len(net.w) - 2, 0)
    if plan.l1:
        grads[inner] += 0.5 * plan.l1 * np.sign(net.w[inner])
    if plan.ortho:
        w = net.w[inner]
        sign = np.sign(w.T @ w - np.eye(w.shape[1]))
        grads[inner] += plan.ortho * w @ sign
    if plan.cosine:
        norm = np.linalg.norm(net.w[inner], axis=0)
        unit = net.w[inner] / norm
        cos = unit.T @ unit
        np.fill_diagonal(cos, 0.0)
        pull = unit @ cos
        grads[inner] += plan.cosine * (pull - unit * (unit * pull).sum(axis=0)) / norm
    return np.concatenate([x.ravel() for g, b in zip(grads, net.b) for x in (g, np.zeros_like(b))])


def output_gradient(net: Network, out: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the loss at the outputs of some rows, and the summed loss: squared errors, or the cross-entropy of the classes."""
    if net.loss == "squared":
        error = out - y.reshape(len(out), -1)
        return 2.0 * error, float((error * error).sum())
    if not ((y >= 0) & (y < out.shape[1]) & (y == np.floor(y))).all():
        raise ValueError(f"classes are whole numbers from 0 to {out.shape[1] - 1}")
    own = (np.arange(len(out)), y.astype(np.int64))
    top = out.max(axis=1)
    loss = float((top + np.log(np.exp(out - top[:, None]).sum(axis=1)) - out[own]).sum())
    grad = softmax(out)
    grad[own] -= 1.0
    return grad, loss


def loss_gradient(net: Network, x: np.ndarray, y: np.ndarray, masks=None, decorrelate=None) -> tuple[np.ndarray, float]:
    """Summed gradient of the loss and the summed loss over some rows.

    ``decorrelate`` (mean, matrix) adds the gradient of the covariance penalty at the last hidden layer.
    """
    out, pre, inputs = net.forward(x, masks)
    back, loss = output_gradient(net, out, y)
    grads = []
    for layer in range(len(net.w) - 1, -1, -1):
        grads.append((inputs[layer].T @ back, back.sum(axis=0)))
        if layer:
            back = back @ net.w[layer].T
            if decorrelate is not None and layer == len(net.w) - 1:
                back = back + (inputs[layer] - decorrelate[0]) @ decorrelate[1]
            if masks is not None:
                back = back * masks[layer - 1]
            back = back * slope(net.activation, pre[layer - 1])
    flat = [v.ravel() for pair in reversed(grads) for v in pair]
    return np.concatenate(flat), loss


def _dropout_masks(net: Network, iids: np.ndarray, rate: float, seed: int, epoch: int):
    """Inverted dropout per individual and epoch; the same whatever task holds the individual."""
    widths = [w.shape[1] for w in net.w[:-1]]
    draws = np.stack([np.random.default_rng([seed, epoch, int(i)]).random(sum(widths)) for i in iids])
    keep = (draws >= rate) / (1.0 - rate)
    return np.split(keep, np.cumsum(widths)[:-1], axis=1)


def covariance_pull(n: float, first: np.ndarray, second: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean activation and the matrix that maps a centred activation to its gradient, from batch sums.

    The cost is half the sum of the squared row sums of the covariance without its diagonal.
    """
    mean = first / n
    cov = second / n - np.outer(mean, mean)
    np.fill_diagonal(cov, 0.0)
    sums = cov.sum(axis=1)
    pull = strength * (sums[:, None] + sums[None])
    np.fill_diagonal(pull, 0.0)
    return mean, pull


def _batch_covariances(rows: DataFrame, nets: dict[int, Network], plans: dict[int, TrainingPlan], epoch: int) -> dict:
    """Sums of the last hidden activations over a batch, per model with a decorrelation penalty (one scan)."""
    asked = {k: n for k, n in nets.items() if plans[k].decorrelation > 0 and len(n.w) > 1}
    if not asked:
        return {}
    shipped = rows.sparkSession.sparkContext.broadcast({k: (vars(n), plans[k].dropout, plans[k].seed) for k, n in asked.items()})

    def partial(batches):
        models = {k: (Network(**parts), rate, seed) for k, (parts, rate, seed) in shipped.value.items()}
        sums = {k: 0.0 for k in models}
        for batch in batches:
            x = matrix_of(batch.column("x")) if batch.num_rows else np.zeros((0, 0))
            for k, (net, rate, seed) in models.items():
                if len(x):
                    masks = _dropout_masks(net, batch.column("iid").to_numpy(), rate, seed, epoch) if rate > 0 else None
                    h = np.column_stack([np.ones(len(x)), net.forward(x, masks)[2][-1]])
                    sums[k] = sums[k] + h.T @ h
        for k, m in sums.items():
            if np.ndim(m):
                yield pa.record_batch({"model": pa.array(np.full(m.size, k, np.int32)),
                                       "at": pa.array(np.arange(m.size, dtype=np.int32)), "v": pa.array(m.ravel())})

    cells = rows.select("iid", "x").mapInArrow(partial, "model int, at int, v double").groupBy("model", "at").agg(
        F.sum("v").alias("v")).collect()
    out = {}
    for k, net in asked.items():
        size = net.w[-1].shape[0] + 1
        m = np.zeros(size * size)
        for c in cells:
            if c.model == k:
                m[c.at] = c.v
        m = m.reshape(size, size)
        out[k] = covariance_pull(m[0, 0], m[0, 1:], m[1:, 1:], plans[k].decorrelation)
    return out


def _sum_chunks(parts: DataFrame) -> DataFrame:
    """Sums of the chunks ``(model, at, n, g)`` of all tasks, as arrays. Tasks are added in groups of ``FAN_IN`` first, so that no
    group holds more than so many chunks, or one per group."""
    def add(chunks: DataFrame, *keys: str) -> DataFrame:
        zeros = F.transform(F.element_at("all", 1), lambda _: F.lit(0.0))
        total = F.aggregate("all", zeros, lambda a, g: F.zip_with(a, g, lambda p, q: p + q))
        return chunks.groupBy("model", "at", *keys).agg(F.collect_list("g").alias("all"), F.sum("n").alias("n")).select(
            "model", "at", *keys, "n", total.alias("g"))

    grouped = parts.withColumn("part", F.floor(F.spark_partition_id() / F.lit(FAN_IN)))
    return add(add(grouped, "part").drop("part"))


def _gradients(rows: DataFrame, nets: dict[int, Network], plans: dict[int, TrainingPlan], epoch: int, small: bool = False):
    """Mean gradient per model over ``rows``: one scan, partial sums added by Spark. Few rows (``small``) go to one task, whose sums are the result."""
    rows = rows.coalesce(1) if small else rows
    pulls = _batch_covariances(rows, nets, plans, epoch)
    shipped = rows.sparkSession.sparkContext.broadcast(
        {k: (vars(n), plans[k].dropout, plans[k].seed, pulls.get(k)) for k, n in nets.items()})

    def partial(batches):
        models = {k: (Network(**parts), *rest) for k, (parts, *rest) in shipped.value.items()}
        sums, seen = {k: 0.0 for k in models}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("x"))
            y = targets(batch.column("y"))
            seen += len(y)
            for k, (net, rate, seed, pull) in models.items():
                masks = None
                if rate > 0 and len(net.w) > 1:
                    masks = _dropout_masks(net, batch.column("iid").to_numpy(), rate, seed, epoch)
                sums[k] = sums[k] + loss_gradient(net, x, y, masks, pull)[0]
        if seen:
            for k, g in sums.items():
                for at in range(0, len(g), CHUNK):
                    part = g[at:at + CHUNK]
                    yield pa.record_batch({
                        "model": pa.array([k], pa.int32()), "at": pa.array([at], pa.int32()),
                        "n": pa.array([seen], pa.int64()), "g": pa.array([part], pa.list_(pa.float64()))})

    parts = rows.select("iid", "x", "y").mapInArrow(partial, "model int, at int, n long, g array<double>")
    out = {k: np.zeros(n.size) for k, n in nets.items()}
    for r in (parts if small else _sum_chunks(parts)).toArrow().to_batches():
        sums, ends = r.column("g").flatten().to_numpy(), r.column("g").offsets.to_numpy() - r.column("g").offsets[0].as_py()
        for i, (model, at, n) in enumerate(zip(*(r.column(c).to_pylist() for c in ("model", "at", "n")))):
            out[model][at:at + ends[i + 1] - ends[i]] = sums[ends[i]:ends[i + 1]] / n
    shipped.destroy()
    return out


def _update(theta, grad, state: Step, plan: TrainingPlan, rate: float):
    state.count += 1
    if plan.optimizer == "sgd":
        if plan.momentum > 0:
            state.first = grad if state.count == 1 else plan.momentum * state.first + grad
            grad = state.first
        return theta - rate * grad
    beta1, beta2 = (plan.momentum if plan.momentum > 0 else 0.9), 0.999
    state.first = beta1 * state.first + (1 - beta1) * grad
    state.second = beta2 * state.second + (1 - beta2) * grad * grad
    second = state.second
    if plan.optimizer == "amsgrad":
        state.top = second = np.maximum(state.top, state.second)
    m, v = state.first / (1 - beta1 ** state.count), second / (1 - beta2 ** state.count)
    return theta - rate * m / (np.sqrt(v) + 1e-8)


def _metrics(rows: DataFrame, nets: dict[int, Network]) -> dict[int, float]:
    """Squared correlation of prediction and y, as the mean over outputs, or the accuracy of classes, per model; one scan for all of a kind."""
    found = {}
    plain = {k: n for k, n in nets.items() if n.loss == "squared"}
    classes = {k: n for k, n in nets.items() if n.loss == "softmax"}
    if plain:
        each = predict_many(rows, plain, with_y=True).groupBy("model", "output").agg(F.pow(F.corr("y", "yhat"), F.lit(2.0)).alias("r2"))
        found |= {r.model: r.r2 for r in each.groupBy("model").agg(F.avg("r2").alias("r2")).collect()}
    if classes:
        hits = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")
        found |= {r.model: r.hits for r in confusion(rows, classes).groupBy("model").agg(hits.alias("hits")).collect()}
    return {k: float("nan") if found.get(k) is None else float(found[k]) for k in nets}


def train_many(rows: DataFrame, nets: dict[int, Network], plans: dict[int, TrainingPlan],
               valid: DataFrame | None = None) -> dict[int, Trained]:
    """Train models side by side on a stored training table; evaluation rows are ``(iid, x, y)``.

    The incomplete last batch is left out of training. Every step is one job for all models.
    """
    foldered = ["folder"] if "folder" in rows.columns else []
    sizes = rows.groupBy("batch_id", "is_remainder", *foldered).agg(F.count(F.lit(1)).alias("n")).orderBy("batch_id").collect()
    total = sum(r.n for r in sizes)
    share = {r.batch_id: r.n / total for r in sizes if not r.is_remainder}
    batches = list(share)
    folder = {r.batch_id: r.folder for r in sizes} if foldered else {}
    small = {r.batch_id: r.n <= SMALL_BATCH for r in sizes}
    state = {k: Step(*(np.zeros(n.size) for _ in range(3))) for k, n in nets.items()}
    rate = {k: p.learn_rate for k, p in plans.items()}
    done = {k: Trained(n) for k, n in nets.items()}
    for epoch in range(max(p.epochs for p in plans.values())):
        live = {k: done[k].network for k in nets if epoch < plans[k].epochs}
        for batch in batches:
            data = rows.filter(F.col("batch_id") == batch) if len(batches) > 1 else rows.filter("not is_remainder")
            data = data.filter(F.col("folder") == folder[batch]) if foldered else data
            for k, g in _gradients(data, live, plans, epoch, bool(foldered) and small[batch]).items():
                g = g + penalty_gradient(live[k], plans[k], share[batch])
                live[k] = live[k].with_flat(_update(live[k].flat(), g, state[k], plans[k], rate[k]))
        for k, net in live.items():
            done[k].network = net
        due = {k: n for k, n in live.items() if epoch % plans[k].eval_every == 0 or epoch == plans[k].epochs - 1}
        if due:
            train = _metrics(rows.filter("not is_remainder"), due)
            test = _metrics(valid, due) if valid is not None else {}
            for k in due:
                done[k].history.append((epoch, train.get(k), test.get(k)))
        for k in live:
            if plans[k].decay and epoch > plans[k].decay_after:
                rate[k] /= 1.0 + plans[k].decay * epoch
    return done


def train(rows: DataFrame, net: Network, plan: TrainingPlan, valid: DataFrame | None = None) -> Trained:
    return train_many(rows, {0: net}, {0: plan}, valid)[0]


def train_until_best(rows: DataFrame, net: Network, plan: TrainingPlan, valid: DataFrame) -> Trained:
    """Train, find the evaluated epoch with the best validation metric, and retrain up to it."""
    full = train(rows, net, plan, valid)
    epochs = full.best[1] + 1
    return full if epochs in (0, plan.epochs) else train(rows, net, replace(plan, epochs=epochs), valid)


def history_table(spark: SparkSession, trained: Trained) -> DataFrame:
    return spark.createDataFrame(trained.history, "epoch int, train double, test double")


@dataclass
class SearchSpace:
    """Ranges of the search; upper ends of whole numbers are exclusive."""

    first_layer: tuple[int, int] = (100, 5000)
    epochs: tuple[int, int] = (10, 100)
    hidden: tuple[int, int] = (2, 11)
    dropout: tuple[float, float] = (0.0, 0.9)
    learn_rate: tuple[float, float] = (1e-6, 1e-2)


FIELDS = ("first_layer", "epochs", "hidden", "dropout", "learn_rate")


def _propose(rng, space: SearchSpace, tried: list[tuple[dict, float]], start_up: int) -> dict:
    """Random at first; later the best of random candidates by the density ratio of good to other trials."""
    def draw():
        return {f: (int(rng.integers(*getattr(space, f))) if isinstance(getattr(space, f)[0], int)
                    else float(rng.uniform(*getattr(space, f)))) for f in FIELDS}

    if len(tried) < start_up:
        return draw()
    ranked = sorted(tried, key=lambda t: -t[1])
    cut = max(1, len(ranked) // 4)

    def density(group, f, value):
        lo, hi = getattr(space, f)
        width = (hi - lo) / max(2.0, np.sqrt(len(group))) + 1e-12
        return 1e-9 + np.mean([np.exp(-0.5 * ((value - g[f]) / width) ** 2) for g, _ in group])

    def ratio(c):
        return sum(np.log(density(ranked[:cut], f, c[f])) - np.log(density(ranked[cut:] or ranked, f, c[f])) for f in FIELDS)

    return max((draw() for _ in range(24)), key=ratio)


def hyper_search(rows: DataFrame, valid: DataFrame, markers: list[int], base: TrainingPlan, space: SearchSpace = SearchSpace(),
                 trials: int = 20, start_up: int = 5, activation: str = "sigmoid", seed: int = 1) -> tuple[DataFrame, dict]:
    """Search width, depth, epochs, dropout and learning rate for the best validation metric.

    Trials of a round share every scan of the data. Returns the trial table and the best settings,
    with epochs replaced by the best early-stop epoch (at least 1).
    """
    rng = np.random.default_rng(seed)
    tried: list[tuple[dict, float]] = []
    records = []
    while len(tried) < trials:
        ask = [_propose(rng, space, tried, start_up) for _ in range(min(start_up, trials - len(tried)))]
        nets = {k: init_network(markers, layer_widths(c["hidden"], c["first_layer"]), 1, activation, seed)
                for k, c in enumerate(ask)}
        plans = {k: replace(base, epochs=c["epochs"], dropout=c["dropout"], learn_rate=c["learn_rate"])
                 for k, c in enumerate(ask)}
        for k, t in sorted(train_many(rows, nets, plans, valid).items()):
            last = t.history[-1][2]
            metric = 0.0 if last is None or np.isnan(last) else float(last)
            best, epoch = t.best
            records.append((len(tried), *(ask[k][f] for f in FIELDS), metric, float(best), int(epoch)))
            tried.append((ask[k], metric))
    table = rows.sparkSession.createDataFrame(
        records, "trial int, first_layer int, epochs int, hidden int, dropout double, learn_rate double,"
                 " metric double, best_metric double, best_epoch int")
    top = max(records, key=lambda r: r[6])
    best = dict(zip(FIELDS, top[1:6])) | {"epochs": max(top[8] + 1, 1), "metric": top[6]}
    return table, best


def trial_responses(trials: DataFrame) -> DataFrame:
    """Response per searched parameter ``(parameter, value, response)``."""
    return trials.select("trial", "metric", F.explode(F.array(*(
        F.struct(F.lit(f).alias("parameter"), F.col(f).cast("double").alias("value")) for f in FIELDS))).alias("c")).select(
        "trial", "c.parameter", "c.value", F.col("metric").alias("response"))


def predict_many(rows: DataFrame, nets: dict[int, Network], with_y: bool = False) -> DataFrame:
    """``(model, iid, output, yhat)`` over ``(iid, x)``: a row per output, probabilities where the loss is ``softmax``.

    Parameters are broadcast once. ``with_y`` passes along the y of an output, or the class.
    """
    shipped = rows.sparkSession.sparkContext.broadcast({k: vars(n) for k, n in nets.items()})

    def score(batches):
        models = {k: Network(**parts) for k, parts in shipped.value.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("x"))
            iids = batch.column("iid").to_numpy()
            for k, net in models.items():
                out = _outputs(net, x)
                n, width = out.shape
                cells = {"model": pa.array(np.full(out.size, k, np.int32)), "iid": pa.array(np.repeat(iids, width)),
                         "output": pa.array(np.tile(np.arange(width, dtype=np.int32), n)), "yhat": pa.array(out.ravel())}
                if with_y:
                    y = targets(batch.column("y")).reshape(n, -1).astype(float)
                    cells["y"] = pa.array((y if y.shape[1] == width else np.repeat(y[:, :1], width, axis=1)).ravel())
                yield pa.record_batch(cells)

    extra = ["y"] if with_y else []
    return rows.select("iid", "x", *extra).mapInArrow(
        score, "model int, iid long, output int, yhat double" + (", y double" if with_y else ""))


def _outputs(net: Network, x: np.ndarray) -> np.ndarray:
    out = net.forward(x)[0]
    return softmax(out) if net.loss == "softmax" else out


def predict(rows: DataFrame, net: Network, linear: bool = False) -> DataFrame:
    """``(iid, yhat)``, with several outputs ``(iid, output, yhat)``; every row is scored, whole batches or not."""
    scored = predict_many(rows, {0: net.linear() if linear else net})
    return scored.select("iid", "yhat") if len(net.b[-1]) == 1 else scored.select("iid", "output", "yhat")


def confusion(rows: DataFrame, nets: dict[int, Network]) -> DataFrame:
    """``(model, label, predicted, n)`` over ``(iid, x, y)``: how often a class is taken for which (of equal scores the smaller class).

    A task sends one row for each pair of classes that it meets. Rows without a class take no part.
    """
    shipped = rows.sparkSession.sparkContext.broadcast({k: vars(n) for k, n in nets.items()})

    def count(batches):
        models = {k: Network(**parts) for k, parts in shipped.value.items()}
        cells = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix_of(batch.column("x")), targets(batch.column("y")).astype(np.int64)
            for k, net in models.items():
                pairs, n = np.unique(np.stack([y, net.forward(x)[0].argmax(axis=1)]), axis=1, return_counts=True)
                for label, predicted, m in zip(*pairs.tolist(), n.tolist()):
                    cells[k, label, predicted] = cells.get((k, label, predicted), 0) + m
        if cells:
            model, label, predicted = zip(*cells)
            yield pa.record_batch({"model": pa.array(model, pa.int32()), "label": pa.array(label, pa.int32()),
                                   "predicted": pa.array(predicted, pa.int32()), "n": pa.array(cells.values(), pa.int64())})

    return rows.filter("y is not null").select("iid", "x", "y").mapInArrow(
        count, "model int, label int, predicted int, n long").groupBy("model", "label", "predicted").agg(F.sum("n").alias("n"))


def class_report(cells: DataFrame) -> DataFrame:
    """Per class of ``confusion``: ``(model, label, n, n_predicted, recall, precision)``, null where there is nothing to divide by."""
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select("model", F.explode(F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("n"), F.lit(0).cast("long").alias("p"), hit.alias("h")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("n"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("c"))
    sums = sides.groupBy("model", "c.label").agg(F.sum("c.n").alias("n"), F.sum("c.p").alias("n_predicted"), F.sum("c.h").alias("_h"))
    return sums.select("model", "label", "n", "n_predicted", F.try_divide("_h", "n").alias("recall"),
                       F.try_divide("_h", "n_predicted").alias("precision"))


def linear_effects(weights: DataFrame) -> DataFrame:
    """The linear network of a bias-free weight table as one signed effect per marker.

    Layers are multiplied from the output back, so the table with one row per marker and neuron is
    joined once, to a small product.
    """
    return weight_product(weights.filter("i >= 0"), absolute=False).groupBy(F.col("i").alias("marker")).agg(
        F.sum("w").alias("beta"))


def weight_product(weights: DataFrame, absolute: bool, activation: str | None = None) -> DataFrame:
    """Product of the weight matrices (or of their absolute values) as ``(i, k, w)``."""
    last = weights.agg(F.max("layer")).first()[0]
    value = F.col("w")
    if activation is not None:
        value = F.when(F.col("layer") < last, _activated(activation, F.col("w"))).otherwise(value)
    if absolute:
        value = F.abs(value)
    cells = weights.filter("i >= 0").select("layer", "i", "j", value.alias("w"))
    product = cells.filter(F.col("layer") == last).select("i", F.col("j").alias("k"), "w")
    for layer in range(last - 1, -1, -1):
        right = product.select(F.col("i").alias("j"), "k", F.col("w").alias("_r"))
        product = cells.filter(F.col("layer") == layer).join(right, "j").groupBy("i", "k").agg(
            F.sum(F.col("w") * F.col("_r")).alias("w"))
    return product


def _activated(name: str, x):
    if name == "sigmoid":
        return 1 / (1 + F.exp(-x))
    if name == "relu":
        return F.greatest(x, F.lit(0.0))
    if name == "softplus":
        return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    if name == "leaky":
        return F.when(x > 0, x).otherwise(LEAK * x)
    return x


def class_rows(rows: DataFrame) -> DataFrame:
    """Training rows of classes from ``(iid, x, label)``; those without a label are left out, and batches are kept where there are any."""
    batch = ["batch_id", "is_remainder"] if "batch_id" in rows.columns else [F.lit(0).alias("batch_id"), F.lit(False).alias("is_remainder")]
    return rows.filter("label is not null").select("iid", "x", F.col("label").cast("double").alias("y"), *batch)


def train_classifier(rows: DataFrame, hidden: list[int], labels: int = 2, plan: TrainingPlan | None = None, seed: int = 1,
                     markers: list[int] | None = None, activation: str = "sigmoid", valid: DataFrame | None = None) -> Trained:
    """Softmax network of the classes 0 to ``labels - 1``, fitted by cross-entropy on ``(iid, x, label)``; its metric is accuracy."""
    if markers is None:
        first = rows.select(F.size("x")).first()
        markers = list(range(first[0] if first else 0))
    net = init_network(markers, hidden, labels, activation, seed, "softmax")
    plan = plan or TrainingPlan(epochs=50, learn_rate=0.05, optimizer="adam")
    return train(class_rows(rows), net, plan, None if valid is None else class_rows(valid))


def classify(rows: DataFrame, hidden: list[int], labels: int = 2, epochs: int = 50, seed: int = 1,
             to_score: DataFrame | None = None) -> DataFrame:
    """Class probabilities ``(iid, output, yhat)`` of a softmax network fitted on ``(iid, x, label)``."""
    plan = TrainingPlan(epochs=epochs, learn_rate=0.05, optimizer="adam", eval_every=epochs)
    trained = train_classifier(rows, hidden, labels, plan, seed)
    return predict(rows if to_score is None else to_score, trained.network)
