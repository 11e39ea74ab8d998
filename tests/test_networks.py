import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe.operators import explain, sampling, transform
from locusframe.operators import network as nn
from locusframe.session import materialise


@pytest.fixture(scope="module")
def data(spark, panel):
    z, _ = transform.standardise(panel.geno)
    rows = nn.training_table(z, panel.pheno, list(range(panel.p)), 20, 3, tasks=4)
    return rows, materialise(nn.wide(z, list(range(panel.p))).join(panel.pheno, "iid"))


@pytest.mark.parametrize("activation", ["sigmoid", "softplus", "leaky", "linear", "relu"])
def test_gradients_match_differences(activation):
    net = nn.init_network(list(range(6)), [5, 3], 2, activation, seed=2)
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((7, 6)), rng.standard_normal((7, 2))
    theta = net.flat()
    grad, _ = nn.loss_gradient(net, x, y)
    plan = nn.TrainingPlan(l2=0.3, l1=0.2, ortho=0.1, cosine=0.4)

    def penalty(n):
        w = n.w[1]
        u = w / np.linalg.norm(w, axis=0)
        return (0.5 * 0.3 * (n.w[0] ** 2).sum() + 0.5 * 0.2 * np.abs(w).sum() + 0.5 * 0.4 * (np.tril(u.T @ u, -1) ** 2).sum()
                + 0.5 * 0.1 * np.abs(w.T @ w - np.eye(w.shape[1])).sum())

    pen = nn.penalty_gradient(net, plan)
    for k in range(0, len(theta), 3):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        up, down = net.with_flat(theta + step), net.with_flat(theta - step)
        assert abs((nn.loss_gradient(up, x, y)[1] - nn.loss_gradient(down, x, y)[1]) / 2e-6 - grad[k]) < 1e-5
        assert abs((penalty(up) - penalty(down)) / 2e-6 - pen[k]) < 1e-5


def test_class_gradients_match_differences():
    net = nn.init_network(list(range(6)), [5, 3], 4, "softplus", seed=2, loss="softmax")
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((9, 6)), rng.integers(0, 4, 9).astype(float)
    theta, grad = net.flat(), nn.loss_gradient(net, x, y)[0]
    for k in range(0, len(theta), 3):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        up, down = net.with_flat(theta + step), net.with_flat(theta - step)
        assert abs((nn.loss_gradient(up, x, y)[1] - nn.loss_gradient(down, x, y)[1]) / 2e-6 - grad[k]) < 1e-5
    for wrong in (4.0, -1.0, 0.5, np.nan):
        with pytest.raises(ValueError):
            nn.loss_gradient(net, x[:1], np.array([wrong]))


def test_chunks_of_many_tasks_are_added_up(spark, monkeypatch):
    monkeypatch.setattr(nn, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    rows = [(m, at, 2, rng.random(size).tolist()) for m in (0, 1) for at, size in ((0, 4), (4, 3)) for _ in range(11)]
    parts = spark.createDataFrame(rows, "model int, at int, n long, g array<double>").repartition(10)
    got = {(r.model, r.at): r for r in nn._sum_chunks(parts).collect()}
    assert len(got) == 4
    for key, r in got.items():
        want = np.sum([g for m, at, _, g in rows if (m, at) == key], axis=0)
        assert r.n == 22 and np.abs(np.array(r.g) - want).max() < 1e-12


def test_several_outputs_are_trained_and_scored(spark, panel, data):
    _, held = data
    rows = held.select("iid", "x", F.array("y", -F.col("y"), F.col("y") * 2).alias("y"), F.lit(0).alias("batch_id"), F.lit(False).alias("is_remainder"))
    net = nn.init_network(list(range(panel.p)), [4], 3, seed=4)
    plan = nn.TrainingPlan(epochs=1, learn_rate=0.01, eval_every=1)
    trained = nn.train(rows, net, plan, rows)
    y = np.column_stack([panel.y, -panel.y, 2 * panel.y])
    theta = net.flat() - 0.01 * nn.loss_gradient(net, panel.z, y)[0] / panel.n
    assert np.abs(theta - trained.network.flat()).max() < 1e-10
    got = nn.predict(rows, trained.network).toPandas().sort_values(["iid", "output"])
    want = trained.network.forward(panel.z)[0]
    assert np.abs(got.yhat.to_numpy().reshape(-1, 3) - want).max() < 1e-10
    r2 = np.mean([np.corrcoef(want[:, k], y[:, k])[0, 1] ** 2 for k in range(3)])
    assert abs(trained.history[0][2] - r2) < 1e-9


def test_decorrelation_gradient(panel, data):
    net = nn.init_network(list(range(panel.p)), [4, 3], seed=8)
    theta = net.flat()

    def cost(n):
        h = n.forward(panel.z)[2][-1]
        c = np.cov(h.T, bias=True)
        np.fill_diagonal(c, 0.0)
        return 0.5 * 2.0 * (c @ c).sum() + ((n.forward(panel.z)[0][:, 0] - panel.y) ** 2).mean()

    rows = data[0].withColumn("is_remainder", F.lit(False))
    plan = nn.TrainingPlan(decorrelation=2.0)
    grad = nn._gradients(rows, {0: net}, {0: plan}, 0)[0]
    for k in range(0, len(theta), 9):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        num = (cost(net.with_flat(theta + step)) - cost(net.with_flat(theta - step))) / 2e-6
        assert abs(num - grad[k]) < 1e-6


def test_l2_can_shrink_with_the_batch():
    net = nn.init_network([0, 1], [2], seed=1)
    a = nn.penalty_gradient(net, nn.TrainingPlan(l2=1.0, l2_by_batch=True), 0.25)
    assert np.allclose(4 * a, nn.penalty_gradient(net, nn.TrainingPlan(l2=1.0)))


def test_layer_widths():
    assert nn.layer_widths(5, 16) == [16, 8, 4, 2]
    assert nn.layer_widths(4, 16, 2) == [16, 16, 8, 8]
    assert nn.layer_widths(0, 16) == []


def test_distributed_training_equals_local(panel, data):
    rows, held = data
    net = nn.init_network(list(range(panel.p)), [4], seed=4)
    plan = nn.TrainingPlan(epochs=3, learn_rate=0.02, momentum=0.9, l2=0.05, eval_every=1)
    trained = nn.train(rows, net, plan, held)
    pdf = rows.toPandas()
    assert pdf.is_remainder.sum() == panel.n % 20
    theta, speed = net.flat(), None
    for _ in range(3):
        for b in sorted(pdf[~pdf.is_remainder].batch_id.unique()):
            part = pdf[pdf.batch_id == b]
            local = net.with_flat(theta)
            g = nn.loss_gradient(local, np.stack(part.x), part.y.to_numpy())[0] / len(part) + nn.penalty_gradient(local, plan)
            speed = g if speed is None else 0.9 * speed + g
            theta = theta - 0.02 * speed
    assert np.abs(theta - trained.network.flat()).max() < 1e-10
    yhat = nn.predict(held, trained.network).toPandas().sort_values("iid").yhat
    assert len(yhat) == panel.n
    want = trained.network.forward(panel.z)[0][:, 0]
    assert np.abs(yhat - want).max() < 1e-10
    assert abs(trained.history[-1][2] - np.corrcoef(want, panel.y)[0, 1] ** 2) < 1e-9


@pytest.mark.parametrize("optimizer", ["adam", "amsgrad"])
def test_adaptive_optimisers_and_dropout_are_repeatable(panel, data, optimizer):
    rows, held = data
    net = nn.init_network(list(range(panel.p)), [4], seed=4)
    plan = nn.TrainingPlan(epochs=2, learn_rate=0.05, optimizer=optimizer, dropout=0.2, decay=0.001, decay_after=0)
    a = nn.train(rows, net, plan).network.flat()
    b = nn.train(materialise(rows.repartition(7)), net, plan).network.flat()
    assert np.abs(a - b).max() < 1e-9 and np.abs(a - net.flat()).max() > 1e-3


def test_early_stop_and_search(panel, data):
    rows, held = data
    net = nn.init_network(list(range(panel.p)), [3], seed=4)
    best = nn.train_until_best(rows, net, nn.TrainingPlan(epochs=3, learn_rate=0.3, eval_every=1), held)
    assert best.best[1] == best.history[-1][0]
    space = nn.SearchSpace((3, 6), (1, 3), (1, 3), (0.0, 0.2), (0.01, 0.1))
    table, top = nn.hyper_search(rows, held, list(range(panel.p)), nn.TrainingPlan(), space, trials=4, start_up=2)
    assert table.count() == 4 and top["epochs"] >= 1
    assert nn.trial_responses(table).count() == 20


def test_weight_table_round_trip_and_products(spark, panel):
    net = nn.init_network([3, 8, 20], [4, 2], 1, "relu", seed=9)
    net.b[0][:] = [0.1, -0.2, 0.3, 0.0]
    table = nn.network_table(spark, net)
    back = nn.load_network(table, "relu")
    assert back.markers == [3, 8, 20] and np.abs(back.flat() - net.flat()).max() == 0
    g = explain.garson_importance(table).toPandas().sort_values("marker").importance
    assert np.abs(g - np.abs(net.w[0]) @ np.abs(net.w[1]) @ np.abs(net.w[2])[:, 0]).max() < 1e-12
    e = nn.linear_effects(table).toPandas().sort_values("marker").beta
    assert np.abs(e - net.w[0] @ net.w[1] @ net.w[2][:, 0]).max() < 1e-12


@pytest.mark.parametrize("n,k", [(7, 3), (6, 2), (5, 5), (9, 1)])
def test_sets_are_unranked_in_order(n, k):
    got = explain.unrank_sets(np.arange(math.comb(n, k)), n, k)
    assert [tuple(r) for r in got] == list(itertools.combinations(range(n), k))


def test_interaction_scores(spark):
    net = nn.init_network(list(range(8)), [5], seed=1)
    got = {tuple(r.markers): r.score for r in explain.interaction_scan(spark, net, 3, 1.5).collect()}
    assert len(got) == math.comb(8, 3)
    for s in ((0, 1, 2), (2, 5, 7)):
        x = np.zeros((1, 8))
        x[0, list(s)] = 1.5
        assert abs(got[s] - net.forward(x)[0][0, 0]) < 1e-12
    top = explain.strongest_interactions(explain.interaction_scan(spark, net, 2), 3).collect()
    assert [r.strength for r in top] == sorted((r.strength for r in top), reverse=True)


@pytest.mark.parametrize("order,activation,k,strength", [
    (2, "relu", 1, 1.0), (3, "sigmoid", 12, 1.5), (3, "leaky", 40, -0.7), (4, "softplus", 5, 1.0), (3, "linear", 10_000, 1.0), (1, "relu", 3, 1.0)])
def test_bounded_search_finds_the_strongest_sets(spark, order, activation, k, strength):
    net = nn.init_network([3 * m + 1 for m in range(15)], [6, 4], 2, activation, seed=order)
    net.w[0][4:7] = net.w[0][1:4]  # ties
    for output in (0, 1):
        scan = explain.interaction_scan(spark, net, order, strength).filter(F.col("output") == output).withColumn("strength", F.round("strength", 10))
        want = explain.strongest_interactions(scan, k).collect()
        got = explain.top_interactions(spark, net, k, order, strength, output, digits=10).collect()
        assert [r.markers for r in got] == [r.markers for r in want]
        assert np.allclose([r.score for r in got], [r.score for r in want], atol=1e-12)


def test_bounded_search_scores_few_sets(spark, monkeypatch):
    n, k = 120, 10
    net = nn.init_network(list(range(n)), [5], seed=3)
    net.w[0] *= np.exp(-np.arange(n) / 10)[:, None]
    monkeypatch.setattr(explain, "FIRST_SETS", 2000)
    begun = explain.promising_beginnings(spark, net, k).select((n - 1 - F.element_at("places", -1)).alias("n"))
    assert begun.agg(F.sum("n")).first()[0] < 0.05 * math.comb(n, 3)
    want = explain.strongest_interactions(explain.interaction_scan(spark, net, 3), k).collect()
    assert [r.markers for r in explain.top_interactions(spark, net, k).collect()] == [r.markers for r in want]


def test_saliency_is_the_gradient_and_smoothgrad_its_limit(panel, data):
    _, held = data
    net = nn.init_network(list(range(panel.p)), [4, 3], seed=6)
    plain = explain.saliency(held, net, guided=False).filter("iid = 5").toPandas().sort_values("marker").g.to_numpy()
    x = panel.z[5:6]
    for m in (0, 11):
        step = np.zeros_like(x)
        step[0, m] = 1e-6
        assert abs((net.forward(x + step)[0] - net.forward(x - step)[0])[0, 0] / 2e-6 - plain[m]) < 1e-8
    quiet = explain.smoothgrad(held, net, spread=0.0, samples=3, guided=False).filter("iid = 5").toPandas().sort_values("marker").g
    assert np.abs(quiet - np.abs(plain)).max() < 1e-12
    a = explain.mean_saliency(explain.smoothgrad(held, net, samples=4)).toPandas().sort_values("marker").saliency
    b = explain.mean_saliency(explain.smoothgrad(held.repartition(5), net, samples=4)).toPandas().sort_values("marker").saliency
    assert np.abs(a - b).max() < 1e-12


def test_activation_map_counts_a_marker_once_per_set_in_the_joint_row(spark):
    net = nn.init_network(list(range(5)), [3], seed=1)
    sets = spark.createDataFrame([(0, [0, 1]), (1, [1, 4])], "set_id long, markers array<int>")
    got = explain.activation_map(sets, net, 0, subtract_null=True).toPandas()
    x = np.array([[1, 1, 0, 0, 0], [0, 1, 0, 0, 1], [1, 2, 0, 0, 1.0]])
    want = np.abs(nn.activate("sigmoid", x @ net.w[0]) - 0.5)
    for row, sid in enumerate((0, 1, -1)):
        assert np.abs(got[got.set_id == sid].sort_values("neuron").activation - want[row]).max() < 1e-12


def test_classifier_and_oversampling(spark, panel, data):
    _, held = data
    rows = held.select("iid", "x", (F.col("y") > 0).cast("int").alias("label"))
    scored = nn.classify(rows, [4], epochs=30)
    p = scored.toPandas().pivot(index="iid", columns="output", values="yhat")
    label = rows.toPandas().set_index("iid").label.loc[p.index]
    assert np.allclose(p.sum(axis=1), 1.0)
    assert np.mean(p.to_numpy().argmax(axis=1) == label) > 0.8
    missing = rows.withColumn("label", F.when(F.col("iid") > 3, F.col("label")))
    trained = nn.train_classifier(missing, [4], 3, nn.TrainingPlan(epochs=4, optimizer="adam", eval_every=4))
    named = nn.class_rows(missing)
    cells = nn.confusion(named, {0: trained.network})
    best = trained.network.forward(panel.z)[0].argmax(axis=1)
    truth = (panel.y > 0).astype(int)
    for r in nn.class_report(cells).collect():
        own, said = truth[4:] == r.label, best[4:] == r.label
        assert (r.n, r.n_predicted) == (own.sum(), said.sum())
        assert r.recall == (pytest.approx((own & said).sum() / own.sum()) if own.any() else None)
        assert r.precision == (pytest.approx((own & said).sum() / said.sum()) if said.any() else None)
    assert abs(trained.history[-1][1] - (best[4:] == truth[4:]).mean()) < 1e-12
    samples = spark.range(1000).withColumnRenamed("id", "iid")
    plan = sampling.oversample_plan(samples, samples.filter("iid < 50").union(spark.createDataFrame([(5000,)], "iid long")), 9)
    pdf = plan.toPandas()
    assert (pdf.is_case.sum(), (~pdf.is_case).sum()) == (950, 950)
    assert sorted(pdf.row_id) == list(range(1900))
    assert set(pdf[pdf.is_case].iid) <= set(range(50)) and len(set(pdf[pdf.is_case].iid)) > 40
    again = sampling.oversample_plan(samples.repartition(7), samples.filter("iid < 50"), 9).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, pdf.values.tolist()))


def test_a_minibatch_step_reads_its_own_folder_in_one_task(monkeypatch, panel, data):
    """F16: every step read all files of the table, and its sums were shuffled twice."""
    rows, _ = data
    assert rows.select("batch_id", "folder", F.input_file_name()).distinct().count() == rows.select("batch_id").distinct().count() == 4
    net = nn.init_network(list(range(panel.p)), [4], seed=4)
    want = nn._gradients(rows.filter("batch_id = 1"), {0: net}, {0: nn.TrainingPlan()}, 0)[0]
    monkeypatch.setattr(nn, "_sum_chunks", None)
    assert np.abs(nn._gradients(rows.filter("batch_id = 1"), {0: net}, {0: nn.TrainingPlan()}, 0, small=True)[0] - want).max() < 1e-12
    assert np.isfinite(nn.train(rows, net, nn.TrainingPlan(epochs=1)).network.flat()).all()
    monkeypatch.setattr(nn, "MAX_FOLDERS", 2)  # several batches to a folder
    z, _ = transform.standardise(panel.geno)
    few = nn.training_table(z, panel.pheno, list(range(panel.p)), 20, 3)
    assert few.select("folder").distinct().count() == 2
    assert np.abs(nn.train(few, net, nn.TrainingPlan(epochs=1)).network.flat() - nn.train(rows, net, nn.TrainingPlan(epochs=1)).network.flat()).max() < 1e-10
