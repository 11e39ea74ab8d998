import numpy as np

from pyspark.sql import functions as F

from locusframe.llm.multiprobe import nearest, perturbation_sets


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank string, v int").repartition(3)


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = nearest(rows, F.col("vec_id") % 20 == 0).toPandas()
    pdf = rows.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        at = {i: k for k, i in enumerate(ids)}
        assert np.allclose(own.score, [x[at[v]] @ x[at[q]] for v in own.vec_id], rtol=0, atol=1e-12)
        hits += len({v for v, _ in want[q]} & set(own.vec_id))
    assert got.query_id.nunique() == len(want) and hits >= 0.9 * 20 * len(want)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 0.0], 0, "c", 1) for i in range(0, 90)]  # a third are copies
    rows += [(100 + i, [float(a) for a in rng.standard_normal(3)], 0, "c", 1) for i in range(150)]
    odd = [(400, None, 0, "c", 1), (420, [0.0, 0.0, 0.0], 0, "c", 1), (440, [1.0, None, 0.0], 0, "c", 1), (460, [1.0, float("nan"), 0.0], 0, "c", 1),
           (480, [float("inf"), 0.0, 0.0], 0, "c", 1), (500, [1.0, 2.0], 0, "c", 1), (520, [], 0, "c", 1), (None, [1.0, 2.0, 0.0], 0, "c", 1)]
    got = nearest(frame(spark, rows + odd), F.col("vec_id") % 20 == 0, recall=1.0, k=2).toPandas()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    assert set(got.query_id) == set(want) and not set(got.vec_id) & {400, 420, 440, 460, 480, 500, 520}
    copies = got[got.query_id == 20].sort_values("rank")
    assert list(copies.vec_id) == [v for v, _ in want[20]]
    assert (got.groupby("query_id")["rank"].count() == 20).all()


def test_few_and_no_vectors(spark):
    few = frame(spark, [(0, [1.0, 0.0], 0, "c", 1), (1, [0.9, 0.1], 0, "c", 1), (2, [0.8, 0.1], 0, "c", 1)])
    got = nearest(few, F.col("vec_id") % 20 == 0, recall=1.0, k=1, tables=3).toPandas().sort_values("rank")
    assert list(got.vec_id) == [1, 2][: len(got)] and len(got) >= 1
    assert nearest(few.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    one = nearest(frame(spark, [(0, [1.0, 0.0], 0, "c", 1)]), F.col("vec_id") % 20 == 0)
    assert one.count() == 0


def test_perturbations_cost_more_and_more():
    sets = perturbation_sets(3)
    assert sets[0] == () and sets[1] == (0,) and len(sets) == len(set(sets)) == 27
    assert all(len({min(r, 5 - r) for r in s}) == len(s) for s in sets)


def test_all_candidates_where_there_are_at_most_as_many(spark):
    few = [(0, [1.0, 0.0], 0, "c", 1), (1, [0.9, 0.1], 0, "c", 1), (2, [0.8, 0.1], 0, "c", 1), (3, [-50.0, 3.0], 0, "c", 1), (20, [0.0, 90.0], 0, "c", 1)]
    for recall in (0.5, 0.96):
        got = nearest(frame(spark, few), F.col("vec_id") % 20 == 0, recall=recall).toPandas()
        assert {q: list(own.sort_values("rank").vec_id) for q, own in got.groupby("query_id")} == {0: [1, 2, 20, 3], 20: [3, 1, 2, 0]}


def test_recall_of_each_query_in_clusters_and_between(spark):
    rng = np.random.default_rng(4)
    dense = rng.standard_normal(8) + 0.02 * rng.standard_normal((900, 8))
    x = np.concatenate([dense, 3 * rng.standard_normal((100, 8))])
    order = rng.permutation(len(x))
    x = np.asarray(x[order], np.float32).astype(float)
    ids = np.arange(len(x))
    queries = np.flatnonzero((ids % 20 == 0) | (order >= 900))
    chosen = F.col("vec_id").isin(queries.tolist())
    got = nearest(frame(spark, [(int(i), v.tolist(), 0, "c", 1) for i, v in zip(ids, x)]), chosen).toPandas()
    want = brute(ids, x, queries, 20)
    found = {q: set(own.vec_id) for q, own in got.groupby("query_id")}
    shares = [len(found.get(q, set()) & {v for v, _ in best}) / 20 for q, best in want.items()]
    assert (got.groupby("query_id")["rank"].count() == 20).all() and len(found) == len(want)
    assert min(shares) >= 0.8 and np.mean(shares) >= 0.96
