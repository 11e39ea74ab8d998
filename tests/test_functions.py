import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from locusframe.functions import ranking, scalar, tails


def _t_tail_by_integration(t, df):
    x = np.linspace(abs(t), abs(t) + 400, 4_000_001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return 2 * np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x)


def test_t_tail_matches_integral_and_known_values():
    for t, df in ((0.5, 7), (2.0, 30), (4.0, 498)):
        assert abs(tails.t_two_sided(t, df) - _t_tail_by_integration(t, df)) < 1e-7
    assert abs(tails.t_two_sided(12.706204736, 1) - 0.05) < 1e-9
    assert abs(tails.t_two_sided(2.228138852, 10) - 0.05) < 1e-9
    assert tails.t_two_sided(0.0, 5) == 1.0 and np.isnan(tails.t_two_sided(np.nan, 5))
    assert 0 < tails.t_two_sided(40.0, 300) < 1e-100


def test_chi_square_tail():
    assert abs(tails.chi2_1_sf(3.841458820694124) - 0.05) < 1e-12
    assert tails.chi2_1_sf(-1.0) == 1.0


def test_row_index_is_dense_for_skewed_groups(spark):
    n = 9000
    df = spark.range(n).selectExpr("id as marker", "if(id % 3 = 0, 'hot', concat('r', id)) as rsid")
    got = ranking.with_row_index(df, ["marker"], F.floor(F.col("marker") / ranking.SPAN), by=("rsid",), name="nth")
    hot = got.filter("rsid = 'hot'").orderBy("marker").toPandas().nth.to_numpy()
    assert (hot == np.arange(3000)).all()
    assert got.filter("rsid <> 'hot' and nth <> 0").count() == 0
    sparse = spark.range(500).selectExpr("id * 977 as marker")
    idx = ranking.index_by_integer(sparse, "marker").orderBy("marker").toPandas().idx.to_numpy()
    assert (idx == np.arange(500)).all()


def test_hash_order_does_not_depend_on_partitions(spark):
    df = spark.range(700).withColumnRenamed("id", "iid")
    a = {r.iid: r.idx for r in ranking.index_by_hash(df, "iid", 3).collect()}
    b = {r.iid: r.idx for r in ranking.index_by_hash(df.repartition(13), "iid", 3).collect()}
    assert a == b and sorted(a.values()) == list(range(700))
    assert {r.iid: r.idx for r in ranking.index_by_hash(df, "iid", 4).collect()} != a


def test_scalars(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [0.0, 0.5, float("nan"), float("inf")]}))
    lam = [r[0] for r in df.select(scalar.sane_prior("x")).collect()]
    assert lam == [0.0, 0.5, scalar.MAX_DELTA, scalar.MAX_DELTA]
    row = spark.range(1).select(
        scalar.h2_to_delta(F.lit(0.25)), scalar.h2_to_delta(F.lit(0.0)), scalar.maf_score(F.lit(0.3)),
        scalar.bic(F.lit(100.0), F.lit(50.0), F.lit(2)), scalar.onehot_to_case(F.array(F.lit(0.2), F.lit(0.7)))).first()
    assert row[0] == 3.0 and row[1] == math.exp(10) and abs(row[2] - 0.21 ** 0.75) < 1e-12
    assert abs(row[3] - (100 + 100 * math.log(2 * math.pi) + 100 * math.log(0.5) + math.log(100) * 3)) < 1e-9
    assert row[4] == 2


def test_t_tail_at_large_degrees_of_freedom():
    """The tail tends to the normal one and keeps its digits at the degrees of freedom of all pairs of people."""
    import math

    from locusframe.functions.tails import t_two_sided

    for df in (1e9, 1e13, 5e15):
        for t in (1e-3, 0.5, 2.0, 6.0):
            want = math.erfc(t / math.sqrt(2))
            assert abs(float(t_two_sided(np.array([t]), np.array([df]))[0]) - want) < 1e-6 * want + 1e-300
    join = t_two_sided(np.array([3.0, 3.0]), np.array([999_999.0, 1_000_001.0]))
    assert abs(join[0] - join[1]) < 1e-9 * join[0]
    near = t_two_sided(np.array([2.0, 2.0]), np.array([19_999.9, 20_000.1]))
    assert abs(near[0] - near[1]) < 1e-9


def test_counted_draws_are_the_same_in_sql():
    import duckdb

    from locusframe.functions import draws

    ids, places = np.arange(0, 4000, 37), np.arange(0, 5000, 411)
    got = draws.uniform(7, ids[:, None], places[None]).ravel()
    want = duckdb.sql(f"""select {draws.uniform_sql(7, 'i', 'p')} from (select unnest({ids.tolist()}) as i), (select unnest({places.tolist()}) as p)
        order by i, p""").fetchall()
    assert np.array_equal(got, [r[0] for r in want]) and ((got > 0) & (got < 1)).all()
    z = draws.normal(3, np.arange(2000)[:, None], np.arange(50)[None])
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.01 and abs(np.corrcoef(z[:, 0], z[:, 1])[0, 1]) < 0.08
