import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from locusframe.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Panel:
    """A small random genotype panel as arrays and as tables."""

    def __init__(self, spark, n=61, p=23, seed=5, missing=0.01):
        rng = np.random.default_rng(seed)
        freq = rng.uniform(0.2, 0.6, p)
        self.raw = rng.binomial(2, freq, (n, p)).astype(int)
        self.raw[rng.random((n, p)) < missing] = -1
        self.m = np.maximum(self.raw, 0).astype(float)
        self.z = (self.m - self.m.mean(0)) / self.m.std(0)
        g = self.z[:, ::3].sum(1)
        y = g / g.std() + rng.standard_normal(n)
        self.y = (y - y.mean()) / y.std()
        i, j = np.indices((n, p))
        self.n, self.p = n, p
        self.geno = spark.createDataFrame(
            pd.DataFrame({"iid": i.ravel(), "marker": j.ravel(), "dosage": self.raw.ravel()}),
            "iid long, marker int, dosage int").repartition(5).cache()
        self.pheno = spark.createDataFrame(pd.DataFrame({"iid": np.arange(n), "y": self.y}), "iid long, y double").cache()


@pytest.fixture(scope="session")
def panel(spark):
    return Panel(spark)


def square(grm, n, value="k"):
    pdf = grm.toPandas()
    out = np.full((n, n), np.nan)
    out[pdf.i, pdf.j] = pdf[value]
    out[pdf.j, pdf.i] = pdf[value]
    return out


def by_marker(effects):
    return effects.toPandas().sort_values("marker").beta.to_numpy()
