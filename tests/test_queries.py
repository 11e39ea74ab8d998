import pytest
from check_oracles import compare, duck, entry
from conftest import SF

# One query per family here; ``python tests/check_oracles.py`` runs them all.
SAMPLE = ("qc_all", "qc_union", "standardise", "dup_rename", "minibatch", "oversample", "uni_reg", "multi_reg", "predict_significant",
          "kinship_add", "kinship_weighted", "he_components", "region_windows", "ridge_hetero", "score_by_allele", "garson",
          "interaction_scan", "top_interactions", "mlp_class_report", "saliency", "uni_reg_sparse")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    first = entry.entry(spark)
    assert {"marker", "beta", "p", "maf"} <= set(first.columns) and first.count() > 0


def test_rounding_of_pairs(spark):
    """Rounding a row per pair in doubles gives what decimals give, ties and negative zeros too."""
    ties = spark.createDataFrame([(x,) for x in (0.03125, -0.03125, 0.09375, 2.5, -0.00004, 0.0, -0.0, None, float("nan"), 1e9 + 0.5, -1.28125)], "k double")
    values = spark.range(200_000).selectExpr("double(float((xxhash64(id) % 100003) / 20011d)) as k").unionByName(ties)
    for digits in (4, 6):
        both = values.select(entry._rd("k", digits).alias("a"), entry._rk("k", digits).alias("b"))
        assert both.where("not (a <=> b)").count() == 0
        assert both.where("string(b) = '-0.0'").count() == 0
