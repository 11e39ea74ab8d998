"""Scalar formulas as Spark column expressions (all stay inside the JVM)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the shrinkage that stands for "no heritability here".
MAX_DELTA = math.exp(10)


def observed(dosage) -> Column:
    """Replace a missing call (-1) by 0."""
    return F.greatest(F.col(dosage) if isinstance(dosage, str) else dosage, F.lit(0))


def dominance(dosage) -> Column:
    """Dominance contrast: two copies count as one; missing stays missing."""
    col = F.col(dosage) if isinstance(dosage, str) else dosage
    return F.when(col == 2, F.lit(1)).otherwise(col).cast("int")


def maf_score(freq, alpha: float = -0.25) -> Column:
    f = F.col(freq) if isinstance(freq, str) else freq
    return F.pow(f * (1 - f), F.lit(1.0 + alpha))


def h2_to_delta(h2) -> Column:
    """Noise-to-genetic variance ratio; zero heritability gives the largest delta."""
    h = F.col(h2) if isinstance(h2, str) else h2
    return F.when(h == 0, F.lit(MAX_DELTA)).otherwise((1 - h) / h)


def delta_to_h2(delta) -> Column:
    d = F.col(delta) if isinstance(delta, str) else delta
    return 1 / (1 + d)


def sane_prior(prior) -> Column:
    """NaN and infinite shrinkage values become the largest delta."""
    x = F.col(prior) if isinstance(prior, str) else prior
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(MAX_DELTA)).otherwise(x)


def prior_to_lambda(scaled_beta) -> Column:
    """Shrinkage 1/x of a scaled absolute effect, with 1/0 sanitised."""
    x = F.col(scaled_beta) if isinstance(scaled_beta, str) else scaled_beta
    return F.when(x == 0, F.lit(MAX_DELTA)).otherwise(sane_prior(F.try_divide(F.lit(1.0), x)))


def bic(n, sse, k) -> Column:
    """Bayesian information criterion of a least-squares fit with ``k`` estimated parameters."""
    return n + n * F.log(F.lit(2 * math.pi)) + n * F.log(sse / n) + F.log(n) * (k + 1)


def case_to_quantitative(status) -> Column:
    """PLINK status 1/2 to 0/1."""
    return (F.col(status) if isinstance(status, str) else status) - 1


def case_to_onehot(status) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.array((s == 1).cast("double"), (s == 2).cast("double"))


def onehot_to_case(probabilities) -> Column:
    """Position (from 1) of the largest class value; the first one wins a tie."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    return F.array_position(p, F.array_max(p)).cast("int")
