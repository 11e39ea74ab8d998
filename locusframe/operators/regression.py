"""Least-squares association tests and prediction with significant coefficients.

A one-marker regression needs six sums, so all markers are fitted in one partial aggregate. A
joint regression needs the cross-product matrix of its columns; that is a tile product, and only
the k x k result (k bounded) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.ranking import index_by_integer
from locusframe.functions.scalar import observed
from locusframe.functions.tails import t_pvalue, t_two_sided
from locusframe.operators import cholesky
from locusframe.operators.tiles import ABSENT, COLS, ROWS, gram, tile_table
from locusframe.session import MAX_DRIVER_SIDE, collect_bounded, materialise

INTERCEPT = -1
# Bytes of sums that a task holds before it sends them on.
TASK_BYTES = 64 << 20


def association_sums(geno: DataFrame, pheno: DataFrame, sparse: bool = False) -> DataFrame:
    """n, Sx, Sy, Sxx, Sxy, Syy per marker, over those with a phenotype. ``sparse``: zero cells are left out of ``geno``.

    The phenotype is stored first, so that its size decides between broadcasting it and shuffling
    the genotypes.
    """
    pheno = materialise(pheno.where("y is not null").select("iid", "y"))
    x, y = observed("dosage").cast("double"), F.col("y")
    joined = geno.join(pheno, "iid")
    if not sparse:
        return joined.groupBy("marker").agg(
            F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
            F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    total = pheno.agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"),
                               F.sum(y * y).alias("syy"))).scalar()
    return joined.groupBy("marker").agg(
        F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"),
    ).withColumn("_t", total).select(
        "marker", F.col("_t.n").alias("n"), "sx", F.col("_t.sy").alias("sy"), "sxx", "sxy",
        F.col("_t.syy").alias("syy"))


def association_sums_from_tiles(tiles: DataFrame, pheno: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """The same sums in one pass over a packed tile table, for one phenotype ``(iid, y)`` or many ``(iid, trait, y)`` at once.

    Each tile meets the phenotypes of its rows and is reduced to products with them, ``X'[1 y y^2]`` and the column squares; tasks add those up per
    block of markers before they send them. Only cells that are there count, and for each trait only those who have it. No genotype is a row.
    """
    many = "trait" in pheno.columns
    known = pheno.where("y is not null").select("iid", *(["trait"] if many else []), F.col("y").cast("double").alias("y"))
    traits = sorted(r.trait for r in collect_bounded(known.select("trait").distinct(), MAX_DRIVER_SIDE, "traits")) if many else [None]
    place = {t: k for k, t in enumerate(traits)}
    width = len(traits)
    trait = F.col("trait").cast("string") if many else F.lit(None).cast("string")
    keyed = known.select(F.expr(f"iid div {rows}").cast("int").alias("rb"), F.pmod("iid", F.lit(rows)).cast("int").alias("at"),
                         trait.alias("trait"), "y")
    named = {None if t is None else str(t): k for t, k in place.items()}

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        out = np.full((rows, width), np.nan)
        out[table.column("at").to_numpy(), [named[t] for t in table.column("trait").to_pylist()]] = table.column("y").to_numpy()
        return pa.table({"rb": pa.array([key[0].as_py()], pa.int32()), "side": pa.array([out.tobytes()], pa.binary())})

    pack.__annotations__ = {"key": tuple, "table": pa.Table, "return": pa.Table}
    side = materialise(keyed.groupBy("rb").applyInArrow(pack, "rb int, side binary"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            return pa.record_batch({"cb": pa.array(list(sums), pa.int32()), "s": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

        for batch in batches:
            for cb, x, y in zip(*(batch.column(c).to_pylist() for c in ("cb", "x", "side"))):
                raw = np.frombuffer(x, np.int8).reshape(rows, cols)
                there = raw != ABSENT
                g = np.where(there, np.maximum(raw, 0), 0).astype(float)
                y = np.frombuffer(y).reshape(rows, width)
                have, y = (~np.isnan(y)).astype(float), np.nan_to_num(y)
                one = there.astype(float)
                out = np.stack([one.T @ have, g.T @ have, one.T @ y, (g * g).T @ have, g.T @ y, one.T @ (y * y)])
                sums[cb] = sums[cb] + out if cb in sums else out
                if len(sums) * out.nbytes > TASK_BYTES:
                    yield sent()
                    sums = {}
        yield sent()

    names = ["n", "sx", "sy", "sxx", "sxy", "syy"]

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, cols, width))
        for batch in batches:
            for s in batch.column("s"):
                total += np.frombuffer(s.as_buffer()).reshape(total.shape)
        marker, at = np.nonzero(total[0])
        yield pa.record_batch({"marker": pa.array((key[0].as_py() * cols + marker).astype(np.int32)), "at": pa.array(at.astype(np.int32))}
                              | {c: pa.array(total[k, marker, at]) for k, c in enumerate(names)})

    add.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = tiles.select("rb", "cb", "x").join(side, "rb").select("cb", "x", "side").mapInArrow(products, "cb int, s binary")
    out = parts.groupBy("cb").applyInArrow(add, "marker int, at int, " + ", ".join(f"{c} double" for c in names))
    if not many:
        return out.drop("at")
    labels = tiles.sparkSession.createDataFrame([(k, t) for t, k in place.items()], f"at int, trait {dict(known.dtypes)['trait']}")
    return out.join(F.broadcast(labels), "at").select("trait", "marker", *names)  # a row per trait, their number checked above


def _keys(sums: DataFrame) -> list[str]:
    return [c for c in ("trait", "marker") if c in sums.columns]


def uni_fit(sums: DataFrame) -> DataFrame:
    """beta, se, t, df and sse per marker (and trait) from its sums; null where a marker does not vary."""
    n = F.col("n")
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / n
    return (
        sums.select(*_keys(sums), n.alias("n"), cxx.alias("cxx"), cxy.alias("cxy"), cyy.alias("cyy"))
        .withColumn("beta", F.try_divide("cxy", "cxx"))
        .withColumn("df", F.col("n") - 2)
        .withColumn("sse", F.col("cyy") - F.col("beta") * F.col("cxy"))
        .withColumn("se", F.sqrt(F.col("sse") / F.col("df") / F.col("cxx")))
        .select(*_keys(sums), "beta", "se", F.try_divide("beta", "se").alias("t"), "df", "sse"))


def uni_reg(geno: DataFrame, pheno: DataFrame, bonferroni: bool = True, sparse: bool = False) -> DataFrame:
    """One regression ``y ~ 1 + x`` per marker plus the intercept-only model (marker -1).

    The Bonferroni factor counts the intercept and the product is not capped at 1.
    """
    return uni_reg_from_sums(association_sums(geno, pheno, sparse), bonferroni)


def uni_reg_tiles(tiles: DataFrame, pheno: DataFrame, markers: DataFrame | None = None, bonferroni: bool = True) -> DataFrame:
    """The same from a packed tile table, one pass for all phenotypes ``(iid[, trait], y)``; ``markers`` are those to test."""
    sums = association_sums_from_tiles(tiles, pheno)
    return uni_reg_from_sums(sums if markers is None else sums.join(markers.select("marker"), "marker", "left_semi"), bonferroni)


def uni_reg_from_sums(sums: DataFrame, bonferroni: bool = True) -> DataFrame:
    """Regressions of stored sums, per trait where there are several, and the intercept-only models."""
    sums = materialise(sums)
    by = _keys(sums)[:-1]
    # Every marker has every individual, so any row of the sums holds the totals of y.
    base = sums.groupBy(*by).agg(F.max_by(F.struct("n", "sy", "syy"), "n").alias("_b"), F.count(F.lit(1)).alias("_m")).select(*by, "_b.*", "_m")
    sse = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    intercept = base.where("_m > 0").select(
        *by, F.lit(INTERCEPT).alias("marker"), (F.col("sy") / F.col("n")).alias("beta"),
        F.sqrt(sse / (F.col("n") - 1) / F.col("n")).alias("se"), (F.col("n") - 1).alias("df"), sse.alias("sse"),
    ).select(*by, "marker", "beta", "se", (F.col("beta") / F.col("se")).alias("t"), "df", "sse")
    fits = uni_fit(sums).unionByName(intercept)
    if not bonferroni:
        return fits.withColumn("p", t_pvalue("t", "df"))
    tests = base.select(*by, (F.col("_m") + 1).cast("double").alias("_tests"))
    fits = fits.join(tests, by) if by else fits.withColumn("_tests", tests.select("_tests").scalar())
    return fits.withColumn("p", t_pvalue("t", "df") * F.col("_tests")).drop("_tests")


def solve_least_squares(m: np.ndarray, n: float, bonferroni: bool) -> dict:
    """Coefficients and tests from the cross-product matrix of (columns.., y)."""
    xtx, xty, yty = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    inverse = np.linalg.inv(xtx)
    beta = inverse @ xty
    sse = max(float(yty - beta @ xty), 0.0)
    df = n - len(beta)
    se = np.sqrt(sse / df * np.diag(inverse))
    t = beta / se
    p = t_two_sided(t, df) * (len(beta) if bonferroni else 1)
    return {"beta": beta, "se": se, "t": t, "p": p, "df": float(df), "sse": sse}


def dense_triangle(lower: DataFrame, ids: np.ndarray) -> np.ndarray:
    """A bounded symmetric matrix on the driver from its triangle ``(i, j, s)``; ``ids`` sorted."""
    if len(ids) > MAX_DRIVER_SIDE:
        raise ValueError(f"{len(ids)} columns exceed the driver bound of {MAX_DRIVER_SIDE}")
    table = lower.toArrow()
    i, j = (np.searchsorted(ids, table.column(c).to_numpy()) for c in ("i", "j"))
    out = np.zeros((len(ids), len(ids)))
    out[i, j] = out[j, i] = table.column("s").to_numpy()
    return out


def multi_reg(cells: DataFrame, pheno: DataFrame, bonferroni: bool = True, add_intercept: bool = True, blocked: bool = False) -> DataFrame:
    """Joint least squares of y on the columns of ``cells(iid, term, value)``, ``term >= 0``, any number of them.

    The people of the fit are those with a phenotype and any cell; a cell that isn't there is zero.
    One row per coefficient (term -1 is the intercept) with beta, se, t, p, df, sse and mse. The normal equations are solved exactly: on the
    driver where they are small, else (and with ``blocked``) by blocked Cholesky factors on a tile table, with the same result.
    """
    x = cells.select("iid", (F.col("term") + 2).alias("term"), F.col("value").cast("double").alias("value"))
    rows = materialise(pheno.where("y is not null").select("iid", "y").join(cells.select("iid").distinct(), "iid", "left_semi"))
    x = x.join(rows.select("iid"), "iid", "left_semi")
    if add_intercept:
        x = x.unionByName(rows.select("iid", F.lit(1).alias("term"), F.lit(1.0).alias("value")))
    terms = cells.select("term").distinct().limit(MAX_DRIVER_SIDE - 1).toPandas()["term"].to_numpy()
    n = rows.count()
    if blocked or len(terms) >= MAX_DRIVER_SIDE - 1:
        return _blocked_fit(x, rows, n, bonferroni)
    stacked = x.unionByName(rows.select("iid", F.lit(0).alias("term"), F.col("y").alias("value")))
    ids = np.sort(np.concatenate([[0], [1] if add_intercept else [], terms + 2])).astype(int)
    full = dense_triangle(gram(stacked, "term", "iid", "value"), ids)
    order = np.r_[1:len(ids), 0]
    fit = solve_least_squares(full[np.ix_(order, order)], n, bonferroni)
    out = pd.DataFrame({"term": ids[1:] - 2, "beta": fit["beta"], "se": fit["se"], "t": fit["t"], "p": fit["p"]})
    return cells.sparkSession.createDataFrame(out).selectExpr(
        "int(term) as term", "beta", "se", "t", "p",
        f"double({fit['df']!r}) as df", f"double({fit['sse']!r}) as sse",
        f"double({fit['sse'] / fit['df']!r}) as mse")


def numbered_gram(cells: DataFrame, key: str, value: str, side: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Products of the columns ``key`` of long cells ``(iid, key, value)`` as blocks for ``cholesky``, with the dense numbers
    ``(key, idx)`` of the columns and how many there are."""
    side = side or cholesky.SIDE
    names = materialise(index_by_integer(cells.select(key).distinct(), key))
    numbered = cells.join(names, key).select("idx", "iid", value)
    tiles = materialise(tile_table(numbered, "idx", "iid", value, side, COLS))
    return materialise(cholesky.gram_blocks(tiles, side, COLS, side)), names, names.count()


def _blocked_fit(x: DataFrame, rows: DataFrame, n: int, bonferroni: bool) -> DataFrame:
    """The joint fit of stacked columns ``x(iid, term, value)`` with terms from 1 (the intercept) on."""
    x = materialise(x)
    blocks, names, k = numbered_gram(x, "term", "value")
    right = materialise(x.join(rows, "iid").groupBy("term").agg(F.sum(F.col("value") * F.col("y")).alias("v")).join(names, "term"))
    solved = materialise(cholesky.solve(blocks, right, k).join(right, "idx"))
    explained = solved.agg(F.sum(F.col("beta") * F.col("v"))).first()[0]
    df = float(n - k)
    sse = max(rows.agg(F.sum(F.col("y") * F.col("y"))).first()[0] - explained, 0.0)
    se = F.sqrt(F.lit(sse / df) * F.col("inverse"))
    fit = solved.select((F.col("term") - 2).cast("int").alias("term"), "beta", se.alias("se"), (F.col("beta") / se).alias("t"), F.lit(df).alias("df"))
    return fit.select("term", "beta", "se", "t", (t_pvalue("t", "df") * F.lit(float(k) if bonferroni else 1.0)).alias("p"), "df",
                      F.lit(sse).alias("sse"), F.lit(sse / df).alias("mse"))


def generic_reg(cells: DataFrame, pheno: DataFrame, n: int, p: int, bonferroni: bool = True) -> DataFrame:
    """One regression per column when there are too few rows for a joint fit, else the joint fit."""
    if n <= p + 1:
        geno = cells.select("iid", F.col("term").alias("marker"), F.col("value").alias("dosage"))
        return uni_reg(geno, pheno, bonferroni).withColumnRenamed("marker", "term")
    return multi_reg(cells, pheno, bonferroni)


def linear_predictor(cells: DataFrame, coefs: DataFrame) -> DataFrame:
    """``yhat`` per individual: sum of value x beta plus the intercept coefficient where there is one."""
    slopes = coefs.filter(F.col("term") != INTERCEPT).select("term", "beta")
    const = coefs.filter(F.col("term") == INTERCEPT).agg(F.coalesce(F.sum("beta"), F.lit(0.0))).scalar()
    hit = cells.join(slopes, "term", "left")
    return hit.groupBy("iid").agg(F.sum(F.col("value") * F.coalesce("beta", F.lit(0.0))).alias("_s")).select(
        "iid", (F.col("_s") + const).alias("yhat"))


def squared_residuals(cells: DataFrame, pheno: DataFrame, coefs: DataFrame) -> DataFrame:
    """Squared difference of y and its prediction, of those with a phenotype."""
    yhat = linear_predictor(cells, coefs)
    return yhat.join(pheno.where("y is not null"), "iid").select("iid", F.pow(F.col("y") - F.col("yhat"), F.lit(2.0)).alias("res"))


def predict_significant(cells: DataFrame, coefs: DataFrame, only_significant: bool = True,
                        bonferroni: bool = False, alpha: float = 0.05) -> DataFrame:
    """Predict from the coefficients with p <= alpha. ``bonferroni`` multiplies the stored p-values by
    their number once more."""
    if not only_significant:
        return linear_predictor(cells, coefs)
    small = materialise(coefs.select("term", "beta", "p"))
    factor = float(small.count()) if bonferroni else 1.0
    return linear_predictor(cells, small.filter(F.col("p") * F.lit(factor) <= F.lit(alpha)))
