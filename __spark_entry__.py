"""Queries over the parquet tables of a folder, each with the SQL that gives the same rows.

``queries()`` maps a name to a function ``(spark, sf_dir) -> DataFrame``; ``oracle_sql()`` holds the
same result as one SQL statement over the same tables, where SQL can express it. Derived doubles
are rounded on both sides, so that only the order of summation is left out of the comparison.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from locusframe import fixtures as fx  # noqa: E402
from locusframe.functions import draws, scalar  # noqa: E402
from locusframe.operators import align, explain, grm_tiles, kinship, qc, regression, reml, ridge, sampling, scan, score, tiles, transform  # noqa: E402
from locusframe.operators import haseman_elston as he  # noqa: E402
from locusframe.operators import network as nn  # noqa: E402
from locusframe.plans import jobs  # noqa: E402
from locusframe.session import materialise, scratch_dir  # noqa: E402
from locusframe.sources import grm as grm_io  # noqa: E402
from locusframe.sources import plink, sinks, text  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------------------------------------
# SQL side: shared table expressions, pulled in by name with what they depend on.

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "geno": ((), """
        select iid, marker, cast(case
            when marker = 62 then 2 when marker = 63 then 0
            when (iid * 31 + marker * 17) % 97 < marker % 8 then -1
            when v >= 0.08::double + (marker % 16) * 0.022::double then 2
            when v >= -0.05::double + (marker % 16) * 0.022::double then 1
            else 0 end as int) as dosage
        from (select vec_id as iid, cast(i - 1 as int) as marker, cast(embedding[i] as double) as v
              from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))"""),
    "obs": (("geno",), "select iid, marker, greatest(dosage, 0) as g from geno"),
    "pheno": (("obs",), """
        select e.vec_id as iid, cast(max(e.label) + sum(o.g) as double) as y
        from embeddings e join obs o on o.iid = e.vec_id where o.marker % 9 = 3 group by e.vec_id"""),
    "phz": (("pheno",), "select iid, (y - avg(y) over ()) / stddev_pop(y) over () as y from pheno"),
    "marker": ((), """
        select cast(i as int) as marker, cast(1 + i // 16 as varchar) as chrom,
            case when i in (40, 41) then 'rs_dup' else 'rs' || (1000 + i) end as rsid,
            cast(1000 * (i + 1) as bigint) as pos, 'A' as a1, 'C' as a2
        from (select unnest(range(0, (select max(len(embedding)) from embeddings))) as i)"""),
    "copies": (("obs",), "select marker, cast(sum(g) as bigint) as g from obs group by marker"),
    "effect": (("marker", "copies"), """
        select marker, 'rs' || (1000 + marker) as rsid, case when marker % 5 = 0 then 'C' else 'A' end as a1,
            ((g + marker * 37) % 11 - 5) / 10.0::double as beta from marker join copies using (marker)"""),
    "weight": (("marker",), """
        select marker, case when marker % 13 = 0 then 0::double else 1 + marker / 64.0::double end as w from marker"""),
    "member": (("marker", "copies"), """
        select g % 4 as region_id, 'rs' || (1000 + marker) as rsid, marker, marker as position from marker join copies using (marker)"""),
    "rdelta": (("member",), """
        select region_id, case when h2 = 0 then exp(10::double) else (1 - h2) / h2 end as delta
        from (select region_id, [0::double, 0.1::double, 0.2::double, 0.5::double][(count(*) + region_id) % 4 + 1] as h2
              from member group by region_id)"""),
    "sums": (("geno",), """
        select marker, count(*)::double as n, sum(case when dosage = -1 then 1 else 0 end)::double as n_missing,
            sum(greatest(dosage, 0))::double as s1, sum(greatest(dosage, 0) * greatest(dosage, 0))::double as s2,
            sum(dosage)::double as r1, sum(dosage * dosage)::double as r2,
            min(greatest(dosage, 0)) as lo, max(greatest(dosage, 0)) as hi
        from geno group by marker"""),
    "report": (("sums",), """
        select *, case when n_missing / n >= 1 - 0.95::double then 'missing' when maf < 0.01::double then 'maf'
                when variance < 0.02::double then 'variance' end as reason
        from (select *, s1 / (2 * n) as maf, (n * s2 - s1 * s1) / (n * n) as variance, s1 / n as mean from sums)"""),
    "kept": (("obs", "report"), """
        select o.iid, o.marker, o.g from obs o join report r on r.marker = o.marker where r.reason is null"""),
    "params": (("report",), """
        select marker, mean, case when variance = 0 then 1 else sqrt(variance) end as sd, maf
        from report where reason is null"""),
    "z": (("kept", "params"), "select k.iid, k.marker, (k.g - p.mean) / p.sd as z from kept k join params p using (marker)"),
    "kin": (("z",), """
        select a.iid as i, b.iid as j, sum(a.z * b.z) / (select count(distinct marker) from z) as k
        from z a join z b on a.marker = b.marker and b.iid <= a.iid group by a.iid, b.iid"""),
    "tr_params": (("kept",), """
        select marker, avg(g) as mean, case when stddev_pop(g) = 0 then 1 else stddev_pop(g) end as sd
        from kept where iid % 5 <> 0 group by marker"""),
    "zr": (("z",), "select iid, marker, z, dense_rank() over (order by marker) as i from z"),
    "groups": (("obs",), "select marker, cast(iid % 8 as int) as j, cast(sum(g) as bigint) as g from obs group by 1, 2"),
    "lw": (("groups",), """
        select 0 as layer, marker as i, j, (g % 11 - 5) / 40.0::double as w from groups
        union all
        select 1 as layer, j as i, 0 as j, (sum(g)::bigint % 7 - 3) / 5.0::double as w from groups group by j"""),
    "zall": (("obs", "sums"), """
        select o.iid, o.marker, (o.g - s.s1 / s.n) /
            (case when s.n * s.s2 = s.s1 * s.s1 then 1 else sqrt((s.n * s.s2 - s.s1 * s.s1) / (s.n * s.n)) end) as z
        from obs o join sums s using (marker)"""),
    "pre": (("zall", "lw"), """
        select z.iid, w.j as h, sum(z.z * w.w) as s from zall z join lw w on w.layer = 0 and w.i = z.marker
        group by z.iid, w.j"""),
    "covs": ((), """
        select vec_id as iid, 0 as cov, label::double as value from embeddings
        union all select vec_id, 1, (vec_id % 7)::double from embeddings"""),
    "assoc": (("kept", "pheno"), """
        select k.marker, count(*)::double as n, sum(k.g)::double as sx, sum(p.y) as sy, sum(k.g * k.g)::double as sxx,
            sum(k.g * p.y) as sxy, sum(p.y * p.y) as syy from kept k join pheno p using (iid) group by k.marker"""),
    "sparse": ((), """
        select l_orderkey as iid, cast(l_partkey % 128 as int) as marker, least(2, count(*))::double as g
        from lineitem group by 1, 2"""),
    "sparse_y": ((), "select o_orderkey as iid, floor(o_totalprice / 1000) as y from orders"),
}


def _sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for dep in _CTES[name][0]:
                need(dep)
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} as ({_CTES[n][1]})" for n in order] + [f"{n} as ({s})" for n, s in (extra or {}).items()]
    return f"with recursive {', '.join(parts)} {body}" if parts else body


def _r(x: str, digits: int = 6) -> str:
    return f"(case when round({x}, {digits}) = 0 then 0::double else round({x}, {digits}) end)"


def _rd(col, digits: int = 6):
    """Rounded value without a negative zero."""
    r = F.round(F.col(col) if isinstance(col, str) else col, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def _rk(name: str, digits: int = 6):
    """``_rd`` of a column with a row per pair of individuals, in doubles: decimals are most of the time of such a table."""
    t = F.col(name) * 10.0**digits
    r = F.when(F.abs(t - F.rint(t)) == 0.5, t + F.signum(t) / 2).otherwise(F.rint(t)) / 10.0**digits
    return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(name)


# Gauss-Jordan elimination of the matrix in ``aug(a)``, a list of rows; ``gj_done(a)`` is the result.
_GAUSS = {
    "gj": """
        select 1 as k, a from aug union all
        select k + 1, list_transform(a, lambda row, i: case when i = k
            then list_transform(row, lambda v: v / row[k])
            else list_transform(row, lambda v, c: v - row[k] * a[k][c] / a[k][k]) end) from gj where k <= len(a)""",
    "gj_done": "select a from gj where k = len(a) + 1",
    "pos": "select unnest(range(1, (select len(a) + 1 from gj_done))) as i",
}


def _tail(source: str) -> dict[str, str]:
    """Two-sided t tail of ``source(id, t, df)`` by its finite series, for even and odd whole df."""
    return {
        "tt": f"select id, t, df, df / (df + t * t) as c, atan(abs(t) / sqrt(df)) as theta from ({source})",
        "series": """
            select id, sum(case when df % 2 = 0
                then case when k <= (df - 2) / 2 then exp(lgamma(k + 0.5) - lgamma(k + 1) + k * ln(c)) / sqrt(pi()) else 0 end
                else case when k <= (df - 3) / 2 then exp(lgamma(k + 1) - lgamma(k + 1.5) + k * ln(c)) * sqrt(pi()) / 2 else 0 end
                end) as s
            from tt, (select unnest(range(0, (select cast(max(df) / 2 as bigint) + 1 from tt)))::double as k) group by id""",
        "pval": """
            select id, 1 - case when df % 2 = 0 then sin(theta) * s
                else 2 / pi() * (theta + sin(theta) * cos(theta) * s) end as p
            from tt join series using (id)""",
    }


def _register(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f
    return add


# ---------------------------------------------------------------------------------------------
# Shared inputs of the queries.

def _kept(spark, sf):
    return qc.qc_markers(fx.geno(spark, sf))


def _valid(df: DataFrame) -> DataFrame:
    return df.filter("iid % 5 = 0")


def _train(df: DataFrame) -> DataFrame:
    return df.filter("iid % 5 <> 0")


def _phz(spark, sf):
    return transform.standardise_pheno(fx.pheno(spark, sf))


def _zall(spark, sf):
    return transform.standardise(fx.geno(spark, sf))


def _net(spark, sf):
    return nn.load_network(fx.layer_weight(spark, sf), "sigmoid")


def _terms(geno: DataFrame) -> DataFrame:
    return geno.select("iid", F.col("marker").alias("term"), scalar.observed("dosage").cast("double").alias("value"))


# ---------------------------------------------------------------------------------------------
# Marker QC.

@_register("qc_all", _sql(f"""
    select marker, n::bigint as n, n_missing::bigint as n_missing, {_r('maf')} as maf, {_r('variance')} as variance, reason
    from report""", "report"))
def _(spark, sf):
    return qc.qc_report(fx.geno(spark, sf)).select(
        "marker", "n", "n_missing", _rd("maf").alias("maf"), _rd("variance").alias("variance"), "reason")


@_register("qc_geno", _sql("select iid, marker, cast(g as int) as dosage from kept", "kept"))
def _(spark, sf):
    return _kept(spark, sf)[0]


@_register("qc_missing", _sql(f"""
    select marker, {_r('n_missing / n')} as missing_rate, n_missing / n < 1 - 0.95::double as kept from sums""", "sums"))
def _(spark, sf):
    return qc.missing_verdict(fx.geno(spark, sf)).select("marker", _rd("missing_rate").alias("missing_rate"), "kept")


@_register("qc_rare", _sql(f"select marker, {_r('r1 / (2 * n)')} as maf, r1 / (2 * n) >= 0.01::double as kept from sums", "sums"))
def _(spark, sf):
    return qc.rare_verdict(fx.geno(spark, sf)).select("marker", _rd("maf").alias("maf"), "kept")


@_register("qc_rare_from_stats", _sql(f"select marker, {_r('maf')} as maf, maf >= 0.3::double as kept from report", "report"))
def _(spark, sf):
    return qc.rare_verdict_from(qc.marker_stats(fx.geno(spark, sf)), 0.3).select("marker", _rd("maf").alias("maf"), "kept")


@_register("qc_monomorphic", _sql(f"""
    select marker, {_r('sqrt((n * r2 - r1 * r1) / (n * n))')} as sd, n * r2 <> r1 * r1 as kept from sums""", "sums"))
def _(spark, sf):
    return qc.monomorphic_verdict(fx.geno(spark, sf)).select("marker", _rd("sd").alias("sd"), "kept")


@_register("qc_low_variance", _sql(f"""
    select marker, {_r('(n * r2 - r1 * r1) / (n * n)')} as variance,
        (n * r2 - r1 * r1) / (n * n) >= 0.02::double as kept from sums""", "sums"))
def _(spark, sf):
    return qc.low_variance_verdict(fx.geno(spark, sf)).select("marker", _rd("variance").alias("variance"), "kept")


@_register("qc_apply_single", _sql("""
    select g.iid, g.marker, g.dosage from geno g join sums s using (marker) where s.n * s.r2 <> s.r1 * s.r1""", "geno", "sums"))
def _(spark, sf):
    g = fx.geno(spark, sf)
    return qc.apply_verdict(g, qc.monomorphic_verdict(g)).select("iid", "marker", "dosage")


_UNION_SQL = """
    select marker from (
        select iid % 5 = 0 as part, marker, count(*)::double as n, sum(case when dosage = -1 then 1 else 0 end)::double as nm,
            sum(greatest(dosage, 0))::double as s1, sum(greatest(dosage, 0) * greatest(dosage, 0))::double as s2
        from geno group by 1, 2)
    where nm / n >= 1 - 0.95::double or s1 / (2 * n) < 0.01::double or (n * s2 - s1 * s1) / (n * n) < 0.02::double
    group by marker"""


@_register("qc_union", _sql("select marker from failed", "geno", extra={"failed": _UNION_SQL}))
def _(spark, sf):
    g = fx.geno(spark, sf)
    return qc.union_failures(_train(g), _valid(g))


@_register("qc_union_train", _sql("""
    select iid, marker, g as dosage from obs where iid % 5 <> 0 and marker not in (select marker from failed)""",
                                  "geno", "obs", extra={"failed": _UNION_SQL}))
def _(spark, sf):
    g = fx.geno(spark, sf)
    return qc.qc_union(_train(g), _valid(g))[0].select("iid", "marker", "dosage")


@_register("replace_missing", _sql("select iid, marker, g as dosage from obs", "obs"))
def _(spark, sf):
    return qc.replace_missing(fx.geno(spark, sf))


@_register("drop_markers", _sql("select iid, marker, dosage from geno where marker not in (select marker from weight where w = 0)",
                                "geno", "weight"))
def _(spark, sf):
    return qc.drop_markers(fx.geno(spark, sf), fx.weight(spark, sf).filter("w = 0")).select("iid", "marker", "dosage")


@_register("keep_markers", _sql("select iid, marker, dosage from geno where marker in (select marker from report where reason is null)",
                                "geno", "report"))
def _(spark, sf):
    g = fx.geno(spark, sf)
    return qc.keep_markers(g, materialise(qc.kept_markers(qc.qc_report(g)))).select("iid", "marker", "dosage")


@_register("zero_weight_drop", _sql("""
    select k.iid, k.marker, k.g as dosage, w.w from kept k join weight w using (marker) where w.w <> 0""", "kept", "weight"))
def _(spark, sf):
    return _kept(spark, sf)[0].join(qc.drop_zero_weights(fx.weight(spark, sf)).select("marker", "w"), "marker").select(
        "iid", "marker", "dosage", "w")


@_register("max_shrinkage_drop", _sql(f"""
    select m.rsid, {_r('d.delta')} as lambda from member m join rdelta d using (region_id) where d.delta < exp(10::double)""",
                                      "member", "rdelta"))
def _(spark, sf):
    lam = transform.region_lambda(fx.region_member(spark, sf), fx.region_delta(spark, sf))
    return qc.drop_max_shrinkage(lam, scalar.MAX_DELTA).select("rsid", _rd("lambda").alias("lambda"))


@_register("prior_sanitise", _sql(f"""
    select marker, {_r('case when abs(beta) = 0 then exp(10::double) else 1 / abs(beta) end', 4)} as lambda from effect""", "effect"))
def _(spark, sf):
    # The reciprocal is infinite for an effect of 0 and not a number for a missing one.
    raw = F.when(F.col("beta") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.abs("beta")))
    return fx.effect(spark, sf).select("marker", _rd(scalar.sane_prior(raw), 4).alias("lambda"))


@_register("prior_lambda", _sql(f"""
    select marker, {_r('case when s = 0 then exp(10::double) else 1 / s end', 4)} as lambda from (
        select marker, (abs(beta) - min(abs(beta)) over ()) / (max(abs(beta)) over () - min(abs(beta)) over ()) as s
        from effect)""", "effect"))
def _(spark, sf):
    return transform.scale_prior(fx.effect(spark, sf)).select("marker", _rd(scalar.prior_to_lambda("scaled"), 4).alias("lambda"))


_NAN_Z = "select iid, marker, case when z_sd = 0 then null else (g - z_m) / z_sd end as z from (" \
         "select iid, marker, g, avg(g) over w as z_m, stddev_pop(g) over w as z_sd from obs window w as (partition by marker))"


@_register("nan_column_drop", _sql("""
    select e.marker, e.beta from effect e where e.marker not in (select marker from nz where z is null)""",
                                   "effect", "obs", extra={"nz": _NAN_Z}))
def _(spark, sf):
    g = fx.geno(spark, sf)
    params = materialise(qc.marker_stats(g).select("marker", "mean", "sd"))
    # An unguarded z-score: 0 / 0 of a monomorphic marker is not a number.
    z = g.join(params, "marker").select("iid", "marker", F.when(F.col("sd") == 0, F.lit(float("nan"))).otherwise(
        (scalar.observed("dosage") - F.col("mean")) / F.col("sd")).alias("z"))
    return qc.drop_nan_markers(z, fx.effect(spark, sf))[1].select("marker", "beta")


# ---------------------------------------------------------------------------------------------
# Transforms.

@_register("standardise", _sql(f"select iid, marker, {_r('z')} as z from z", "z"))
def _(spark, sf):
    return transform.standardise(_kept(spark, sf)[0])[0].select("iid", "marker", _rd("z").alias("z"))


@_register("standardise_strict", _sql(f"select iid, marker, {_r('z')} as z from z", "z"))
def _(spark, sf):
    return transform.standardise_strict(_kept(spark, sf)[0]).select("iid", "marker", _rd("z").alias("z"))


@_register("standardise_train_params", _sql(f"""
    select k.iid, k.marker, {_r('(k.g - p.mean) / p.sd')} as z from kept k join tr_params p using (marker) where k.iid % 5 = 0""",
                                            "kept", "tr_params"))
def _(spark, sf):
    kept = _kept(spark, sf)[0]
    params = materialise(transform.scale_params(_train(kept)))
    return transform.standardise_with(_valid(kept), params).select("iid", "marker", _rd("z").alias("z"))


@_register("standardise_own_params", _sql(f"""
    select iid, marker, {_r('(g - avg(g) over w) / (case when stddev_pop(g) over w = 0 then 1 else stddev_pop(g) over w end)')} as z
    from kept where iid % 5 = 0 window w as (partition by marker)""", "kept"))
def _(spark, sf):
    return transform.standardise(_valid(_kept(spark, sf)[0]))[0].select("iid", "marker", _rd("z").alias("z"))


@_register("minmax01", _sql(f"""
    select o.iid, o.marker, {_r('case when s.hi = s.lo then o.g::double else (o.g - s.lo)::double / (s.hi - s.lo) end')} as value
    from obs o join sums s using (marker)""", "obs", "sums"))
def _(spark, sf):
    return transform.minmax_01(fx.geno(spark, sf)).select("iid", "marker", _rd("value").alias("value"))


@_register("maf_score", _sql(f"select marker, {_r('pow(maf * (1 - maf), 0.75::double)')} as score from params", "params"))
def _(spark, sf):
    rep = qc.kept_markers(qc.qc_report(fx.geno(spark, sf)))
    return rep.select("marker", _rd(scalar.maf_score("maf")).alias("score"))


@_register("dominance_recode", _sql("select iid, marker, cast(case when dosage = 2 then 1 else dosage end as int) as dosage from geno", "geno"))
def _(spark, sf):
    return transform.dominance_recode(fx.geno(spark, sf))


@_register("epistasis_power", _sql(f"select i, j, {_r('k * k * k')} as k from kin", "kin"))
def _(spark, sf):
    cubed = kinship.epistasis(kinship.kinship_additive(_kept(spark, sf)[0], form="tiles"), 3)
    return grm_tiles.pairs(cubed, 6).select("i", "j", _rk("k"))


@_register("h2_delta", _sql(f"select region_id, {_r('delta')} as delta, {_r('1 / (1 + delta)')} as h2 from rdelta", "rdelta"))
def _(spark, sf):
    return fx.region_delta(spark, sf).select("region_id", _rd("delta").alias("delta"), _rd(scalar.delta_to_h2("delta")).alias("h2"))


@_register("region_lambda", _sql(f"select m.rsid, {_r('d.delta')} as lambda from member m join rdelta d using (region_id)", "member", "rdelta"))
def _(spark, sf):
    return transform.region_lambda(fx.region_member(spark, sf), fx.region_delta(spark, sf)).select(
        "rsid", _rd("lambda").alias("lambda"))


@_register("standardise_pheno", _sql(f"select iid, {_r('y')} as y from phz", "phz"))
def _(spark, sf):
    return _phz(spark, sf).select("iid", _rd("y").alias("y"))


@_register("case_recode", _sql("""
    select iid, cast(y > 6 as int)::double as quantitative, case when y > 6 then 2 else 1 end as decoded from pheno""", "pheno"))
def _(spark, sf):
    s = fx.sample(spark, sf)
    return s.select("iid", scalar.case_to_quantitative("status").alias("quantitative"),
                    scalar.onehot_to_case(scalar.case_to_onehot("status")).alias("decoded"))


# ---------------------------------------------------------------------------------------------
# Sources and sinks over derived data.

@_register("acgt", _sql("""
    select iid, marker, case dosage when 2 then 'AA' when 1 then 'AC' when 0 then 'CC' else '00' end as genotype from geno""", "geno"))
def _(spark, sf):
    return plink.allele_letters(fx.geno(spark, sf), fx.marker(spark, sf))


@_register("dup_rename", _sql("""
    select p_partkey::int as marker, case when count(*) over (partition by p_brand) > 1
        then p_brand || ':dup' || row_number() over (partition by p_brand order by p_partkey) else p_brand end as rsid, p_brand as original
    from part"""))
def _(spark, sf):
    return plink.rename_duplicates(fx.named_part(spark, sf)).select("marker", "rsid", "original")


@_register("marker_subset", _sql("""
    select g.iid, g.marker, m.rsid, g.dosage from geno g join marker m using (marker) where m.marker % 10 = 3""", "geno", "marker"))
def _(spark, sf):
    m = fx.marker(spark, sf)
    return plink.read_marker_subset(fx.geno(spark, sf), m, m.filter("marker % 10 = 3").select("rsid"))


@_register("plink_roundtrip", _sql("select iid, marker, dosage from geno", "geno"))
def _(spark, sf):
    n = fx.table(spark, sf, "embeddings").count()
    path = f"{scratch_dir(spark)}/bed-{os.urandom(8).hex()}"
    plink.write_plink(fx.geno(spark, sf), path, n)
    return plink.read_bed(spark, path, n)


@_register("plink_marker_pushdown", _sql("select iid, marker, dosage from geno where marker between 10 and 12", "geno"))
def _(spark, sf):
    n = fx.table(spark, sf, "embeddings").count()
    path = f"{scratch_dir(spark)}/bed-{os.urandom(8).hex()}"
    plink.write_plink(fx.geno(spark, sf), path, n)
    return plink.read_bed(spark, path, n).filter("marker >= 10 and marker <= 12")


@_register("grm_roundtrip", _sql(f"""
    select i, j, {_r('k::float::double', 4)} as k, (select count(distinct marker) from z)::double as n_snps from kin""", "kin"))
def _(spark, sf):
    n = fx.table(spark, sf, "embeddings").count()
    path = f"{scratch_dir(spark)}/grm-{os.urandom(8).hex()}"
    ids = fx.sample(spark, sf).select("iid", "fid", "iid_str")
    grm_io.write_grm(kinship.kinship_additive(_kept(spark, sf)[0], form="tiles"), path, n, ids)
    return grm_io.read_grm(spark, path)[0].select("i", "j", _rk("k", 4), "n_snps")


# Text and table round trips: write, read back.

def _place(spark, kind: str) -> str:
    return f"{scratch_dir(spark)}/{kind}-{os.urandom(8).hex()}"


@_register("bim_roundtrip", _sql("select marker, chrom, rsid, 0::double as cm, pos, a1, a2 from marker", "marker"))
def _(spark, sf):
    path = _place(spark, "markers")
    plink.write_lines(plink.bim_lines(fx.marker(spark, sf)), path + ".bim")
    return plink.read_bim(spark, path)


_DENSE = "select iid, (row_number() over (order by iid) - 1)::bigint as place, y from pheno"


@_register("fam_roundtrip", _sql("""
    select place as iid, 'F' || iid as fid, 'I' || iid as iid_str, '0' as father, '0' as mother, 0 as gender, (1 + (y > 6)::int)::double as status
    from dense""", "pheno", extra={"dense": _DENSE}))
def _(spark, sf):
    path = _place(spark, "samples")
    plink.write_lines(plink.fam_lines(fx.sample(spark, sf)), path + ".fam")
    return plink.read_fam(spark, path)


@_register("pheno_roundtrip", _sql("select iid, y from pheno", "pheno"))
def _(spark, sf):
    path, people = _place(spark, "pheno"), fx.sample(spark, sf)
    sinks.write_pheno(people.join(fx.pheno(spark, sf), "iid"), path)
    return text.by_position(text.read_pheno(spark, path), people)


@_register("effects_roundtrip", _sql("select rsid, a1, beta from effect", "effect"))
def _(spark, sf):
    path = _place(spark, "effects")
    sinks.write_effects(fx.effect(spark, sf), path)
    return text.read_effects(spark, path)


@_register("summary_stats_roundtrip", _sql(f"""
    select rsid, beta, {_r('(abs(beta) - min(abs(beta)) over ()) / (max(abs(beta)) over () - min(abs(beta)) over ())')} as scaled from effect""", "effect"))
def _(spark, sf):
    path = _place(spark, "stats")
    sinks.write_effects(fx.effect(spark, sf), path)
    return text.read_summary_stats(spark, path).select("rsid", "beta", _rd("scaled").alias("scaled"))


@_register("weights_roundtrip", _sql("select rsid, w from weight join marker using (marker)", "weight", "marker"))
def _(spark, sf):
    path = _place(spark, "weights")
    lines = fx.weight(spark, sf).selectExpr("marker as id", "concat_ws(' ', rsid, w) as value")
    plink.write_lines(lines.unionByName(spark.range(1).selectExpr("-1 as id", "'rsid weight' as value")), path)
    return text.read_weights(spark, path)


@_register("regions_roundtrip", _sql("""
    select (row_number() over (order by start_idx, end_idx) - 1)::bigint as row_no, start_idx, end_idx, delta from (
        select cast(16 * c + 4 * r as int) as start_idx, cast(16 * c + 4 * r + 8 as int) as end_idx, g % 10 + r / 10.0::double as delta
        from (select marker // 16 as c, cast(sum(g) as bigint) as g from copies group by 1), (select unnest(range(0, 3)) as r))""", "copies"))
def _(spark, sf):
    path = _place(spark, "regions")
    sinks.write_regions(align.concat_regions(fx.region_files(spark, sf)), path)
    return text.read_regions(spark, path)


@_register("list_roundtrip", _sql("select 'I' || iid as iid_str from pheno where y > 6", "pheno"))
def _(spark, sf):
    path = _place(spark, "list")
    plink.write_lines(fx.sample(spark, sf).filter("status = 2").selectExpr("iid as id", "iid_str as value"), path)
    return text.read_list(spark, path, "iid_str")


_SCORED = f"select iid, {_r('sum(g * beta)')} as yhat from obs join effect using (marker) group by iid"


@_register("profile_roundtrip", _sql("select (row_number() over (order by iid) - 1)::bigint as line, yhat from scored", "obs", "effect",
                                     extra={"scored": _SCORED}))
def _(spark, sf):
    path = _place(spark, "profile")
    scored = score.polygenic_score(fx.geno(spark, sf).withColumn("g", scalar.observed("dosage")), fx.effect(spark, sf), "g")
    sinks.write_profile(scored, path)
    lines = plink.indexed_lines(spark, path).filter("value <> 'Profile'")
    from locusframe.functions.ranking import index_by_integer
    return index_by_integer(lines, "line", "place").select(F.col("place").alias("line"), _rd(F.col("value").cast("double")).alias("yhat"))


@_register("predictions_roundtrip", _sql("select iid, yhat from scored", "obs", "effect", extra={"scored": _SCORED}))
def _(spark, sf):
    path = _place(spark, "predictions")
    scored = score.polygenic_score(fx.geno(spark, sf).withColumn("g", scalar.observed("dosage")), fx.effect(spark, sf), "g")
    sinks.write_predictions(scored, scored.join(fx.pheno(spark, sf), "iid").transform(score.r2), path)
    return spark.read.parquet(f"{path}/yhat").select("iid", _rd("yhat").alias("yhat"))


@_register("params_roundtrip", _sql(f"select marker, {_r('mean')} as mean, {_r('sd')} as sd from params", "params"))
def _(spark, sf):
    path = _place(spark, "params")
    sinks.write_table(transform.scale_params(_kept(spark, sf)[0]), path)
    return spark.read.parquet(path).select("marker", _rd("mean").alias("mean"), _rd("sd").alias("sd"))


@_register("kept_list", _sql("select rsid, marker from marker join report using (marker) where reason is null", "marker", "report"))
def _(spark, sf):
    return sinks.kept_marker_list(qc.qc_report(fx.geno(spark, sf)), fx.marker(spark, sf))


@_register("bim_parts", """
    select cast(row_number() over (order by p_partkey) - 1 as int) as marker, cast(1 + p_size % 22 as varchar) as chrom, 'rs' || p_partkey as rsid,
        p_size / 8.0::double as cm, cast(p_partkey * 100 + p_size as bigint) as pos, substr(p_type, 1, 1) as a1, substr(p_name, 1, 1) as a2 from part""")
def _(spark, sf):
    path = _place(spark, "part-markers")
    plink.write_lines(plink.bim_lines(fx.part_marker(spark, sf)), path + ".bim")
    return plink.read_bim(spark, path)


@_register("weights_of_counts", "select 'rs' || l_partkey as rsid, count(*) / 4.0::double as w from lineitem group by l_partkey")
def _(spark, sf):
    path = _place(spark, "count-weights")
    lines = fx.count_weight(spark, sf).selectExpr("marker as id", "concat_ws(' ', rsid, w) as value")
    plink.write_lines(lines.unionByName(spark.range(1).selectExpr("-1 as id", "'rsid weight' as value")), path)
    return text.read_weights(spark, path)


@_register("region_members_roundtrip", """
    select cast(p_size % 7 as int) as region_id, 'rs' || p_partkey as rsid,
        cast(row_number() over (partition by p_size % 7 order by p_partkey) - 1 as bigint) as position from part""")
def _(spark, sf):
    path = _place(spark, "members") + "/m_"
    members = fx.table(spark, sf, "part").selectExpr("int(p_size % 7) as region_id", "concat('rs', p_partkey) as rsid", "p_partkey as position")
    sinks.write_region_members(members, path)
    return text.read_region_members(spark, path)


@_register("region_deltas_roundtrip", f"""
    select cast(row_number() over (order by l_partkey) - 1 as int) as region_id, {_r('(1 - h2) / h2')} as delta
    from (select l_partkey, count(*) / (10.0::double + count(*)) as h2 from lineitem group by l_partkey)""")
def _(spark, sf):
    path = _place(spark, "report")
    h2 = fx.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    lines = h2.selectExpr("l_partkey * 2 as id", "concat('Her_K', l_partkey, ' ', n / (double(10) + n), ' 0.01') as value")
    plink.write_lines(lines.unionByName(h2.selectExpr("l_partkey * 2 + 1 as id", "concat('Var_K', l_partkey, ' ', n) as value")), path)
    return text.read_region_deltas(spark, path).select("region_id", _rd("delta").alias("delta"))


@_register("region_files_roundtrip", """
    select cast(n_regionkey + 1 as int) as file_no, cast(row_number() over (partition by n_regionkey order by c_custkey) - 1 as bigint) as row_no,
        cast(c_custkey as int) as start_idx, cast(c_custkey + 10 as int) as end_idx, c_custkey / 8.0::double as delta
    from customer join nation on n_nationkey = c_nationkey where n_regionkey < 3""")
def _(spark, sf):
    """Region files 1 to 3 and 5: reading stops at the missing number."""
    path = _place(spark, "files") + "/scan"
    rows = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation"), F.expr("n_nationkey = c_nationkey")).selectExpr(
        "n_regionkey as k", "int(c_custkey) as start_idx", "int(c_custkey + 10) as end_idx", "c_custkey / double(8) as delta")
    for k, number in ((0, 1), (1, 2), (2, 3), (4, 5)):
        sinks.write_regions(rows.where(F.col("k") == k), f"{path}{number}.txt")
    return text.read_region_files(spark, path)


def _study(spark, sf):
    n = fx.table(spark, sf, "embeddings").count()
    path = f"{scratch_dir(spark)}/bed-{os.urandom(8).hex()}"
    plink.write_plink(fx.geno(spark, sf), path, n)
    return (n, *jobs.tile_study(spark, path, n))


@_register("qc_from_bed", _ORACLES["qc_all"])
def _(spark, sf):
    return _study(spark, sf)[2].select("marker", "n", "n_missing", _rd("maf").alias("maf"), _rd("variance").alias("variance"), "reason")


@_register("kinship_from_bed", _sql(f"select i, j, {_r('k')} as k, (select count(*) from params)::double as n_snps from kin", "kin", "params"))
def _(spark, sf):
    _n, stored, _report, params = _study(spark, sf)
    return kinship.kinship_from_tiles(stored, params, digits=6).select("i", "j", _rk("k"), "n_snps")


@_register("prs_from_bed", _sql(f"select z.iid, {_r('sum(z.z * e.beta)')} as yhat from z join effect e using (marker) group by z.iid", "z", "effect"))
def _(spark, sf):
    n, stored, _report, params = _study(spark, sf)
    return score.score_tiles(stored, fx.effect(spark, sf), params, n).select("iid", _rd("yhat").alias("yhat"))


# ---------------------------------------------------------------------------------------------
# Alignments, set operations, orders.

@_register("align_pheno", _sql("select g.iid, g.marker, g.dosage, p.y from geno g join pheno p using (iid)", "geno", "pheno"))
def _(spark, sf):
    return align.with_pheno(fx.geno(spark, sf), fx.pheno(spark, sf)).select("iid", "marker", "dosage", "y")


@_register("score_by_allele", _sql(f"""
    select o.iid, {_r('sum((case when g.dosage = -1 then 0 when e.a1 = chr(67) then 2 - g.dosage else g.dosage end) * e.beta)')} as yhat
    from obs o join geno g using (iid, marker) join effect e using (marker) where e.rsid in (select rsid from marker)
    group by o.iid""", "obs", "geno", "effect", "marker"))
def _(spark, sf):
    return score.score_by_allele(fx.geno(spark, sf), fx.effect(spark, sf).drop("marker"), fx.marker(spark, sf)).select(
        "iid", _rd("yhat").alias("yhat"))


@_register("region_rsids_found", _sql("select m.region_id, m.rsid, k.marker from member m join marker k using (rsid)", "member", "marker"))
def _(spark, sf):
    return align.resolve_rsids(fx.region_member(spark, sf).drop("marker"), fx.marker(spark, sf))[0].select(
        "region_id", "rsid", "marker")


@_register("region_rsids_missing", _sql("select distinct rsid from member where rsid not in (select rsid from marker)", "member", "marker"))
def _(spark, sf):
    return align.resolve_rsids(fx.region_member(spark, sf), fx.marker(spark, sf))[1]


@_register("case_split", _sql("select iid, y > 6 as is_case from pheno", "pheno"))
def _(spark, sf):
    s = fx.sample(spark, sf)
    cases, others = align.split_cases(s, s.filter("status = 2").select("iid"))
    return cases.select("iid", F.lit(True).alias("is_case")).unionByName(others.select("iid", F.lit(False).alias("is_case")))


@_register("concat_chromosomes", _sql("select iid, marker, dosage from geno", "geno"))
def _(spark, sf):
    per_chrom = lambda t: t.withColumn("chrom_no", F.expr("marker div 16")).withColumn("marker", F.col("marker") % 16)
    geno, _ = align.concat_chromosomes(per_chrom(fx.geno(spark, sf)), per_chrom(fx.marker(spark, sf)))
    return geno.select("iid", "marker", "dosage")


@_register("concat_regions", _sql("""
    select cast(c as int) as file_no, cast(r as int) as row_no, cast(16 * c + 4 * r as bigint) as start_idx,
        cast(16 * c + 4 * r + 8 as bigint) as end_idx, g % 10 + r / 10.0::double as delta
    from (select marker // 16 as c, cast(sum(g) as bigint) as g from copies group by 1), (select unnest(range(0, 3)) as r)""", "copies"))
def _(spark, sf):
    return align.concat_regions(fx.region_files(spark, sf))


@_register("region_order", _sql("select marker, (row_number() over (order by region_id desc, position) - 1)::bigint as new_idx from member", "member"))
def _(spark, sf):
    members = fx.region_member(spark, sf).withColumn("region_id", -F.col("region_id"))
    return align.region_order(members).select("marker", "new_idx")


@_register("shuffle_rows", _sql("select iid, (row_number() over (order by md5('7:' || iid), iid) - 1)::bigint as idx from pheno", "pheno"))
def _(spark, sf):
    return align.shuffled(fx.pheno(spark, sf), 7).select("iid", "idx")


@_register("minibatch", _sql("""
    select iid, cast(idx // 64 as int) as batch_id, idx // 64 >= n // 64 as is_remainder
    from (select iid, row_number() over (order by md5('7:' || iid), iid) - 1 as idx, count(*) over () as n from pheno)""", "pheno"))
def _(spark, sf):
    return align.minibatches(fx.pheno(spark, sf), 64, 7).select("iid", "batch_id", "is_remainder")


@_register("oversample", _sql("""
    select row_id, iid, is_case from ctl union all
    select n.n_others + d.d as row_id, c.iid, true as is_case
    from n, (select unnest(range(0, (select n_others from n))) as d) d
    join cas c on c.idx = ('0x' || substr(md5('11:' || d.d), 1, 8))::bigint % (select n_cases from n)""", "pheno", extra={
        "ctl": "select (row_number() over (order by iid) - 1)::bigint as row_id, iid, false as is_case from pheno where y <= 9",
        "cas": "select row_number() over (order by iid) - 1 as idx, iid from pheno where y > 9",
        "n": "select (select count(*) from ctl) as n_others, (select count(*) from cas) as n_cases"}))
def _(spark, sf):
    s = materialise(fx.pheno(spark, sf))
    return sampling.oversample_plan(s, s.filter("y > 9").select("iid"), 11).select("row_id", "iid", "is_case")


# ---------------------------------------------------------------------------------------------
# Statistics and association.

@_register("marker_stats", _sql(f"""
    select marker, n::bigint as n, n_missing::bigint as n_missing, s1::bigint as allele_count, {_r('maf')} as maf, {_r('mean')} as mean,
        {_r('variance')} as variance, {_r('sqrt(variance)')} as sd, lo, hi from report""", "report"))
def _(spark, sf):
    return qc.marker_stats(fx.geno(spark, sf)).select(
        "marker", "n", "n_missing", "allele_count", *(_rd(c).alias(c) for c in ("maf", "mean", "variance", "sd")), "lo", "hi")


_UNI = {
    "fits": """
        select marker, n - 2 as df, sxy - sx * sy / n as cxy, sxx - sx * sx / n as cxx, syy - sy * sy / n as cyy from assoc""",
    "uni": """
        select marker, cxy / cxx as beta, sqrt((cyy - cxy * cxy / cxx) / df / cxx) as se, df, cyy - cxy * cxy / cxx as sse from fits
        union all
        select -1, sy / n, sqrt((syy - sy * sy / n) / (n - 1) / n), n - 1, syy - sy * sy / n from (
            select count(*)::double as n, sum(y) as sy, sum(y * y) as syy from pheno)""",
}


@_register("uni_reg", _sql(f"""
    select u.marker, {_r('u.beta')} as beta, {_r('u.se')} as se, {_r('u.beta / u.se')} as t, u.df, {_r('u.sse', 4)} as sse,
        {_r('p.p * (select count(*) from uni)')} as p from uni u join pval p on p.id = u.marker""",
                           "assoc", extra=_UNI | _tail("select marker as id, beta / se as t, df from uni")))
def _(spark, sf):
    fit = regression.uni_reg(_kept(spark, sf)[0], fx.pheno(spark, sf))
    return fit.select("marker", *(_rd(c).alias(c) for c in ("beta", "se", "t")), "df", _rd("sse", 4).alias("sse"), _rd("p").alias("p"))


@_register("uni_reg_from_bed", _sql(f"""
    select t.trait, u.marker, {_r('u.beta * t.f')} as beta, {_r('u.se * t.f')} as se, {_r('u.beta / u.se')} as t, u.df, {_r('u.sse * t.f * t.f', 4)} as sse,
        {_r('p.p * (select count(*) from uni)')} as p
    from uni u join pval p on p.id = u.marker, (values ('y', 1.0::double), ('double', 2.0::double)) t(trait, f)""", "assoc",
                                    extra=_UNI | _tail("select marker as id, beta / se as t, df from uni")))
def _(spark, sf):
    _n, stored, _report, params = _study(spark, sf)
    traits = fx.pheno(spark, sf).select("iid", F.explode(F.create_map(F.lit("y"), F.col("y"), F.lit("double"), 2 * F.col("y"))).alias("trait", "y"))
    fit = regression.uni_reg_tiles(stored, traits, params)
    return fit.select("trait", "marker", *(_rd(c).alias(c) for c in ("beta", "se", "t")), "df", _rd("sse", 4).alias("sse"), _rd("p").alias("p"))


@_register("uni_reg_partial_pheno", _sql(f"""
    select u.marker, {_r('u.beta')} as beta, {_r('u.se')} as se, {_r('u.beta / u.se')} as t, u.df, {_r('u.sse', 4)} as sse,
        {_r('p.p * (select count(*) from uni)')} as p from uni u join pval p on p.id = u.marker""", "kept", "pheno", extra={
    "some_y": "select iid, y from pheno where iid % 3 <> 0",
    "some_assoc": _CTES["assoc"][1].replace("join pheno p", "join some_y p"),
    "fits": _UNI["fits"].replace("from assoc", "from some_assoc"), "uni": _UNI["uni"].replace("from pheno", "from some_y"),
} | _tail("select marker as id, beta / se as t, df from uni")))
def _(spark, sf):
    fit = regression.uni_reg(_kept(spark, sf)[0], _some_pheno(spark, sf))
    return fit.select("marker", *(_rd(c).alias(c) for c in ("beta", "se", "t")), "df", _rd("sse", 4).alias("sse"), _rd("p").alias("p"))


@_register("bic", _sql(f"""
    select marker, {_r('n + n * ln(2 * pi()) + n * ln(sse / n) + ln(n) * 3', 4)} as bic
    from (select marker, df + 2 as n, sse from uni where marker >= 0)""", "assoc", extra=_UNI))
def _(spark, sf):
    fit = regression.uni_fit(regression.association_sums(_kept(spark, sf)[0], fx.pheno(spark, sf)))
    n = F.col("df") + 2
    return fit.select("marker", _rd(scalar.bic(n, F.col("sse"), F.lit(2)), 4).alias("bic"))


@_register("association_job", _sql(f"""
    select u.marker, {_r('u.beta')} as beta, {_r('p.p * (select count(*) from uni)')} as p, {_r('r.maf')} as maf
    from uni u join pval p on p.id = u.marker left join params r on r.marker = u.marker""",
                                   "assoc", "params", extra=_UNI | _tail("select marker as id, beta / se as t, df from uni")))
def _(spark, sf):
    return jobs.association(fx.geno(spark, sf), fx.pheno(spark, sf)).select(
        "marker", _rd("beta").alias("beta"), _rd("p").alias("p"), _rd("maf").alias("maf"))


@_register("qc_sparse", _sql(f"""
    select marker, n_samples as n, {_r('s1 / (2 * n_samples)')} as maf,
        {_r('(n_samples * s2 - s1 * s1) / (n_samples::double * n_samples)')} as variance,
        case when s1 / (2 * n_samples) < 0.01::double then 'maf'
            when (n_samples * s2 - s1 * s1) / (n_samples::double * n_samples) < 0.02::double then 'variance' end as reason
    from (select marker, sum(g) as s1, sum(g * g) as s2, (select count(*) from orders) as n_samples from sparse group by marker)""", "sparse"))
def _(spark, sf):
    n = fx.table(spark, sf, "orders").count()
    return qc.qc_report(fx.sparse_geno(spark, sf), n_samples=n).select(
        "marker", "n", _rd("maf").alias("maf"), _rd("variance").alias("variance"), "reason")


@_register("uni_reg_sparse", _sql(f"""
    select marker, {_r('cxy / cxx', 4)} as beta, {_r('sqrt((cyy - cxy * cxy / cxx) / (n - 2) / cxx)', 4)} as se from (
        select marker, n, sxy - sx * sy / n as cxy, sxx - sx * sx / n as cxx, syy - sy * sy / n as cyy from (
            select marker, sum(g) as sx, sum(g * g) as sxx, sum(g * y) as sxy from sparse join sparse_y using (iid) group by marker),
            (select count(*)::double as n, sum(y) as sy, sum(y * y) as syy from sparse_y))""", "sparse", "sparse_y"))
def _(spark, sf):
    fit = regression.uni_fit(regression.association_sums(fx.sparse_geno(spark, sf), fx.sparse_pheno(spark, sf), sparse=True))
    return fit.select("marker", _rd("beta", 4).alias("beta"), _rd("se", 4).alias("se"))


@_register("prs_sparse", _sql(f"""
    select o_orderkey as iid, {_r('coalesce(sum(g * beta), 0)')} as yhat
    from orders left join (select iid, g, beta from sparse join (
        select cast(l_partkey % 128 as int) as marker, (count(*) % 11 - 5) / 10.0::double as beta from lineitem group by 1) using (marker)) s
        on s.iid = o_orderkey group by o_orderkey""", "sparse"))
def _(spark, sf):
    everyone = fx.sparse_pheno(spark, sf)
    return score.polygenic_score(fx.sparse_geno(spark, sf), fx.sparse_effect(spark, sf), "dosage", everyone).select("iid", _rd("yhat").alias("yhat"))


# Normal equations of y on an intercept and kept markers, solved in SQL with the inverse alongside.
_MULTI = {
    "cell": """
        select iid, dense_rank() over (order by marker) + 1 as i, marker, g::double as v from kept
        union all select iid, 1, -1, 1.0::double from pheno""",
    "dim": "select max(i) as p from cell",
    "xx": "select a.i, b.i as j, sum(a.v * b.v) as s from cell a join cell b using (iid) group by a.i, b.i",
    "xy": "select i, max(marker) as marker, sum(v * y) as s from cell join pheno using (iid) group by i",
    "aug": """
        select list(row order by i) as a from (
            select x.i, list_concat(list(x.s order by x.j), list(case when x.i = x.j then 1.0::double else 0 end order by x.j),
                [max(y.s)]) as row from xx x join xy y on y.i = x.i group by x.i)""",
    **_GAUSS,
    "mb": "select y.marker, y.s, g.a[p.i][2 * d.p + 1] as beta, g.a[p.i][d.p + p.i] as inv from gj_done g, dim d, pos p join xy y on y.i = p.i",
    "fit": """
        select marker, beta, sqrt(sse / df * inv) as se, df, sse from mb, (
            select (select sum(y * y) from pheno) - sum(beta * s) as sse, (select count(*) from pheno)::double - count(*) as df from mb)""",
}


@_register("multi_reg", _sql(f"""
    select f.marker as term, {_r('beta')} as beta, {_r('se')} as se, {_r('beta / se')} as t,
        {_r('p * (select count(*) from fit)')} as p, df, {_r('sse', 4)} as sse, {_r('sse / df')} as mse
    from fit f join pval v on v.id = f.marker""",
                             "kept", "pheno", extra=_MULTI | _tail("select marker as id, beta / se as t, df from fit")))
def _(spark, sf):
    fit = regression.multi_reg(_terms(_kept(spark, sf)[0]), fx.pheno(spark, sf))
    return fit.select("term", *(_rd(c).alias(c) for c in ("beta", "se", "t", "p")), "df", _rd("sse", 4).alias("sse"), _rd("mse").alias("mse"))


@_register("multi_reg_blocked", _ORACLES["multi_reg"])
def _(spark, sf):
    fit = regression.multi_reg(_terms(_kept(spark, sf)[0]), fx.pheno(spark, sf), blocked=True)
    return fit.select("term", *(_rd(c).alias(c) for c in ("beta", "se", "t", "p")), "df", _rd("sse", 4).alias("sse"), _rd("mse").alias("mse"))


def _some_multi() -> dict[str, str]:
    part = {"some_y": "select iid, y from pheno where iid % 3 <> 0", "some_kept": "select * from kept where iid in (select iid from some_y)"}
    return part | {k: v.replace("from pheno", "from some_y").replace("join pheno", "join some_y").replace("from kept", "from some_kept")
                   for k, v in _MULTI.items()}


@_register("multi_reg_partial_pheno", _sql(f"""
    select f.marker as term, {_r('beta')} as beta, {_r('se')} as se, {_r('p * (select count(*) from fit)')} as p, df, {_r('sse', 4)} as sse
    from fit f join pval v on v.id = f.marker""", "kept", "pheno", extra=_some_multi() | _tail("select marker as id, beta / se as t, df from fit")))
def _(spark, sf):
    fit = regression.multi_reg(_terms(_kept(spark, sf)[0]), _some_pheno(spark, sf))
    return fit.select("term", *(_rd(c).alias(c) for c in ("beta", "se", "p")), "df", _rd("sse", 4).alias("sse"))


@_register("squared_residuals", _sql(f"""
    select iid, {_r('(y - yhat) * (y - yhat)', 5)} as res from pheno join (
        select iid, sum(v * beta) as yhat from cell join fit using (marker) group by iid) using (iid)""",
                                     "kept", "pheno", extra=_MULTI))
def _(spark, sf):
    cells, y = _terms(_kept(spark, sf)[0]), fx.pheno(spark, sf)
    return regression.squared_residuals(cells, y, regression.multi_reg(cells, y)).select("iid", _rd("res", 5).alias("res"))


@_register("generic_reg", _sql(f"select f.marker as term, {_r('beta')} as beta from fit f", "kept", "pheno", extra=_MULTI))
def _(spark, sf):
    kept, report = _kept(spark, sf)
    y = fx.pheno(spark, sf)
    fit = regression.generic_reg(_terms(kept), y, y.count(), report.filter("reason is null").count())
    return fit.select("term", _rd("beta").alias("beta"))


@_register("predict_significant", _sql(f"""
    select k.iid, {_r('sum(case when u.marker is null then 0 else k.g * u.beta end) + (select beta from sig where marker = -1)')} as yhat
    from kept k left join sig u using (marker) group by k.iid""",
                                       "assoc", extra=_UNI | _tail("select marker as id, beta / se as t, df from uni") | {
    "sig": "select marker, beta from uni join pval on id = marker where p * (select count(*) from uni) <= 0.05"}))
def _(spark, sf):
    kept = _kept(spark, sf)[0]
    coefs = regression.uni_reg(kept, fx.pheno(spark, sf)).withColumnRenamed("marker", "term")
    return regression.predict_significant(_terms(kept), coefs).select("iid", _rd("yhat").alias("yhat"))


# ---------------------------------------------------------------------------------------------
# Relationship matrices.

@_register("kinship_add", _sql(f"select i, j, {_r('k')} as k, (select count(*) from params)::double as n_snps from kin", "kin", "params"))
def _(spark, sf):
    return kinship.kinship_additive(_kept(spark, sf)[0], digits=6).select("i", "j", _rk("k"), "n_snps")


_DOM = {
    "dz": """
        select iid, marker, (d - avg(d) over w) / (case when stddev_pop(d) over w = 0 then 1 else stddev_pop(d) over w end) as z
        from (select iid, marker, case when g = 2 then 1 else g end as d from kept) window w as (partition by marker)""",
    "dk": """
        select a.iid as i, b.iid as j, sum(a.z * b.z) / (select count(*) from params) as k
        from dz a join dz b on a.marker = b.marker and b.iid <= a.iid group by a.iid, b.iid""",
}


@_register("kinship_dom", _sql(f"select i, j, {_r('k')} as k from dk", "kept", "params", extra=_DOM))
def _(spark, sf):
    return kinship.kinship_dominance(_kept(spark, sf)[0], digits=6).select("i", "j", _rk("k"))


@_register("kinship_weighted", _sql(f"""
    select a.iid as i, b.iid as j, {_r('sum(a.z * b.z * w.w) / (select sum(w) from wt)')} as k
    from z a join z b on a.marker = b.marker and b.iid <= a.iid join wt w on w.marker = a.marker group by a.iid, b.iid""",
                                    "z", "weight", "params", extra={
    "wt": "select p.marker, pow(p.maf * (1 - p.maf), 0.75::double) * w.w as w from params p join weight w using (marker) where w.w <> 0"}))
def _(spark, sf):
    kept, report = _kept(spark, sf)
    weights = kinship.marker_weights(report, fx.weight(spark, sf), -0.25)
    return kinship.kinship_weighted(kept, weights, digits=6).select("i", "j", _rk("k"))


@_register("kinship_weighted_before_scaling", _sql(f"""
    select a.iid as i, b.iid as j, {_r('sum(a.z * b.z) / (select count(*) from wt)')} as k
    from z a join z b on a.marker = b.marker and b.iid <= a.iid join wt w on w.marker = a.marker group by a.iid, b.iid""",
                                                   "z", "weight", "params", extra={
    "wt": "select p.marker from params p join weight w using (marker) where w.w <> 0"}))
def _(spark, sf):
    kept, report = _kept(spark, sf)
    weights = kinship.marker_weights(report, fx.weight(spark, sf))
    return kinship.kinship_weighted(kept, weights, mode="reference", digits=6).select("i", "j", _rk("k"))


@_register("kinship_gaussian", _sql(f"""
    select a.iid as i, b.iid as j, {_r('exp(-sum((a.z - b.z) * (a.z - b.z)) / (select count(*) from params))')} as k
    from z a join z b on a.marker = b.marker and b.iid <= a.iid group by a.iid, b.iid""", "z", "params"))
def _(spark, sf):
    return kinship.kinship_gaussian(_kept(spark, sf)[0], digits=6).select("i", "j", _rk("k"))


@_register("euclid", _sql(f"""
    select a.iid as i, b.iid as j, {_r('sqrt(sum((a.g - b.g) * (a.g - b.g))::double)')} as d
    from kept a join kept b on a.marker = b.marker and b.iid <= a.iid group by a.iid, b.iid""", "kept"))
def _(spark, sf):
    return kinship.euclidean_distance(_kept(spark, sf)[0]).select("i", "j", _rk("d"))


@_register("kinship_merge", _sql(f"select i, j, {_r('k')} as k, (select count(*) from params)::double as n_snps from kin", "kin", "params"))
def _(spark, sf):
    kept = _kept(spark, sf)[0]
    halves = [kinship.kinship_additive(kept.filter(c), form="factors") for c in ("marker < 32", "marker >= 32")]
    return kinship.long_rows(kinship.merge_kinships(halves), 6).select("i", "j", _rk("k"), "n_snps")


@_register("kinship_covariates", _sql(f"""
    select a.iid as i, b.iid as j, {_r('sum(a.z * b.z) / 2')} as k
    from cz a join cz b on a.cov = b.cov and b.iid <= a.iid group by a.iid, b.iid""", "covs", extra={
    "cz": "select iid, cov, (value - avg(value) over (partition by cov)) / stddev_pop(value) over (partition by cov) as z from covs"}))
def _(spark, sf):
    return kinship.covariate_kinship(fx.covariates(spark, sf)).select("i", "j", _rk("k"))


@_register("kinship_traces", _sql(f"""
    select count(*) filter (where i = j) as n, {_r('sum(k) filter (where i = j)', 4)} as trace,
        {_r('sum(case when i = j then k * k else 2 * k * k end)', 4)} as sum_sq from kin""", "kin"))
def _(spark, sf):
    t = kinship.trace_stats(kinship.kinship_additive(_kept(spark, sf)[0], form="factors"))
    return t.select("n", _rd("trace", 4).alias("trace"), _rd("sum_sq", 4).alias("sum_sq"))


@_register("decorrelation_cost", _sql(f"""
    select {_r('sum(c * c)')} as decorrelation_cost from (
        select covar_pop(a.z, b.z) as c from z a join z b on a.iid = b.iid and b.marker < a.marker group by a.marker, b.marker)""", "z"))
def _(spark, sf):
    z = materialise(transform.standardise(_kept(spark, sf)[0])[0].withColumnRenamed("z", "value"))
    products = tiles.gram(z, "marker", "iid", "value")
    n = fx.table(spark, sf, "embeddings").count()
    return score.redundancy(z, products, n).select(_rd("decorrelation_cost").alias("decorrelation_cost"))


# ---------------------------------------------------------------------------------------------
# Variance components.

def _he_sql(pairs: str, k: int) -> dict[str, str]:
    """Every nested model of ``pairs(x1..xk, z)`` from its sums of products, solved in SQL."""
    names = ["1.0::double", *(f"x{c}" for c in range(1, k + 1)), "z"]
    cells = [(a, b) for a in range(k + 2) for b in range(a, k + 2)]
    s = lambda a, b: f"s_{min(a, b)}_{max(a, b)}"
    augs = []
    for size in range(k + 1):
        rows = (", ".join([*(s(a, b) for b in range(size + 1)), *(str(float(a == b)) for b in range(size + 1)), s(a, k + 1)])
                for a in range(size + 1))
        augs.append(f"select {size} as size, [{', '.join(f'[{r}]' for r in rows)}]::double[][] as a from m")
    return {
        "pairs": pairs,
        "m": "select " + ", ".join(f"sum({names[a]} * {names[b]}) as {s(a, b)}" for a, b in cells) + " from pairs",
        "aug": " union all ".join(augs),
        "gj": "select size, 1 as k, a from aug union all select size, k + 1, " + _GAUSS["gj"].split("select k + 1, ")[1],
        "co": f"""
            select size, c, a[c][2 * (size + 1) + 1] as beta, a[c][size + 1 + c] as inv, [{', '.join(s(a, k + 1) for a in range(k + 1))}][c] as b
            from (select size, a, unnest(range(1, size + 2)) as c from gj where k = len(a) + 1), m""",
        "sse": f"""
            select size, m.{s(k + 1, k + 1)} - sum(beta * b) as sse, m.s_0_0 - size - 1 as df from co, m
            group by size, m.{s(k + 1, k + 1)}, m.s_0_0""",
        "part": "select size, c - 1 as component, -beta / 2 as vc, sqrt(sse / df * inv) / 2 as se, beta / sqrt(sse / df * inv) as t, df from co join sse using (size) where c > 1",
    } | _tail("select size * 10 + component as id, t, df from part")


def _he_parts(labels: list[str], where: str = "true") -> str:
    names = ", ".join(f"'{x}'" for x in labels)
    return f"""
        select size as components, cast(component as int) as component, [{names}][component] as label,
            {_r('vc')} as vc, {_r('p * (size + 1)')} as p, {_r('se')} as vc_se
        from part join pval on id = size * 10 + component where {where}"""


def _rounded_parts(parts: DataFrame) -> DataFrame:
    return parts.select("components", "component", "label", *(_rd(c).alias(c) for c in ("vc", "p", "vc_se")))


_ADD_EPI = """
    select kin.i, kin.j, kin.k as x1, kin.k * kin.k as x2, (a.y - b.y) * (a.y - b.y) as z
    from kin join phz a on a.iid = kin.i join phz b on b.iid = kin.j where kin.j < kin.i"""
_HE = _he_sql(_ADD_EPI, 2)


@_register("he_crossproducts", _sql(f"""
    select a, b, {_r('s', 2)} as s from (
        select unnest(['1', '1', '1', '1', 'x1', 'x1', 'x1', 'x2', 'x2', 'z']) as a,
            unnest(['1', 'x1', 'x2', 'z', 'x1', 'x2', 'z', 'x2', 'z', 'z']) as b,
            unnest([s_0_0, s_0_1, s_0_2, s_0_3, s_1_1, s_1_2, s_1_3, s_2_2, s_2_3, s_3_3]) as s from m)""",
                                    "kin", "phz", extra={k: _HE[k] for k in ("pairs", "m")}))
def _(spark, sf):
    grm = kinship.kinship_additive(_kept(spark, sf)[0], form="factors")
    return he.cross_products(grm, _phz(spark, sf), epi=2).select("a", "b", _rd("s", 2).alias("s"))


@_register("he_crossproducts_fused", _ORACLES["he_crossproducts"])
def _(spark, sf):
    return he.cross_products_from_genotypes(_kept(spark, sf)[0], _phz(spark, sf), 2).select("a", "b", _rd("s", 2).alias("s"))


def _he(spark, sf, residual=False, dominance=False):
    kept = _kept(spark, sf)[0]
    if dominance:
        return he.he_regression_from_genotypes(kept, _phz(spark, sf), 2, residual, dominance=True)
    return jobs.variance_components(fx.pheno(spark, sf), kinship.kinship_additive(kept, form="factors"), 2, None, residual)


@_register("he_models", _sql(f"""
    select s.size as components, {_r('m.s_0_0 + m.s_0_0 * ln(2 * pi()) + m.s_0_0 * ln(s.sse / m.s_0_0) + ln(m.s_0_0) * (s.size + 2)', 3)} as bic,
        {_r('coalesce(t.vc, 0) / v.v')} as h2, {_r('(coalesce(t.vc, 0) - 1.96 * coalesce(t.se, 0)) / v.v')} as h2_lb,
        {_r('(coalesce(t.vc, 0) + 1.96 * coalesce(t.se, 0)) / v.v')} as h2_ub, {_r('v.v - coalesce(t.vc, 0)')} as ve
    from sse s, m, (select var_pop(y) as v from phz) v
    left join (select size, sum(vc) as vc, sum(se) as se from part join pval on id = size * 10 + component
        where p * (size + 1) <= 0.05 group by size) t on t.size = s.size""", "kin", "phz", extra=_HE))
def _(spark, sf):
    models, _parts = _he(spark, sf)
    return models.select("components", _rd("bic", 3).alias("bic"), *(_rd(c).alias(c) for c in ("h2", "h2_lb", "h2_ub", "ve")))


@_register("he_components", _sql(_he_parts(he.component_labels(2)), "kin", "phz", extra=_HE))
def _(spark, sf):
    return _rounded_parts(_he(spark, sf)[1])


@_register("vc_report", f"""
    select c.*, m.bic, m.h2 from ({_ORACLES['he_components']}) c join ({_ORACLES['he_models']}) m using (components)""")
def _(spark, sf):
    path = _place(spark, "vc")
    sinks.write_vc_report(*_he(spark, sf), path)
    models = spark.read.parquet(f"{path}/vc_model").select("components", _rd("bic", 3).alias("bic"), _rd("h2").alias("h2"))
    return _rounded_parts(spark.read.parquet(f"{path}/vc_component")).join(models, "components")


@_register("he_residual", _sql(_he_parts(he.component_labels(2)), "kin", "phz", extra={"raw": _ADD_EPI} | _he_sql("""
    select i, j, x1, x2 - (select regr_intercept(x2, x1) from raw) - (select regr_slope(x2, x1) from raw) * x1 as x2, z from raw""", 2)))
def _(spark, sf):
    return _rounded_parts(_he(spark, sf, residual=True)[1])


@_register("he_dominance", _sql(_he_parts(he.component_labels(2, True)), "kin", "phz", "params", "kept", extra=_DOM | {"raw": _ADD_EPI} | _he_sql(
    "select raw.i, raw.j, x1, x2, dk.k as x3, z from raw join dk on dk.i = raw.i and dk.j = raw.j", 3)))
def _(spark, sf):
    return _rounded_parts(_he(spark, sf, dominance=True)[1])


@_register("he_from_genotypes", _sql(_he_parts(he.component_labels(2, True, ["covariates"]), "size = 4"), "kin", "phz", "params", "kept", "covs", extra=_DOM | {
    "raw": _ADD_EPI,
    "cz": "select iid, cov, (value - avg(value) over (partition by cov)) / stddev_pop(value) over (partition by cov) as z from covs",
    "ck": "select a.iid as i, b.iid as j, sum(a.z * b.z) / 2 as k from cz a join cz b on a.cov = b.cov and b.iid < a.iid group by a.iid, b.iid",
} | _he_sql("""
    select raw.i, raw.j, x1, x2, dk.k as x3, ck.k as x4, z from raw
    join dk on dk.i = raw.i and dk.j = raw.j join ck on ck.i = raw.i and ck.j = raw.j""", 4)))
def _(spark, sf):
    fit = he.he_regression_from_genotypes(_kept(spark, sf)[0], _phz(spark, sf), 2, dominance=True, covariates=fx.covariates(spark, sf), only_full=True)
    return _rounded_parts(fit[1])


# Where some have no phenotype, everything runs over the others: their marker scales, their pairs, the spread of y.
_SOME = {
    "some_y": "select iid, y from pheno where iid % 3 <> 0",
    "some_kept": "select * from kept where iid in (select iid from some_y)",
    "some_phz": "select iid, (y - avg(y) over ()) / stddev_pop(y) over () as y from some_y",
}
_SOME_KIN = _SOME | {
    "some_z": """
        select iid, marker, (g - avg(g) over w) / case when stddev_pop(g) over w = 0 then 1 else stddev_pop(g) over w end as z
        from some_kept window w as (partition by marker)""",
    "some_kin": """
        select a.iid as i, b.iid as j, sum(a.z * b.z) / (select count(distinct marker) from some_z) as k
        from some_z a join some_z b on a.marker = b.marker and b.iid <= a.iid group by a.iid, b.iid""",
}


def _some_pheno(spark, sf):
    """The phenotype without every third individual's value."""
    return fx.pheno(spark, sf).select("iid", F.expr("if(iid % 3 = 0, null, y)").alias("y"))


@_register("he_partial_pheno", _sql(_he_parts(he.component_labels(2)), "kept", "pheno", extra=_SOME_KIN | _he_sql(
    _ADD_EPI.replace("kin.", "some_kin.").replace("from kin", "from some_kin").replace("phz", "some_phz"), 2)))
def _(spark, sf):
    return _rounded_parts(jobs.variance_components_from_genotypes(_kept(spark, sf)[0], _some_pheno(spark, sf), 2)[1])


@_register("he_stored_partial_pheno", _sql(_he_parts(he.component_labels(2)), "kin", "kept", "pheno", extra=_SOME | _he_sql(
    _ADD_EPI.replace("phz", "some_phz"), 2)))
def _(spark, sf):
    grm = kinship.kinship_additive(_kept(spark, sf)[0], form="factors")
    return _rounded_parts(jobs.variance_components(_some_pheno(spark, sf), grm, 2)[1])


# The likelihood of blocks ``blk(blk, g, b, yy, n, df)`` (g = Z'Z / m, b = Z'y) at many shrinkages, by
# elimination instead of eigenvalues, and its maximum by repeated subdivision of sign changes.

def _reml_sql(levels: int = 7, parts: int = 20) -> dict[str, str]:
    out: dict[str, str] = {"at0": "select blk, k as id, -10 + 0.2::double * k as ld from blk, (select unnest(range(0, 101)) as k)"}

    def evaluate(level: str) -> None:
        out[f"m{level}"] = f"""
            select p.blk, p.id, p.ld, list_transform(g, lambda row, i: list_concat(
                list_transform(row, lambda v, c: case when c = i then v + exp(ld) else v end),
                list_transform(row, lambda v, c: case when c = i then 1.0::double else 0 end), [b[i]])) as a
            from at{level} p join blk using (blk)"""
        out[f"g{level}"] = f"""
            select blk, id, ld, 1 as k, 0.0::double as lg, a from m{level} union all
            select blk, id, ld, k + 1, lg + ln(a[k][k]), list_transform(a, lambda row, i: case when i = k
                then list_transform(row, lambda v: v / row[k])
                else list_transform(row, lambda v, c: v - row[k] * a[k][c] / a[k][k]) end) from g{level} where k <= len(a)"""
        out[f"u{level}"] = f"""
            select e.blk, e.id, e.ld, exp(e.ld) as d, lg, len(a)::double as m, blk.n, blk.df, yy,
                list_sum(list_transform(a, lambda row, i: row[len(a) + i])) as ti,
                list_dot_product(list_transform(a, lambda row: row[2 * len(a) + 1]), b) as bu,
                list_dot_product(list_transform(a, lambda row: row[2 * len(a) + 1]), list_transform(a, lambda row: row[2 * len(a) + 1])) as uu
            from g{level} e join blk using (blk) where k = len(a) + 1"""
        out[f"e{level}"] = f"""
            select blk, id, ld, d, n, df, yy, (yy - bu / m) / d as q,
                0.5::double * (df * ((yy - bu / m - d * uu / m) / (d * d)) / ((yy - bu / m) / d) - ti - (df - m) / d) as slope,
                0.5::double * (df * (ln(df / (2 * pi())) - 1 - ln((yy - bu / m) / d)) - lg - (df - m) * ld) as ll
            from u{level}"""

    evaluate("0")
    falls = """
        select blk, lo, hi from (select blk, slope, lead(slope) over w as nxt, ld as lo, lead(ld) over w as hi from {src} window w as (partition by blk{by} order by id))
        where slope > 0 and nxt <= 0"""
    out["c1"] = falls.format(src="e0", by="")
    for level in range(1, levels + 1):
        out[f"at{level}"] = f"select blk, k as id, lo + (hi - lo) * k / {parts}.0::double as ld from c{level}, (select unnest(range(0, {parts + 1})) as k)"
        evaluate(str(level))
        out[f"c{level + 1}"] = falls.format(src=f"e{level}", by="")
    out["cand"] = f"""
        select blk, (lo + hi) / 2 as ld from c{levels + 1}
        union all select blk, ld from e0 where (id = 0 and slope < 1e-10) or (id = 100 and slope > -1e-10)"""
    out["atf"] = "select blk, row_number() over () as id, ld from cand"
    evaluate("f")
    out["best"] = "select *, q / df as vg, d * q / df as ve, 1 / (1 + d) as h2 from (select *, row_number() over (partition by blk order by ll desc) as rn from ef) where rn = 1"
    return out


_WHOLE = {
    "zz": "select a.i, b.i as j, sum(a.z * b.z) / (select max(i) from zr) as s from zr a join zr b using (iid) group by a.i, b.i",
    "zy": "select i, sum(z * y) as s from zr join phz using (iid) group by i",
    "blk": """
        select 0 as blk, (select list(r order by i) from (select i, list(s order by j) as r from zz group by i)) as g,
            (select list(s order by i) from zy) as b, (select sum(y * y) from phz) as yy, (select count(*) from phz)::double as n,
            (select count(*) - 1 from phz)::double as df""",
} | _reml_sql()
_REML_ROW = f"""
    select {_r('h2')} as h2, {_r('vg')} as vg, {_r('ve')} as ve, {_r('d', 4)} as delta, {_r('ll', 4)} as reml_ll,
        {_r('sqrt(2 / (n * (s2 / (n - 1) - pow(s1 / (n - 1), 2))))')} as h2_se, n
    from best, (select sum(case when i = j then s else 0 end) as s1, sum(s * s) as s2 from zz)"""


def _reml_row(report: DataFrame) -> DataFrame:
    return report.select(*(_rd(c).alias(c) for c in ("h2", "vg", "ve")), _rd("delta", 4).alias("delta"),
                         _rd("reml_ll", 4).alias("reml_ll"), _rd("h2_se").alias("h2_se"), "n")


@_register("reml_h2", _sql(_REML_ROW, "zr", "phz", extra=_WHOLE))
def _(spark, sf):
    return _reml_row(jobs.heritability(fx.pheno(spark, sf), geno=fx.geno(spark, sf), method="markers"))


@_register("h2_report", _sql(f"""
    select t.name, t.value from best, (select sum(case when i = j then s else 0 end) as s1, sum(s * s) as s2 from zz), lateral (values
        ('h2', {_r('h2')}), ('h2_se', {_r('sqrt(2 / (n * (s2 / (n - 1) - pow(s1 / (n - 1), 2))))')}), ('delta', {_r('d', 4)}), ('ve', {_r('ve')}),
        ('vg', {_r('vg')}), ('reml_ll', {_r('ll', 4)})) t(name, value)""", "zr", "phz", extra=_WHOLE))
def _(spark, sf):
    path = _place(spark, "h2")
    sinks.write_h2_report(jobs.heritability(fx.pheno(spark, sf), geno=fx.geno(spark, sf), method="markers"), path)
    parts = F.split("value", "=")
    value = parts[1].cast("double")
    digits = F.when(parts[0].isin("delta", "reml_ll"), F.round(value, 4)).otherwise(F.round(value, 6))
    return spark.read.text(path).select(parts[0].alias("name"), digits.alias("value"))


@_register("reml_from_kinship", _ORACLES["reml_h2"])
def _(spark, sf):
    return _reml_row(jobs.heritability(fx.pheno(spark, sf), grm=kinship.kinship_additive(_kept(spark, sf)[0], form="factors"), method="exact"))


@_register("reml_from_eigen", _ORACLES["reml_h2"])
def _(spark, sf):
    eig = materialise(reml.eigen_summary(kinship.kinship_additive(_kept(spark, sf)[0], form="factors"), _phz(spark, sf)))
    return _reml_row(jobs.heritability(fx.pheno(spark, sf), eig=eig))


@_register("reml_lanczos")
def _(spark, sf):
    return reml.reml_lanczos(_kept(spark, sf)[0], _phz(spark, sf))


# Half the upper tail of chi-square(1): the error function as a series of positive terms; beyond 100 nothing is left.
_LRT = f"""
    select {_r('ll', 4)} as reml_ll, {_r('null_ll', 4)} as null_ll, {_r('lrt', 4)} as lrt, {_r('p')} as p from (
        select *, case when lrt <= 0 then 0.5::double when lrt > 100 then 0 else 0.5::double * (1 - list_sum(list_transform(range(0, 400),
            lambda k: exp((2 * k + 1) * ln(sqrt(lrt / 2)) - lrt / 2 - lgamma(k + 1.5::double))))) end as p
        from (select *, -2 * (null_ll - ll) as lrt from (
            select *, 0.5::double * (-n * (ln(2 * pi()) + ln(yy / (n - 1))) - (n - 1)) as null_ll from best)))"""


@_register("reml_lrt", _sql(_LRT, "zr", "phz", extra=_WHOLE))
def _(spark, sf):
    tested = reml.likelihood_ratio(jobs.heritability(fx.pheno(spark, sf), geno=fx.geno(spark, sf), method="markers"))
    return tested.select(*(_rd(c, 4).alias(c) for c in ("reml_ll", "null_ll", "lrt")), _rd("p").alias("p"))


@_register("h2_se", _sql(f"""
    select {_r('sqrt(2 / (n * (ss / (n - 1) - pow(tr / (n - 1), 2))))')} as h2_se from (
        select (count(*) filter (where i = j))::double as n, sum(k) filter (where i = j) as tr,
            sum(case when i = j then k * k else 2 * k * k end) as ss from kin)""", "kin"))
def _(spark, sf):
    traces = kinship.trace_stats(kinship.kinship_additive(_kept(spark, sf)[0], form="factors"))
    return reml.h2_se_from_traces(traces).select(_rd("h2_se").alias("h2_se"))


@_register("region_windows", _sql("""
    select cast(b as int) as block, cast(8 * b as int) as start_idx, cast(least(8 * b + 16, p) as int) as end_idx,
        cast(idx as int) as idx, marker
    from (select marker, row_number() over (order by marker) - 1 as idx, count(*) over () as p from params),
        (select unnest(range(0, (select case when count(*) <= 16 then 1 else 1 + cast(ceil((count(*) - 16) / 8.0) as bigint) end
            from params))) as b)
    where idx >= 8 * b and idx < least(8 * b + 16, p)""", "params"))
def _(spark, sf):
    kept = materialise(qc.kept_markers(qc.qc_report(fx.geno(spark, sf))).select("marker"))
    return scan.region_windows(kept, 16, 8)


_SCAN = {
    "win": """
        select b as blk, marker, row_number() over (partition by b order by marker) as i, 8 * b as s, least(8 * b + 16, p) as e
        from (select marker, row_number() over (order by marker) - 1 as idx, count(*) over () as p from params),
            (select unnest(range(0, (select case when count(*) <= 16 then 1 else 1 + cast(ceil((count(*) - 16) / 8.0) as bigint) end
                from params))) as b)
        where idx >= 8 * b and idx < least(8 * b + 16, p)""",
    "wz": "select w.blk, w.i, z.iid, z.z from win w join z using (marker)",
    "zz": "select a.blk, a.i, b.i as j, sum(a.z * b.z) as s from wz a join wz b using (blk, iid) group by a.blk, a.i, b.i",
    "zy": "select blk, i, sum(z * y) as s from wz join pheno using (iid) group by blk, i",
    "blk": """
        select blk, g, b, (select var_pop(y) * count(*) from pheno) as yy, (select count(*) from pheno)::double as n,
            (select count(*) - 1 from pheno)::double as df
        from (select blk, list(r order by i) as g from (
                select blk, i, list(s / m order by j) as r from zz join (select blk, max(i) as m from win group by blk) using (blk) group by blk, i)
            group by blk) join (select blk, list(s order by i) as b from zy group by blk) using (blk)""",
} | _reml_sql()


@_register("scan_regions", _sql(f"""
    select cast(blk as int) as block, cast(max(w.s) as int) as start_idx, cast(max(w.e) as int) as end_idx, {_r('max(d)', 3)} as delta,
        {_r('max(h2)')} as h2, {_r('max(vg)')} as vg, {_r('max(ll)', 4)} as reml_ll,
        {_r('max(2 * (ll + 0.5::double * (n * (ln(2 * pi()) + ln(yy / (n - 1))) + (n - 1))))', 4)} as lrt
    from best join win w using (blk) group by blk""", "params", "z", "pheno", extra=_SCAN))
def _(spark, sf):
    rows = reml.likelihood_ratio(scan.scan_regions(fx.geno(spark, sf), fx.pheno(spark, sf), 16, 8))
    return rows.select("block", "start_idx", "end_idx", _rd("delta", 3).alias("delta"), _rd("h2").alias("h2"), _rd("vg").alias("vg"),
                       _rd("reml_ll", 4).alias("reml_ll"), _rd("lrt", 4).alias("lrt"))


# Markers and y after the intercept and two covariates (made orthogonal to each other) are taken out.
_SCAN_COV = {
    "cv0": "select iid, value - avg(value) over () as q0 from covs where cov = 0",
    "cv1": "select iid, value - avg(value) over () as q1 from covs where cov = 1",
    "cc": "select iid, q0, q1 - q0 * sum(q0 * q1) over () / sum(q0 * q0) over () as q1 from cv0 join cv1 using (iid)",
    "rz": """
        select iid, marker, z - q0 * sum(z * q0) over w / sum(q0 * q0) over w - q1 * sum(z * q1) over w / sum(q1 * q1) over w as z
        from z join cc using (iid) window w as (partition by marker)""",
    "ry": """
        select iid, y - avg(y) over () - q0 * sum(y * q0) over () / sum(q0 * q0) over () - q1 * sum(y * q1) over () / sum(q1 * q1) over () as y
        from pheno join cc using (iid)""",
    "win": _SCAN["win"],
    "wz": "select w.blk, w.i, z.iid, z.z from win w join rz z using (marker)",
    "zz": _SCAN["zz"],
    "zy": "select blk, i, sum(z * y) as s from wz join ry using (iid) group by blk, i",
    "blk": _SCAN["blk"].replace("(select var_pop(y) * count(*) from pheno)", "(select sum(y * y) from ry)").replace("count(*) - 1", "count(*) - 3"),
} | _reml_sql()


@_register("scan_regions_covariates", _sql(f"""
    select cast(blk as int) as block, {_r('d', 3)} as delta, {_r('h2')} as h2, {_r('vg')} as vg, {_r('ll', 4)} as reml_ll,
        {_r('2 * (ll + 0.5::double * (n * (ln(2 * pi()) + ln(yy / (n - 3))) + (n - 3)))', 4)} as lrt from best""",
                                           "params", "z", "pheno", "covs", extra=_SCAN_COV))
def _(spark, sf):
    rows = reml.likelihood_ratio(scan.scan_regions(fx.geno(spark, sf), fx.pheno(spark, sf), 16, 8, fx.covariates(spark, sf)))
    return rows.select("block", _rd("delta", 3).alias("delta"), _rd("h2").alias("h2"), _rd("vg").alias("vg"), _rd("reml_ll", 4).alias("reml_ll"),
                       _rd("lrt", 4).alias("lrt"))


@_register("scan_from_bed", _ORACLES["scan_regions_covariates"])
def _(spark, sf):
    _n, stored, report, _params = _study(spark, sf)
    rows = reml.likelihood_ratio(scan.scan_tiles(stored, fx.pheno(spark, sf), 16, 8, fx.covariates(spark, sf), report))
    return rows.select("block", _rd("delta", 3).alias("delta"), _rd("h2").alias("h2"), _rd("vg").alias("vg"), _rd("reml_ll", 4).alias("reml_ll"),
                       _rd("lrt", 4).alias("lrt"))


# All kept markers together, with the intercept and both covariates as fixed effects.
_WHOLE_COV = {
    **{k: _SCAN_COV[k] for k in ("cv0", "cv1", "cc", "rz")},
    "ry": _SCAN_COV["ry"].replace("from pheno", "from phz"),
    "rzi": "select iid, z, dense_rank() over (order by marker) as i from rz",
    "zz": "select a.i, b.i as j, sum(a.z * b.z) / (select max(i) from rzi) as s from rzi a join rzi b using (iid) group by a.i, b.i",
    "zy": "select i, sum(z * y) as s from rzi join ry using (iid) group by i",
    "blk": _WHOLE["blk"].replace("(select sum(y * y) from phz)", "(select sum(y * y) from ry)").replace("count(*) - 1", "count(*) - 3"),
} | _reml_sql()


@_register("reml_covariates", _sql(_REML_ROW.replace("n - 1", "n - 3"), "z", "phz", "covs", extra=_WHOLE_COV))
def _(spark, sf):
    return _reml_row(jobs.heritability(fx.pheno(spark, sf), geno=fx.geno(spark, sf), method="markers", covariates=fx.covariates(spark, sf)))


# ---------------------------------------------------------------------------------------------
# Ridge and scores.

def _ridge_sql(scale: str, delta: str, z: str = "zr", y: str = "phz") -> dict[str, str]:
    """The ridge system of z-scored markers with a scale per marker, solved in SQL."""
    return {
        "sc": f"select distinct zr.i, zr.marker, {scale} as d from {z} zr left join effect e on e.marker = zr.marker "
              "left join member m on m.marker = zr.marker left join rdelta r on r.region_id = m.region_id",
        "zz": f"select a.i, b.i as j, sum(a.z * b.z) as s from {z} a join {z} b using (iid) group by a.i, b.i",
        "zy": f"select i, sum(z * y) as s from {z} join {y} using (iid) group by i",
        "aug": f"""
            select list(row order by i) as a from (
                select x.i, list_append(list(x.s * si.d * sj.d + case when x.i = x.j then {delta} else 0 end order by x.j),
                    max(y.s * si.d)) as row
                from zz x join zy y on y.i = x.i join sc si on si.i = x.i join sc sj on sj.i = x.j group by x.i)""",
        **_GAUSS,
        "beta": "select sc.marker, sc.d * g.a[p.i][len(g.a) + 1] as beta from gj_done g, pos p join sc on sc.i = p.i",
    }


_RIDGE_NEEDS = ("zr", "phz", "effect", "member", "rdelta")
_BETA = f"select marker, {_r('beta')} as beta from beta"


@_register("ridge", _sql(_BETA, *_RIDGE_NEEDS, extra=_ridge_sql("1.0::double", "100.0::double")))
def _(spark, sf):
    return ridge.ridge(_kept(spark, sf)[0], _phz(spark, sf), 100.0).select("marker", _rd("beta").alias("beta"))


@_register("ridge_dual", _sql(_BETA, *_RIDGE_NEEDS, extra=_ridge_sql("1.0::double", "100.0::double")))
def _(spark, sf):
    return ridge.ridge_dual(_kept(spark, sf)[0], _phz(spark, sf), 100.0).select("marker", _rd("beta").alias("beta"))


@_register("ridge_cg", _sql(_BETA, *_RIDGE_NEEDS, extra=_ridge_sql("1.0::double", "500.0::double")))
def _(spark, sf):
    return ridge.ridge_cg(_kept(spark, sf)[0], _phz(spark, sf), 500.0, 1e-9).select("marker", _rd("beta").alias("beta"))


@_register("ridge_partial_pheno", _sql(f"select way, marker, {_r('beta')} as beta from beta, (select unnest(['direct', 'dual', 'gradients']) as way)",
                                       "kept", "pheno", "effect", "member", "rdelta", extra={
    "some_y": "select iid, y from pheno where iid % 3 <> 0",
    "some_z": """
        select iid, marker, (g - avg(g) over w) / case when stddev_pop(g) over w = 0 then 1 else stddev_pop(g) over w end as z,
            dense_rank() over (order by marker) as i
        from kept where iid in (select iid from some_y) window w as (partition by marker)""",
    "some_c": "select iid, y - avg(y) over () as y from some_y",
} | _ridge_sql("1.0::double", "100.0::double", "some_z", "some_c")))
def _(spark, sf):
    g, y = _kept(spark, sf)[0], fx.pheno(spark, sf).filter("iid % 3 <> 0")
    ways = {"direct": ridge.ridge, "dual": ridge.ridge_dual, "gradients": ridge.ridge_cg}
    parts = [f(g, y, 100.0).select(F.lit(way).alias("way"), "marker", _rd("beta").alias("beta")) for way, f in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_register("ridge_hetero", _sql(_BETA, *_RIDGE_NEEDS, extra=_ridge_sql("abs(e.beta) / sqrt(0.6::double)", "1.5::double")))
def _(spark, sf):
    return ridge.ridge_hetero(_kept(spark, sf)[0], _phz(spark, sf), fx.effect(spark, sf), 0.4, "direct").select(
        "marker", _rd("beta").alias("beta"))


@_register("ridge_region_lambda", _sql(_BETA, *_RIDGE_NEEDS, extra=_ridge_sql("1 / sqrt(r.delta)", "1.0::double")))
def _(spark, sf):
    lam = transform.region_lambda(fx.region_member(spark, sf), fx.region_delta(spark, sf)).select("marker", "lambda")
    return ridge.ridge_by_lambda(_kept(spark, sf)[0], _phz(spark, sf), lam, "direct").select("marker", _rd("beta").alias("beta"))


@_register("ridge_obs_weighted", _sql(_BETA, *_RIDGE_NEEDS, extra=_ridge_sql("1.0::double", "10.0::double") | {
    "zz": "select a.i, b.i as j, sum(a.z * b.z * (1 + a.iid % 3)) as s from zr a join zr b using (iid) group by a.i, b.i",
    "zy": "select i, sum(z * y * (1 + iid % 3)) as s from zr join phz using (iid) group by i"}))
def _(spark, sf):
    y = _phz(spark, sf)
    w = y.selectExpr("iid", "double(1 + iid % 3) as w")
    return ridge.ridge_observation_weighted(_kept(spark, sf)[0], y, w, 10.0).select("marker", _rd("beta").alias("beta"))


_TRAIN = {
    "tr_sums": """
        select marker, count(*)::double as n, sum(case when dosage = -1 then 1 else 0 end)::double as nm,
            sum(greatest(dosage, 0))::double as s1, sum(greatest(dosage, 0) * greatest(dosage, 0))::double as s2
        from geno where iid % 5 <> 0 group by marker""",
    "tr_kept": """
        select marker, s1 / n as mean, sqrt((n * s2 - s1 * s1) / (n * n)) as sd from tr_sums
        where nm / n < 1 - 0.95::double and s1 / (2 * n) >= 0.01::double and (n * s2 - s1 * s1) / (n * n) >= 0.02::double""",
    "tr_z": """
        select o.iid, o.marker, (o.g - k.mean) / k.sd as z, dense_rank() over (order by o.marker) as i
        from obs o join tr_kept k using (marker) where o.iid % 5 <> 0""",
    "tr_y": "select iid, (y - avg(y) over ()) / stddev_pop(y) over () as y from pheno where iid % 5 <> 0",
}
_TRAIN_NEEDS = ("geno", "obs", "pheno", "effect", "member", "rdelta")


@_register("region_shrinkage", _sql(_BETA, *_RIDGE_NEEDS, extra={
    "zsome": """
        select iid, marker, z, dense_rank() over (order by marker) as i from z
        where marker in (select marker from member join rdelta using (region_id) where delta < exp(10::double))""",
} | _ridge_sql("1 / sqrt(r.delta)", "1.0::double", "zsome")))
def _(spark, sf):
    named = fx.marker(spark, sf).withColumn("rsid", F.expr("concat('rs', 1000 + marker)"))
    effects = jobs.region_shrinkage(fx.geno(spark, sf), fx.pheno(spark, sf), named, fx.region_member(spark, sf),
                                    fx.region_delta(spark, sf), "direct")[0]
    return effects.select("marker", _rd("beta").alias("beta"))


@_register("ridge_blup", _sql(f"""
    select iid, {_r('sum((g - m) / s * beta)')} as yhat from (
        select o.iid, o.marker, o.g, avg(o.g) over w as m,
            case when stddev_pop(o.g) over w = 0 then 1 else stddev_pop(o.g) over w end as s
        from obs o where o.iid % 5 = 0 window w as (partition by o.marker)) join beta using (marker) group by iid""",
                              *_TRAIN_NEEDS, extra=_TRAIN | _ridge_sql("1.0::double", "(0.6::double / 0.4::double)", "tr_z", "tr_y")))
def _(spark, sf):
    g, y = fx.geno(spark, sf), fx.pheno(spark, sf)
    return jobs.ridge_blup(_train(g), _train(y), _valid(g), 0.4, method="individuals")[0].select("iid", _rd("yhat").alias("yhat"))


@_register("effects_job", _sql(f"""
    select o.iid, {_r('sum((o.g - k.mean) / k.sd * b.beta)')} as yhat
    from obs o join tr_kept k using (marker) join beta b using (marker) where o.iid % 5 = 0 group by o.iid""",
                               *_TRAIN_NEEDS, extra=_TRAIN | _ridge_sql("1.0::double", "0.0::double", "tr_z", "tr_y")))
def _(spark, sf):
    g, y = fx.geno(spark, sf), fx.pheno(spark, sf)
    out = jobs.effects_job(_train(g), _train(y), fx.marker(spark, sf), valid=_valid(g))["predictions"]
    return out.select("iid", _rd("yhat").alias("yhat"))


@_register("prs", _sql(f"select z.iid, {_r('sum(z.z * e.beta)')} as yhat from z join effect e using (marker) group by z.iid", "z", "effect"))
def _(spark, sf):
    kept = _kept(spark, sf)[0]
    params = materialise(transform.scale_params(kept))
    return score.score_standardised(kept, fx.effect(spark, sf), params).select("iid", _rd("yhat").alias("yhat"))


def _scored(spark, sf):
    z, _ = transform.standardise(_kept(spark, sf)[0])
    return score.polygenic_score(z, fx.effect(spark, sf)).join(fx.pheno(spark, sf), "iid")


_SCORED = {"sc": "select z.iid, sum(z.z * e.beta) as yhat, max(p.y) as y from z join effect e using (marker) join pheno p using (iid) group by z.iid"}


@_register("r2", _sql(f"select {_r('pow(corr(y, yhat), 2)')} as r2 from sc", "z", "effect", "pheno", extra=_SCORED))
def _(spark, sf):
    return score.r2(_scored(spark, sf)).select(_rd("r2").alias("r2"))


@_register("batch_r2", _sql("select round(avg(r), 5) as r2 from (select pow(corr(y, yhat), 2) as r from sc group by iid % 4)",
                            "z", "effect", "pheno", extra=_SCORED))
def _(spark, sf):
    return score.batch_r2(_scored(spark, sf).withColumn("batch_id", F.col("iid") % 4))


@_register("neg_mae", _sql(f"select {_r('-avg(abs(yhat - y))')} as neg_mae from sc", "z", "effect", "pheno", extra=_SCORED))
def _(spark, sf):
    return score.neg_mae(_scored(spark, sf)).select(_rd("neg_mae").alias("neg_mae"))


_LOGIT = "1 / (1 + exp(-yhat))"


def _class_scores(spark, sf):
    p = 1 / (1 + F.exp(-F.col("yhat")))
    return _scored(spark, sf).select(F.array(1 - p, p).alias("yhat"), scalar.case_to_onehot(1 + (F.col("y") > 6).cast("int")).alias("y"))


@_register("accuracy", _sql(f"select {_r('avg(case when (yhat > 0) = (y > 6) then 1.0::double else 0 end)')} as accuracy from sc",
                            "z", "effect", "pheno", extra=_SCORED))
def _(spark, sf):
    return score.accuracy(_class_scores(spark, sf)).select(_rd("accuracy").alias("accuracy"))


@_register("relative_mae", _sql(f"select {_r(f'sum(abs(case when y > 6 then {_LOGIT} - 1 else -{_LOGIT} end))')} as relative_mae from sc",
                                "z", "effect", "pheno", extra=_SCORED))
def _(spark, sf):
    return score.relative_mae(_class_scores(spark, sf)).select(_rd("relative_mae").alias("relative_mae"))


# ---------------------------------------------------------------------------------------------
# Networks.

def _training(spark, sf, batch=0):
    kept = _kept(spark, sf)[0]
    z, params = transform.standardise(_train(kept))
    y = fx.pheno(spark, sf)
    names = [r.marker for r in params.select("marker").orderBy("marker").collect()]
    rows = nn.training_table(z, transform.standardise_pheno(_train(y)), names, batch, 1)
    held = materialise(nn.wide(transform.standardise_with(_valid(kept), params), names).join(
        transform.standardise_pheno(_valid(y)), "iid"))
    return rows, held, names


@_register("mlp_regression")
def _(spark, sf):
    g, y = fx.geno(spark, sf), fx.pheno(spark, sf)
    plan = nn.TrainingPlan(epochs=6, learn_rate=0.05, momentum=0.9, l2=0.01, eval_every=2)
    return jobs.neural_prediction(_train(g), _train(y), _valid(g), _valid(y), plan)["predictions"]


def _train_sql(epochs: int, rate: float, momentum: float, l2: float) -> dict[str, str]:
    """Full-batch gradient steps of a network with one sigmoid layer, epoch by epoch."""
    out = {
        "tz": "select k.iid, k.marker, (k.g - p.mean) / p.sd as z from kept k join tr_params p using (marker)",
        "ty": "select iid, (y - avg(y) over ()) / stddev_pop(y) over () as y, count(*) over () as n from pheno where iid % 5 <> 0",
        "wa0": "select i as marker, j as h, w, 0.0::double as v from lw where layer = 0 and i in (select marker from params)",
        "ba0": "select distinct h, 0.0::double as b, 0.0::double as v from wa0",
        "wb0": "select i as h, w, 0.0::double as v from lw where layer = 1",
        "bb0": "select 0.0::double as b, 0.0::double as v",
    }
    new = lambda w, g: f"{w} - {rate}::double * ({momentum}::double * v + {g}) as {w}, {momentum}::double * v + {g} as v"
    for e in range(1, epochs + 1):
        o = e - 1
        out |= {
            f"s{e}": f"select z.iid, w.h, sum(z.z * w.w) + max(b.b) as s from tz z join wa{o} w using (marker) join ba{o} b using (h) where z.iid % 5 <> 0 group by z.iid, w.h",
            f"r{e}": f"""select iid, 2 * (sum(w.w / (1 + exp(-s.s))) + (select b from bb{o}) - max(y)) / max(n) as r
                from s{e} s join wb{o} w using (h) join ty using (iid) group by iid""",
            f"d{e}": f"select s.iid, s.h, r * w.w / (1 + exp(-s.s)) * (1 - 1 / (1 + exp(-s.s))) as d from s{e} s join r{e} using (iid) join wb{o} w using (h)",
            f"ga{e}": f"select z.marker, d.h, sum(z.z * d.d) as g from tz z join d{e} d using (iid) group by z.marker, d.h",
            f"wa{e}": f"select marker, h, {new('w', f'(g + {l2}::double * w)')} from wa{o} join ga{e} using (marker, h)",
            f"ba{e}": f"select h, {new('b', 'g')} from ba{o} join (select h, sum(d) as g from d{e} group by h) using (h)",
            f"wb{e}": f"select h, {new('w', 'g')} from wb{o} join (select h, sum(r / (1 + exp(-s))) as g from s{e} join r{e} using (iid) group by h) using (h)",
            f"bb{e}": f"select {new('b', 'g')} from bb{o}, (select sum(r) as g from r{e})",
        }
    out["sv"] = f"select z.iid, w.h, sum(z.z * w.w) + max(b.b) as s from tz z join wa{epochs} w using (marker) join ba{epochs} b using (h) where z.iid % 5 = 0 group by z.iid, w.h"
    out["yv"] = f"select iid, sum(w.w / (1 + exp(-s.s))) + (select b from bb{epochs}) as yhat from sv s join wb{epochs} w using (h) group by iid"
    return out


@_register("mlp_training", _sql(f"select iid, {_r('yhat')} as yhat from yv", "kept", "tr_params", "pheno", "lw", "params",
                                extra=_train_sql(3, 0.05, 0.9, 0.01)))
def _(spark, sf):
    rows, held, names = _training(spark, sf)
    start = fx.layer_weight(spark, sf).filter((F.col("layer") > 0) | F.col("i").isin(names))
    plan = nn.TrainingPlan(epochs=3, learn_rate=0.05, momentum=0.9, l2=0.01)
    trained = nn.train(rows, nn.load_network(start), plan)
    return nn.predict(held, trained.network).select("iid", _rd("yhat").alias("yhat"))


@_register("training_curve")
def _(spark, sf):
    from locusframe.sources.sinks import training_curve
    rows, held, names = _training(spark, sf, batch=200)
    trained = nn.train(rows, nn.init_network(names, [8]), nn.TrainingPlan(epochs=4, learn_rate=0.01, optimizer="adam", eval_every=2), held)
    return training_curve(nn.history_table(spark, trained))


@_register("train_until_best")
def _(spark, sf):
    rows, held, names = _training(spark, sf)
    plan = nn.TrainingPlan(epochs=5, learn_rate=0.2, momentum=0.9, eval_every=1)
    return nn.history_table(spark, nn.train_until_best(rows, nn.init_network(names, [8]), plan, held))


def _softmax_sql(epochs: int, rate: float, momentum: float, l2: float) -> dict[str, str]:
    """Full-batch steps on the cross-entropy of three classes with one sigmoid layer; weights of a class are those of ``lw``, some with
    the other sign."""
    new = lambda w, g: f"{w} - {rate}::double * ({momentum}::double * v + {g}) as {w}, {momentum}::double * v + {g} as v"
    sig = "(1 / (1 + exp(-s.s)))"
    out = {
        "tz": "select k.iid, k.marker, (k.g - p.mean) / p.sd as z from kept k join tr_params p using (marker)",
        "cy": """select iid, iid % 5 = 0 as held, case when d > 0.4 then 2 when d < -0.4 then 0 else 1 end as label from (
            select iid, (y - avg(y) over w) / stddev_pop(y) over w as d from pheno window w as (partition by iid % 5 = 0))""",
        "ty": "select iid, label, count(*) over () as n from cy where not held",
        "wa0": "select i as marker, j as h, w, 0.0::double as v from lw where layer = 0 and i in (select marker from params)",
        "ba0": "select distinct h, 0.0::double as b, 0.0::double as v from wa0",
        "wb0": "select i as h, o, case when (i + o) % 3 = 0 then -w else w end as w, 0.0::double as v from lw, (select unnest(range(3)) as o) where layer = 1",
        "bb0": "select o, 0.0::double as b, 0.0::double as v from (select unnest(range(3)) as o)",
    }

    def scores(e: int, o: int, where: str) -> dict[str, str]:
        return {
            f"s{e}": f"select z.iid, w.h, sum(z.z * w.w) + max(b.b) as s from tz z join wa{o} w using (marker) join ba{o} b using (h) where {where} group by z.iid, w.h",
            f"u{e}": f"select s.iid, w.o, sum(w.w * {sig}) + max(b.b) as u from s{e} s join wb{o} w using (h) join bb{o} b using (o) group by s.iid, w.o",
            f"p{e}": f"select iid, o, exp(u) / sum(exp(u)) over (partition by iid) as p from u{e}",
        }

    for e in range(1, epochs + 1):
        o = e - 1
        out |= scores(e, o, "z.iid % 5 <> 0") | {
            f"r{e}": f"select iid, o, (p - case when label = o then 1 else 0 end) / n as r from p{e} join ty using (iid)",
            f"d{e}": f"select s.iid, s.h, sum(r * w.w) * max({sig} * (1 - {sig})) as d from s{e} s join r{e} r using (iid) join wb{o} w using (h, o) group by s.iid, s.h",
            f"ga{e}": f"select z.marker, d.h, sum(z.z * d.d) as g from tz z join d{e} d using (iid) group by z.marker, d.h",
            f"wa{e}": f"select marker, h, {new('w', f'(g + {l2}::double * w)')} from wa{o} join ga{e} using (marker, h)",
            f"ba{e}": f"select h, {new('b', 'g')} from ba{o} join (select h, sum(d) as g from d{e} group by h) using (h)",
            f"wb{e}": f"select h, o, {new('w', 'g')} from wb{o} join (select s.h, r.o, sum(r.r * {sig}) as g from s{e} s join r{e} r using (iid) group by s.h, r.o) using (h, o)",
            f"bb{e}": f"select o, {new('b', 'g')} from bb{o} join (select o, sum(r) as g from r{e} group by o) using (o)",
        }
    out |= scores(epochs + 1, epochs, "z.iid % 5 = 0")
    out["pv"] = f"select * from p{epochs + 1}"
    return out


_SOFTMAX = ("kept", "tr_params", "pheno", "lw", "params")


def _classifier(spark, sf):
    """A softmax network of three classes after three steps, and the rows held out."""
    rows, held, names = _training(spark, sf)
    label = lambda t: t.withColumn("label", F.expr("case when y > 0.4 then 2 when y < -0.4 then 0 else 1 end")).drop("y")
    weights = fx.layer_weight(spark, sf).filter((F.col("layer") > 0) | F.col("i").isin(names))
    last = weights.filter("layer = 1").select("layer", "i", F.explode(F.array(*map(F.lit, range(3)))).alias("j"), "w")
    last = last.withColumn("w", F.when((F.col("i") + F.col("j")) % 3 == 0, -F.col("w")).otherwise(F.col("w")))
    start = nn.load_network(weights.filter("layer = 0").unionByName(last), loss="softmax")
    trained = nn.train(nn.class_rows(label(rows)), start, nn.TrainingPlan(epochs=3, learn_rate=0.5, momentum=0.9, l2=0.01))
    return label(held), trained.network


@_register("mlp_classifier", _sql(f"select iid, o::int as output, {_r('p')} as yhat from pv", *_SOFTMAX, extra=_softmax_sql(3, 0.5, 0.9, 0.01)))
def _(spark, sf):
    held, net = _classifier(spark, sf)
    return nn.predict(held, net).select("iid", "output", _rd("yhat").alias("yhat"))


@_register("mlp_class_report", _sql(f"""
    select label, sum(n)::bigint as n, sum(np)::bigint as n_predicted, {_r('sum(h) / nullif(sum(n), 0)')} as recall,
        {_r('sum(h) / nullif(sum(np), 0)')} as precision
    from (select label, 1 as n, 0 as np, if(label = best, 1, 0) as h from best union all select best, 0, 1, 0 from best) group by label""",
                                    *_SOFTMAX, extra=_softmax_sql(3, 0.5, 0.9, 0.01) | {
    "best": "select iid, label, arg_max(o, p)::int as best from pv join cy using (iid) group by iid, label"}))
def _(spark, sf):
    held, net = _classifier(spark, sf)
    report = nn.class_report(nn.confusion(held.withColumnRenamed("label", "y"), {0: net}))
    return report.select("label", "n", "n_predicted", _rd("recall").alias("recall"), _rd("precision").alias("precision"))


@_register("hyper_search")
def _(spark, sf):
    rows, held, names = _training(spark, sf)
    space = nn.SearchSpace((4, 16), (2, 5), (1, 3), (0.0, 0.3), (1e-3, 1e-1))
    return nn.hyper_search(rows, held, names, nn.TrainingPlan(momentum=0.9), space, trials=6, start_up=3)[0]


@_register("oversampled_training")
def _(spark, sf):
    g, y = fx.geno(spark, sf), fx.pheno(spark, sf)
    plan = nn.TrainingPlan(epochs=2, learn_rate=0.05, momentum=0.9, eval_every=1)
    cases = _train(y).filter("y > 9").select("iid")
    return jobs.neural_prediction(_train(g), _train(y), _valid(g), _valid(y), plan, cases=cases)["history"]


_ROWS_NET = f"select iid, {_r('sum(w.w / (1 + exp(-p.s)))')} as yhat from pre p join lw w on w.layer = 1 and w.i = p.h group by iid"


@_register("batch_predict", _sql(_ROWS_NET, "pre", "lw"))
def _(spark, sf):
    z, params = _zall(spark, sf)
    out = jobs.neural_inference(fx.geno(spark, sf), fx.layer_weight(spark, sf), params)
    return out.select("iid", _rd("yhat").alias("yhat"))


@_register("linear_predict", _sql(f"select iid, {_r('sum(w.w * p.s)')} as yhat from pre p join lw w on w.layer = 1 and w.i = p.h group by iid",
                                  "pre", "lw"))
def _(spark, sf):
    z, params = _zall(spark, sf)
    out = jobs.neural_inference(fx.geno(spark, sf), fx.layer_weight(spark, sf), params, linear=True)
    return out.select("iid", _rd("yhat").alias("yhat"))


@_register("linear_effects", _sql(f"""
    select a.i as marker, {_r('sum(a.w * b.w)')} as beta from lw a join lw b on b.layer = 1 and b.i = a.j where a.layer = 0 group by a.i""", "lw"))
def _(spark, sf):
    return nn.linear_effects(fx.layer_weight(spark, sf)).select("marker", _rd("beta").alias("beta"))


@_register("garson", _sql(f"""
    select a.i as marker, b.j as output, {_r('sum(abs(a.w) * abs(b.w))')} as importance
    from lw a join lw b on b.layer = 1 and b.i = a.j where a.layer = 0 group by a.i, b.j""", "lw"))
def _(spark, sf):
    return explain.garson_importance(fx.layer_weight(spark, sf)).select("marker", "output", _rd("importance").alias("importance"))


@_register("garson_activated", _sql(f"""
    select a.i as marker, b.j as output, {_r('sum(1 / (1 + exp(-a.w)) * abs(b.w))')} as importance
    from lw a join lw b on b.layer = 1 and b.i = a.j where a.layer = 0 group by a.i, b.j""", "lw"))
def _(spark, sf):
    return explain.garson_importance(fx.layer_weight(spark, sf), "sigmoid").select(
        "marker", "output", _rd("importance").alias("importance"))


_SETS = {"sets": """
    select a.i as m1, b.i as m2, c.i as m3, w.i as h, a.w + b.w + c.w as s, w.w
    from lw a join lw b on b.layer = 0 and b.j = a.j and b.i > a.i join lw c on c.layer = 0 and c.j = a.j and c.i > b.i
    join lw w on w.layer = 1 and w.i = a.j where a.layer = 0"""}


@_register("interaction_scan", _sql(f"select m1, m2, m3, {_r('abs(sum(w / (1 + exp(-s))))')} as strength from sets group by m1, m2, m3",
                                    "lw", extra=_SETS))
def _(spark, sf):
    scan_ = explain.interaction_scan(spark, _net(spark, sf), 3)
    return scan_.select(*(F.col("markers")[k].alias(f"m{k + 1}") for k in range(3)), _rd("strength").alias("strength"))


_TOP_SETS = _sql(f"""
    select m1, m2, m3, {_r('st')} as strength from (
        select m1, m2, m3, abs(sum(w / (1 + exp(-s)))) as st from sets group by m1, m2, m3)
    order by round(st, 9) desc, m1, m2, m3 limit 25""", "lw", extra=_SETS)


@_register("top_interactions", _TOP_SETS)
def _(spark, sf):
    top = explain.top_interactions(spark, _net(spark, sf), 25, 3, digits=9)
    return top.select(*(F.col("markers")[k].alias(f"m{k + 1}") for k in range(3)), _rd("strength").alias("strength"))


@_register("rank_interactions", _TOP_SETS)
def _(spark, sf):
    scan_ = explain.interaction_scan(spark, _net(spark, sf), 3).withColumn("strength", F.round("strength", 9))
    return explain.strongest_interactions(scan_, 25).select(
        *(F.col("markers")[k].alias(f"m{k + 1}") for k in range(3)), _rd("strength").alias("strength"))


@_register("saliency", _sql(f"""
    select marker, {_r('avg(abs(g))')} as saliency from (
        select p.iid, a.i as marker, sum(greatest(b.w, 0) * a.w / (1 + exp(-p.s)) * (1 - 1 / (1 + exp(-p.s)))) as g
        from pre p join lw b on b.layer = 1 and b.i = p.h join lw a on a.layer = 0 and a.j = p.h group by p.iid, a.i)
    group by marker""", "pre", "lw"))
def _(spark, sf):
    z, _ = _zall(spark, sf)
    net = _net(spark, sf)
    return explain.mean_saliency(explain.saliency(nn.wide(z, net.markers), net)).select("marker", _rd("saliency").alias("saliency"))


# Noise is drawn by (seed, individual, sample * 64 + input), the same on both sides.
@_register("smoothgrad", _sql(f"""
    select marker, {_r('avg(g)')} as saliency from (
        select p.iid, a.i as marker, p.sample, abs(sum(greatest(b.w, 0) * a.w / (1 + exp(-p.s)) * (1 - 1 / (1 + exp(-p.s))))) as g
        from noisy p join lw b on b.layer = 1 and b.i = p.h join lw a on a.layer = 0 and a.j = p.h group by p.iid, a.i, p.sample)
    group by marker""", "pre", "lw", "zall", extra={
    "wide": "select iid, 0.15::double * (max(z) - min(z)) as wide, count(*) as p from zall group by iid",
    "place": "select iid, wide, sample, k, sample * p + k as spot from wide, (select unnest(range(8)) as sample), (select unnest(range(64)) as k) where k < p",
    "noise": f"""
        select iid, sample, k, wide * sqrt(-2 * ln({draws.uniform_sql(1, 'iid', '2 * spot')})) * cos(2 * pi() * {draws.uniform_sql(1, 'iid', '2 * spot + 1')}) as e
        from place""",
    "noisy": """
        select p.iid, n.sample, p.h, max(p.s) + sum(n.e * w.w) as s from pre p join noise n on n.iid = p.iid
        join lw w on w.layer = 0 and w.i = n.k and w.j = p.h group by p.iid, n.sample, p.h"""}))
def _(spark, sf):
    z, _ = _zall(spark, sf)
    net = _net(spark, sf)
    smooth = explain.mean_saliency(explain.smoothgrad(nn.wide(z, net.markers), net, samples=8))
    return smooth.select("marker", _rd("saliency").alias("saliency"))


@_register("activation_map", _sql(f"""
    select set_id, neuron, {_r('abs(1 / (1 + exp(-s)))')} as activation from (
        select m.region_id as set_id, w.j as neuron, sum(w.w) as s from member m join lw w on w.layer = 0 and w.i = m.marker group by 1, 2
        union all
        select -1::bigint, w.j, sum(w.w) from member m join lw w on w.layer = 0 and w.i = m.marker group by 1, 2)""", "member", "lw"))
def _(spark, sf):
    sets = fx.region_member(spark, sf).groupBy(F.col("region_id").alias("set_id")).agg(F.collect_list("marker").alias("markers"))
    return explain.activation_map(sets, _net(spark, sf), 0).select("set_id", "neuron", _rd("activation").alias("activation"))


# ---------------------------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    """Which markers pass QC and are associated with the phenotype."""
    sf = "/root/testdata/sf0.001"
    return jobs.association(fx.geno(spark, sf), fx.pheno(spark, sf))


def _llm() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the training-data operators; none where those modules are absent."""
    found, sql = {}, {}
    try:
        from locusframe.llm import queries as llm
    except ModuleNotFoundError as e:
        if e.name not in ("locusframe.llm", "locusframe.llm.queries"):
            raise
        return found, sql
    found, sql = dict(llm.QUERIES), dict(llm.ORACLES)
    try:
        import corpus_pipeline
    except ModuleNotFoundError as e:
        if e.name != "corpus_pipeline":
            raise
    else:
        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Query]:
    return _QUERIES | _llm()[0]


def oracle_sql() -> dict[str, str]:
    return _ORACLES | _llm()[1]
