"""Mixing sources to target weights: token budgets for a domain-language-source tree, and the prefix each leaf contributes.

Budgets run from the root to the leaves. A node's budget is shared among its children by weight; a child that can't supply its
share (its tokens times the number of epochs allowed) gives what it has, and its siblings take over the rest by weight.
As every child counts with the capacity of its whole subtree, a shortage is made good by siblings first, and by the
siblings of an ancestor only when those are exhausted. All shares are whole tokens, and children add up to their parent.

A leaf's budget is filled with whole passes over its documents, then with the prefix of one more pass. Each epoch orders
the documents by a seeded hash; the document at which the budget ends contributes its first tokens only. A leaf may hold
most of all documents, so no leaf is sorted as a whole: the order's leading digits cut it into runs of bounded size, sums per
run tell which run the budget ends in, and only that run is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import materialise

LEVELS = ("domain", "lang", "source")
# Documents per run of a leaf's order, on average.
RUN_DOCS = 4096
# What separates words when tokens are counted.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Words of a text, the default measure of its tokens; null has none.

    Every word becomes one letter and separators go, so that what is left is as long as there are words: a list of all words of a
    text, as ``regexp_count`` makes it, takes many times the text's memory.
    """
    letters = F.translate(F.regexp_replace(text, F.lit(WORD), F.lit("x")), SEPARATORS, "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def _share_out(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Give each node (``weight, capacity``, parent's ``parent_budget``) its whole tokens, ``budget``.

    Children in order of capacity per weight: those that the common level exceeds are filled to their capacity, the
    others share the rest by weight, rounded so that running sums are right.
    """
    by_need = Window.partitionBy(*parents).orderBy((F.col("capacity") / F.col("weight")).asc_nulls_last(), "_name")
    upto = by_need.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*parents)
    ranked = (nodes.withColumn("_cap", F.sum("capacity").over(upto)).withColumn("_w", F.sum("weight").over(upto))
              .withColumn("_all", F.sum("weight").over(whole)))
    # full if its capacity per weight is at most the level that the rest would reach
    left = F.col("parent_budget") - (F.col("_cap") - F.col("capacity"))
    full = F.col("capacity") * (F.col("_all") - F.col("_w") + F.col("weight")) <= left * F.col("weight")
    marked = ranked.withColumn("_full", full)
    spent = marked.withColumn("_spent", F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(whole)).withColumn(
        "_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(whole))
    run = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(upto)
    cut = spent.withColumn("_run", run)
    rest = "(parent_budget - _spent)"
    share = F.expr(f"{rest} * _run div _open - {rest} * (_run - weight) div _open")
    return cut.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(share)).drop(
        "_cap", "_w", "_all", "_full", "_spent", "_open", "_run", "_name")


def leaf_budgets(leaves: DataFrame, weights: dict[tuple[str, ...], int], total: int | None, epochs: int) -> DataFrame:
    """Budgets of the leaves ``domain, lang, source, tokens, docs``: adds ``budget``, whole tokens.

    ``weights`` maps a path ``(domain,)``, ``(domain, lang)`` or ``(domain, lang, source)`` to a whole number; a path that isn't named has weight 1, and
    weight 0 takes nothing. ``total`` is the number of tokens wanted; None: as many as the leaves have. More than ``epochs`` passes
    over everything give no more than that.
    """
    spark = leaves.sparkSession
    named = [("/".join(f"{len(p)}:{p}" for p in path), int(w)) for path, w in weights.items()]
    listed = spark.createDataFrame(named or [("", 1)], "_path string, _weight long")
    nodes = leaves.withColumn("capacity", F.col("tokens") * epochs)
    tree = []
    for depth in (3, 2, 1):
        keys = list(LEVELS[:depth])
        level = nodes.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        path = F.concat_ws("/", *(F.concat(F.length(k), F.lit(":"), F.col(k)) for k in keys))
        level = level.withColumn("_path", path).join(F.broadcast(listed), "_path", "left").withColumn(  # one row per given weight
            "weight", F.coalesce("_weight", F.lit(1).cast("long"))).drop("_path", "_weight")
        # what a weightless node or a node without weighted children has is out of reach
        level = level.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).where("weight > 0")
        tree.append(level)
        nodes = level.select(*keys, "capacity", "tokens")
    budgets = None
    for depth, level in enumerate(reversed(tree), 1):
        keys, up = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        if budgets is None:
            root = level.agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("c"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
            wanted = min(root.t if total is None else int(total), root.c)
            sized = level.withColumn("parent_budget", F.lit(int(wanted)).cast("long"))
        else:
            sized = level.join(budgets.withColumnRenamed("budget", "parent_budget"), up)
        budgets = _share_out(sized.withColumn("_name", F.col(keys[-1])), up).select(*keys, "budget")
    return leaves.join(budgets, list(LEVELS))


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch: the md5 of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, weights: dict[tuple[str, ...], int], domain: Column, total: int | None = None, epochs: int = 4, seed: int = 1,
        tokens: Column | None = None) -> DataFrame:
    """Every pick of a document: ``row`` (all columns of ``docs``), ``domain, epoch (from 0), tokens, take``.

    ``domain`` names the top level of the tree; null domains, languages and sources are the empty name. ``tokens`` counts a document's tokens
    (words by default). ``take`` is how many of its first tokens the pick contributes: all, or less for the last document of
    a leaf. Documents without tokens fill no budget and are never picked. Rows that repeat an id stand next to each other in an
    epoch's order; equal rows are interchangeable. Budgets times weights must stay below 2^63.
    """
    names = {"_domain": F.coalesce(domain, F.lit("")), "_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit(""))}
    keys = list(names)
    count = tokens if tokens is not None else word_count(F.col("text"))
    # columns of docs travel packed, so that none of them clashes with those below
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), count.alias("_tokens"),
                         *(c.alias(k) for k, c in names.items())).where("_tokens > 0")
    slim = materialise(packed.drop("_row"))
    leaves = slim.groupBy(*keys).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaves = leaves.select(*(F.col(k).alias(n) for k, n in zip(keys, LEVELS)), "tokens", "docs")
    plan = materialise(leaf_budgets(leaves, weights, total, epochs)).select(
        *(F.col(n).alias(k) for k, n in zip(keys, LEVELS)), F.expr("budget div tokens").alias("_full"), F.expr("budget % tokens").alias("_rest"),
        F.greatest(F.lit(1), F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.col("docs") / RUN_DOCS))).cast("int")).alias("_digits"))
    # the run in which the last, partial epoch of each leaf ends, and the tokens before it
    partial = slim.join(plan.where("_rest > 0"), keys).withColumn("_o", _order(seed, F.col("_full"), F.col("_id")))
    runs = partial.groupBy(*keys, F.expr("substring(_o, 1, _digits)").alias("_run"), "_rest").agg(F.sum("_tokens").alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (runs.withColumn("_before", F.sum("_sum").over(upto) - F.col("_sum")).where("_before < _rest and _before + _sum >= _rest")
            .select(*keys, F.col("_run").alias("_end_run"), "_before"))
    plan = materialise(plan.join(ends, keys, "left"))
    # picks: whole epochs and the runs before the last one, then the last run in its order
    rows = packed.join(plan, keys).withColumn("_o", _order(seed, F.col("_full"), F.col("_id")))
    rows = rows.withColumn("_at", F.expr("substring(_o, 1, _digits)"))
    shown = [F.col("_row").alias("row"), F.col("_domain").alias("domain"), F.col("_epoch").alias("epoch"), F.col("_tokens").alias("tokens")]
    whole = rows.withColumn("_n", F.expr("cast(_full as int) + int(coalesce(_at < _end_run, false))")).where("_n > 0")
    whole = whole.withColumn("_epoch", F.explode(F.expr("sequence(0, _n - 1)"))).select(*shown, F.col("_tokens").alias("take"))
    in_run = Window.partitionBy(*keys).orderBy("_o", "_id", "_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.where("_at = _end_run").withColumn("_start", F.sum("_tokens").over(in_run) - F.col("_tokens") + F.col("_before"))
    last = last.where("_start < _rest").withColumn("_epoch", F.col("_full").cast("int")).select(
        *shown, F.least("_tokens", F.col("_rest") - F.col("_start")).alias("take"))
    return whole.unionByName(last)
