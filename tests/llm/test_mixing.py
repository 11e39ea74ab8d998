
import duckdb
import pytest

from pyspark.sql import functions as F

from llm_cases import odd_docs, records  # noqa: F401
from locusframe.llm import queries
from locusframe.llm.mixing import WORD, leaf_budgets, mix, word_count


def sql_rows(docs, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    docs.select("doc_id", "text", "lang", "source").write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    rows = con.execute(queries.ORACLES["op1_mixing"]).fetchall()
    return sorted((tuple("null" if v is None else v for v in r) for r in rows), key=repr)


def picks(docs):
    out = mix(docs, queries.MIX_WEIGHTS, queries.mix_domain(), epochs=queries.MIX_EPOCHS, seed=queries.MIX_SEED)
    return out.select("row.doc_id", "domain", "row.lang", "row.source", "epoch", F.col("tokens").alias("n"), F.col("take").alias("t"))


def test_odd_documents_equal_the_sql(odd_docs, tmp_path):
    assert records(picks(odd_docs)) == sql_rows(odd_docs, tmp_path)
    assert picks(odd_docs.where("false")).count() == 0
    assert mix(odd_docs, {}, queries.mix_domain()).select("row.*").columns == odd_docs.columns


def test_hot_leaf_equals_the_sql(spark, tmp_path):
    """One source holds most rows, over several runs of its order."""
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"),
        F.expr("if(id % 3 = 0, 'de', 'en')").alias("lang"), F.expr("if(id % 10 < 8, 'src2', concat('src', id % 13))").alias("source"))
    assert records(picks(docs)) == sql_rows(docs, tmp_path)


def budgets(spark, leaves, weights, total, epochs=1):
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long").withColumn("docs", F.lit(1).cast("long"))
    return {(r.domain, r.lang, r.source): r.budget for r in leaf_budgets(frame, weights, total, epochs).collect()}


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 1000)]
    got = budgets(spark, leaves, {}, 400)
    # a and b get 200 each, x and y 100 each; source 1 lacks 40, which its sibling makes good
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "3"): 100, ("b", "x", "4"): 200}
    short = [("a", "x", "1", 10), ("a", "x", "2", 20), ("a", "y", "3", 1000), ("b", "x", "4", 1000)]
    assert budgets(spark, short, {}, 400) == {("a", "x", "1"): 10, ("a", "x", "2"): 20, ("a", "y", "3"): 170, ("b", "x", "4"): 200}
    bare = [("a", "x", "1", 10), ("b", "x", "4", 1000)]
    assert budgets(spark, bare, {}, 400) == {("a", "x", "1"): 10, ("b", "x", "4"): 390}


def test_weights_epochs_and_whole_tokens(spark):
    leaves = [("a", "x", str(k), 100) for k in range(3)]
    assert sum(budgets(spark, leaves, {}, 100).values()) == 100
    assert budgets(spark, leaves, {("a", "x", "0"): 0}, 1000, epochs=2) == {("a", "x", "1"): 200, ("a", "x", "2"): 200}
    assert budgets(spark, leaves, {("a", "x", "0"): 2}, 200) == {("a", "x", "0"): 100, ("a", "x", "1"): 50, ("a", "x", "2"): 50}


@pytest.mark.parametrize("total", [0, 7, 20])
def test_a_total_is_met_to_the_token(spark, total):
    docs = spark.createDataFrame([(k, "a b c", "en", "s") for k in range(5)], "doc_id long, text string, lang string, source string")
    taken = mix(docs, {}, F.lit("d"), total=total, epochs=4).agg(F.sum("take")).first()[0]
    assert (taken or 0) == total


def test_words_are_counted_without_a_list_of_them(spark):
    """Pipeline of round 3: the list of a text's words took the executor's memory."""
    texts = [None, "", " \t\r\n\x0b\x0c", "a", " a  b\tc\n", "\u00a0 \U0001f600\u2003x $1 \\ x", "x\x00y \x1c", "w " * 30_000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = docs.select(word_count(F.col("text")).alias("n"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("want")).collect()
    assert [r.n for r in got] == [r.want for r in got] == [0, 0, 0, 1, 3, 5, 2, 30_000]
    assert "regexp_extract_all" not in (plan := docs.select(word_count(F.col("text")))._jdf.queryExecution().toString()) and "regexp_count" not in plan
