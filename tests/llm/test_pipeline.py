import hashlib

import corpus_pipeline
import duckdb
import public_tokenizers
from test_simhash import brute_components, brute_print
from tokenizers import Tokenizer

from llm_cases import odd_docs, records  # noqa: F401
from locusframe.llm import quality_mil, queries, toxicity_mil

MID = "/root/testdata/sf0.01"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(doc_id, text):
    ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(TOKENIZER.decode(ids, skip_special_tokens=False))


def test_run_equals_brute_force(spark, tmp_path):
    """Filters by the same models row by row, groups by comparing all pairs, the mix in SQL, and the tokenizers library."""
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.toPandas()
    model = toxicity_mil.train(docs, labels)
    risk, owner = toxicity_mil._sentence_risks(model.weights, model.bias, rows.text.tolist())
    toxic = {i: 0.0 for i in range(len(rows))}
    for r, o in zip(risk, owner):
        toxic[int(o)] += r
    rows = rows[[toxic[i] < 0.6931471805599453 for i in range(len(rows))]]
    tame = spark.createDataFrame(rows, docs.schema)
    rows = rows[quality_mil.score_texts(quality_mil.train(tame, labels), rows.text.tolist()) >= 0.3]
    groups = brute_components(rows.doc_id.tolist(), [brute_print(t) for t in rows.text])
    rows = rows[rows.doc_id == groups]
    con = duckdb.connect()
    con.register("documents", rows)
    picked = con.execute(queries.ORACLES["op1_mixing"]).fetchall()
    text = dict(zip(rows.doc_id, rows.text))
    want = sorted((encoded(p[0], text[p[0]]) for p in picked), key=repr)
    got = records(corpus_pipeline.run(spark, MID), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == want and 0 < len({p[0] for p in picked}) <= len(rows) < docs.count()


def test_stages_on_odd_documents(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, MID)
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.where("false"), MID).count() == 0
        if name == "near_duplicates":
            ids = [r.doc_id for r in kept.collect()]
            own = [i for i in ids if i is not None]
            assert len(own) == len(set(own)) and ids.count(None) == 2 and 0 in own and 6 not in own and 11 not in own
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, MID).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
