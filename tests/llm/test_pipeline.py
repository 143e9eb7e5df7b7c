import corpus_pipeline
from palimpsa.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_pass_documents_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert names[0] in out.columns and len(corpus_pipeline.STAGES) == 5
    rows = out.collect()
    assert 0.5 * before < len(rows) < before and all(r.restored for r in rows)
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids))


def test_tokens_run_one_python_step_at_a_time(spark):
    """Two in one plan are two Python workers a task."""
    rows = [(1, "en", "web", "Some words. 12 more"), (2, None, None, None), (2, "de", "web", ""), (None, "de", "web", "wörtlich\n")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    out = corpus_pipeline.tokens(spark, docs, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    found = sorted(((r.doc_id, r.lang, r.n_pieces, r.restored) for r in out.collect()), key=str)
    sizes = {r.text: len(r.pieces) for r in corpus_pipeline.pieces.encode(docs, corpus_pipeline.pieces.load_model(corpus_pipeline.MODEL_FILE)).collect() if r.pieces is not None}
    assert found == sorted(((k, lang, sizes.get(t, None if t is None else 0), True) for k, lang, _, t in rows), key=str)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
