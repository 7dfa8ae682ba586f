import corpus_pipeline
from tidemark.llm import quality_model, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = corpus_pipeline.materialize(stage(spark, before, sf), "stage")
        assert after.columns == COLUMNS
        assert 0 < after.count() < before.count()
        before = after
    kept = {r.doc_id for r in before.select("doc_id").collect()}
    assert len(kept) == before.count()
    bad = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in kept for i in bad) < 0.1 * len(bad)
    packed = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert packed == kept


def test_awkward_and_empty_documents(spark, tmp_path):
    """Clashing and odd column names keep their values; without labels nothing is rejected."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "quite another text"), (None, "x y")]
    names = "doc_id long, text string, lang string, source string, n_chars long, Score double, predicted int, print_0 string, n long, `a.b` int"
    for data in (rows, []):
        docs = spark.createDataFrame([(i, t, None, None, None, -7.0, 9, "p", 5, k) for k, (i, t) in enumerate(data)], names)
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns
        got = sorted((r.doc_id or 0, r.text or "", r["a.b"]) for r in docs.collect())
        assert got == ([(0, "x y", 6), (1, "", 0), (2, "", 1), (3, "a b c d e f", 2), (4, "quite another text", 5)] if data else [])
        assert all((r.Score, r.predicted, r.print_0, r.n) == (-7.0, 9, "p", 5) for r in docs.collect())
        assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == (5 if data else 0)


def test_scores_beside_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a b", 3.0, 4)], "doc_id long, text string, Score double, `a.b` int")
    model = {"idx": [], "w": [], "b": 0.0}
    assert toxicity.score(docs, model).columns == ["doc_id", "text", "a.b", "score", "predicted"]
    assert quality_model.score(docs, None, "doc_id").collect() == [(1, 0.5, 1)]
