import corpus_pipeline
from strataprof.llm.common import cut


def test_stages_on_a_small_corpus(spark, tmp_path):
    prose = "the river runs down to the sea and the people of the town walk along its banks every day of the year with their children number"
    item = "seven tall green ships sailed past the silent harbour while nobody on the shore noticed their quiet passing"
    rows = [(i, f"{prose} {' '.join(chr(97 + (i * k) % 26) * 3 + str(i) for k in range(1, 30))}", "en", "s", 0) for i in range(20)]
    rows += [(30, rows[0][1] + " x", "en", "s", 0), (31, f"{rows[5][1][40:]} {item}", "en", "s", 0), (32, "1234 5678", "en", "s", 0), (33, None, None, "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert seen[0] == set(range(20)) | {30, 31}
    assert seen[1] == seen[0] and 30 not in seen[2] and 31 in seen[2] and seen[3] == seen[2] - {31}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[3])


def test_odd_documents(spark, tmp_path):
    """Empty tables, repeated ids and columns beside those of documents."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _id string"
    prose = "the river runs down to the sea and the people of the town walk along its banks every day number"
    rows = [(i, f"{prose} {i}", "en", "s", 0, 0.5, "x") for i in range(12)] + [(3, f"{prose} 3", "en", "s", 0, 0.5, "x"), (None, f"{prose} and the sea", None, None, None, None, None)]
    for name, kept in (("some", rows), ("none", [])):
        at = tmp_path / name
        spark.createDataFrame(kept, schema).write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(at))
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert {r["doc_id"] for r in got.collect()} == ({0, None} if kept else set())


def test_tables_are_dropped(spark):
    from strataprof.llm import common

    df = cut(spark.range(3), "some")
    path = common._written[-1].removeprefix("file://")
    import os

    assert os.path.isdir(path) and df.count() == 3
    assert common.drop_tables(spark) >= 1 and not os.path.isdir(path)
