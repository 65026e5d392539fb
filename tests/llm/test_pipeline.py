import corpus_pipeline
from rangeloom.llm import jaccard_join, packing, registry, secrets

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        kept = corpus_pipeline.written(kept, "test")
        counts.append(kept.count())
        docs = kept
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    assert all(r["doc_id"] == r["component_id"] for r in jaccard_join.near_duplicates(docs).collect())
    model = secrets.train(secrets.labelled_samples(docs, spark))
    assert secrets.scan(docs, model).where("size(filter(spans, s -> s.kind != 'random')) > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())


def test_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shape = "doc_id long, text string, lang string, source string, n_chars long, class string, h long"
    rows = [(1, None, None, None, None, "c", 1), (2, "", "en", "s", 0, None, 2), (3, "a b c", "en", "s", 5, "c", None), (3, "a b c", "en", "s", 5, "c", None),
            (4, "A b  c", "en", "s", 6, "c", 3), (None, "password=abcdefgh1", "en", "s", 18, "c", 3), (5, "word " * 30_000, "en", "s", 1, "c", 1)]
    docs = spark.createDataFrame(rows, shape)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test")
    left = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(left, key=str) == [1, 2, 3, 5, None] and docs.count() == 5
    assert left[None]["text"] == "[assign]" and left[None]["n_chars"] == 8 and left[1]["text"] is None
    assert packing.pack(docs, registry.tokenizer_path("word_bpe_49k.json")).count() > 5
    empty = spark.createDataFrame([], shape)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
