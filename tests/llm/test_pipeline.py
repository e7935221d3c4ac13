"""The pipeline as a whole: clashing names, empty tables, the order of training."""

from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_names_clash_with_nothing_and_order_is_kept(spark, tmp_path):
    import corpus_pipeline as pipeline
    from quillspark.llm.mixing import mix, schedule

    names = ["_row", "_row_", "_again", "_at", "position", "score", "kept", "text_", "component_id"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 120")
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit("own "), F.col("doc_id")))
    columns = docs.columns
    docs.write.parquet(str(tmp_path / "given"))
    docs = spark.read.parquet(str(tmp_path / "given"))
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before, docs = docs, stage(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "byte-level bpe":
            assert docs.columns == columns
            for c in names:
                assert docs.filter(F.col(c) != F.concat(F.lit("own "), F.col("doc_id"))).count() == 0
        if name == "mixing sources":
            place = {}
            for r in schedule(mix(before)).collect():
                place.setdefault(r.doc_id, []).append(r.position)
    got = docs.orderBy("shard", "row").select("doc_id").collect()
    left = {i: sorted(ps) for i, ps in place.items()}
    at = [left[r.doc_id].pop(0) for r in got]
    assert at == sorted(at) and not any(left.values())


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 0
        docs = docs if name == "byte-level bpe" else out
