"""The pipeline as a whole, over tables with everything that a table may hold."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from traceforge.llm import langid, packing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture
def odd(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.filter("length(text) > 300").orderBy("doc_id").limit(1)
    base = docs.withColumns({"Score": F.lit(1), "lang_pred": F.lit("x"), "predicted": F.lit(None).cast("int"), "node": F.lit("n"), "piece": F.lit(3)})
    more = [first.withColumn("doc_id", F.lit(None).cast("long")), first.withColumn("doc_id", F.lit(None).cast("long")), first, first.withColumn("text", F.lit(None).cast("string")), first.withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.lit("")}), first.withColumns({"doc_id": F.lit(10**6 + 1).cast("long"), "text": F.concat("text", F.lit(" and "), F.repeat("text", 40)), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})]
    rows = base
    for m in more:
        rows = rows.unionByName(m, allowMissingColumns=True)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_over_an_odd_table(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    packed = corpus_pipeline.run(spark, odd).collect()
    # stage by stage: each on what the one before kept, all columns kept
    kept = docs
    model = quality.train(docs, spark.read.parquet(f"{odd}/labels.parquet"))
    good = {(r.doc_id, r.text) for r in quality.score(docs.select("doc_id", "text"), model, corpus_pipeline.QUALITY_THRESHOLD).filter("predicted = 1").collect()}
    tell = langid.train(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, odd)
        assert kept.columns == docs.columns, name
        rows, old = kept.collect(), {(r.doc_id, r.text) for r in before.collect()}
        assert rows and {(r.doc_id, r.text) for r in rows} <= old, name
        if name == "quality classifier":
            assert {(r.doc_id, r.text) for r in rows} == good
        if name == "language ID":
            assert {(r.doc_id, r.text) for r in rows} == {k for k in old if (p := tell.predict(k[1]))[0] != "und" and p[1] >= corpus_pipeline.LANGUAGE_SCORE}
        if name == "MinHash near-dedup":
            texts = [r.text for r in rows]
            assert len(set(texts)) == len(texts)  # of equal texts one row stays, null ids or repeated ids or not
            assert {t for _, t in old if t} >= set(texts)
    import public_tokenizers

    again = packing.pack_documents(kept, public_tokenizers.path("byte_bpe_50k.json")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, packed)) == sorted(map(key, again))
    filled = {}
    for r in packed:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048


def test_run_over_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pieces_of_one_id_are_spread(spark):
    """Null ids, and all pieces of one id, don't share a group of the first level."""
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") % 900 + 100).cast("long").alias("length"), (F.col("id") * 7919 % 4294967296).alias("ids_crc32"))
    packed = packing.pack(rows, rows_per_task=500)
    per = [r["count"] for r in packed.groupBy(F.expr("sequence_id >> 32")).count().collect()]
    assert packed.count() == 4000 and max(per) < 1500
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()
