"""Row groups and reader batches of long texts stay small, so that a small heap holds those of all its tasks."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from traceforge.llm import _common, quality


def groups(folder):
    metas = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/*.parquet")]
    return [m.row_group(k).total_byte_size for m in metas for k in range(m.num_row_groups)]


def test_long_texts_are_written_and_read_in_small_parts(spark, tmp_path):
    keys = ("parquet.block.size", "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.unset(k)
    try:
        # 58 MB of text in one partition, which hardly compress
        docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(300)]).alias("text"))
        kept = _common.saved(docs, "long")
        assert kept.count() == 3000
        sizes = groups(kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0])
        assert sum(sizes) > 50e6 and max(sizes) < 1.5 * _common.GROUP_BYTES
        # what a caller writes of a stage
        quality.score(docs, quality.fit([], []), keep=["doc_id", "text"]).write.parquet(str(tmp_path / "out"))
        sizes = groups(tmp_path / "out")
        assert sum(sizes) > 50e6 and max(sizes) < 1.5 * _common.GROUP_BYTES
        assert int(spark.conf.get(keys[1])) <= _common.BATCH_ROWS
        # what the session asks for stays
        spark.conf.set(keys[0], str(64 << 20))
        spark.conf.set(keys[1], "100")
        _common.tune(spark)
        assert spark.conf.get(keys[0]) == str(64 << 20) and spark.conf.get(keys[1]) == "100"
    finally:
        for k, v in before.items():
            spark.conf.unset(k)
            if v is not None:
                spark.conf.set(k, v)
