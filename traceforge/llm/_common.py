"""What the operators share: shared-folder tables, column handling and Arrow batches cut by bytes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of one Arrow batch; long texts are cut further by bytes inside the batch.
BATCH_ROWS = 1024
#: Bytes of text that one call of a batch function gets at most (a longer single text comes alone).
SLICE_BYTES = 4 << 20
#: Bytes of a row group: a writer holds one in memory, a reader the compressed columns of one.
GROUP_BYTES = 16 << 20
_GROUP = "parquet.block.size"


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches, those of the Parquet reader and the row groups that the session writes small enough for long
    texts, unless the session already asks for less (or names the size of a row group)."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if int(spark.conf.get(key)) > BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
    if not spark.conf.get(_GROUP, None) and not spark.sparkContext._jsc.hadoopConfiguration().get(_GROUP):
        spark.conf.set(_GROUP, str(GROUP_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where none is named and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/traceforge-shared"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/traceforge/{name}-{uuid.uuid4().hex}"
    df.write.option(_GROUP, GROUP_BYTES).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns whose names clash with what an operator adds (names are compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.drop(*clash) if clash else df


def col(name: str):
    return F.col(f"`{name}`")


def slices(sizes: Sequence[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive rows with at most ``most`` bytes, never empty."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def append_columns(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list], dict[str, list]]],
    fields: Sequence[T.StructField],
    keep: Sequence[str] | None = None,
    most: int = SLICE_BYTES,
) -> DataFrame:
    """Append columns computed from a text column, in Arrow batches, without a shuffle.

    ``make()`` runs once per task and returns a function from a list of texts (nulls as None) to a dict of lists.
    ``keep``: the columns to carry along, all by default. A kept column that has the name of a new one is replaced.
    """
    tune(df.sparkSession)
    names = [f.name for f in fields]
    rest = without(df.select(*[col(c) for c in keep]) if keep is not None else df, names)
    kept = rest.columns
    source = df.select(*[col(c) for c in kept], col(text_col).alias("__text__"))
    out = T.StructType([f for f in source.schema.fields[:-1]] + list(fields))
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            texts = b.column(len(kept)).to_pylist()
            sizes = [len(t) if t else 0 for t in texts]
            for i, j in slices(sizes, most):
                got = fn(texts[i:j])
                part = b.slice(i, j - i)
                arrays = [part.column(k) for k in range(len(kept))]
                arrays += [pa.array(got[n], type=k) for n, k in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=kept + names)

    return source.mapInArrow(run, out)
