"""Shared plumbing: shared-folder scratch tables, scans, hashing helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Only under a local master (tests), where driver and executors are the same
    machine, a folder is made and set where the session names none; on a
    cluster that raises RuntimeError.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="riverine-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _release() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder goes with it
            return


atexit.register(_release)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that written() gave and that nothing reads any more."""
    if path := getattr(df, "_riverine_path", None):
        _delete(_WRITTEN.pop(path), path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here.

    Lost executors cost a re-read and not a recomputation.  The files are
    removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riverine/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._riverine_path = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The rows of the smallest h (a hash, a long) of each value of `by`: all of the first `most`, and some 9 % more.

    Rows are counted by the magnitude of their hash, eight steps to a power of
    two; that table has a few hundred rows a value, and says up to which step a
    value has enough.  One row a value is broadcast (languages, labels), no
    row beyond its step is shuffled, and no task holds the rows of a value.
    """
    size = F.col("h").bitwiseAND(F.lit((1 << 63) - 1)).cast("double") + 1
    rows = rows.withColumn("h_step", F.floor(F.log2(size) * 8).cast("int"))
    counts = rows.groupBy(by, "h_step").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("h_step")) - F.col("n")
    last = counts.withColumn("before", before).where(F.col("before") < most).groupBy(by).agg(F.max("h_step").alias("h_last"))
    return rows.join(F.broadcast(last), by).where("h_step <= h_last").drop("h_step", "h_last")


#: Spark's own number of rows in an Arrow batch, and the one used for texts.
_ROWS, _TEXT_ROWS = "10000", "1000"


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (doc_id, text), under those names.

    Where the session leaves the rows of an Arrow batch at Spark's default,
    they are lowered for the session: 10,000 long texts on both sides of the
    pipe, a few times over, are what an executor's memory goes into.  Spark
    reads the setting when the plan runs, so it can't be put back here.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == _ROWS:
        spark.conf.set(name, _TEXT_ROWS)
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        return


def pieces(batches, rows: int = 1000):
    """The Arrow batches in slices of at most so many rows; what is freed goes back to the system at the end.

    Python workers are reused by later tasks and stages, so memory that one
    keeps counts against the executor for good.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    give_back()


def map_texts(df: DataFrame, id_col: str, text_col: str, start, columns: str, keep_text=False) -> DataFrame:
    """Row-wise map over texts: doc_id as it is, then the given columns.

    start() is called once a task and returns a function from a list of texts
    (None for null) to a list of row tuples.  Ids never leave Arrow, so null
    and large ids stay exact; an id may be a struct of further columns.
    keep_text hands the text through as well.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = texts(df, id_col, text_col)
    schema = StructType([rows.schema["doc_id"], *[rows.schema["text"]] * keep_text, *StructType.fromDDL(columns)])
    kinds, first = to_arrow_schema(schema), 1 + keep_text

    def run(batches):
        judge = start()
        for batch in pieces(batches):
            found = list(zip(*judge(batch.column("text").to_pylist()), strict=True)) or [()] * (len(kinds) - first)
            given = [batch.column(n).cast(kinds.field(n).type) for n in ("doc_id", "text")[:first]]
            yield pa.RecordBatch.from_arrays(given + [pa.array(x, kinds[i + first].type) for i, x in enumerate(found)], schema=kinds)

    return rows.mapInArrow(run, schema)
