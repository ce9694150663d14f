"""Helpers shared by the corpus operators: durable tables, batch sizes and free column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tables of the corpus are read with `table`.
SUFFIX = ".parquet"
#: Bytes that `strip` takes off both ends of a line: 0x20 and 0x09-0x0D.
BLANK = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}{SUFFIX}")


#: Folders of our own, by application, where spark.checkpoint.dir is unset (tests on one machine).
_OWN: dict[str, str] = {}


#: Tables that `durable` wrote, oldest first.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine a folder of our own where that is
    unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
        found = _OWN[app]
    return found.rstrip("/")


def durable_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors, runs `df` once. No mark of
    success is written, as nothing reads it: for each file that the driver makes, Hadoop may start a process."""
    path = durable_path(df.sparkSession, name)
    _MADE.append(path)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by `durable` that nothing reads any more."""
    names = _folders(df)
    for path in [p for p in _MADE if p.rpartition("/")[2] in names]:
        _delete(df.sparkSession, path)
        _MADE.remove(path)


def written() -> int:
    """How many tables of `durable` there are; a mark for `release`."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, *keep: DataFrame) -> None:
    """Delete the tables that `durable` wrote after the mark `since`, but for those that `keep` reads. For when all that
    was planned on them has been written; an operator's result is lazy and needs its tables until then."""
    held = set().union(*map(_folders, keep)) if keep else set()
    for path in [p for p in _MADE[since:] if p.rpartition("/")[2] not in held]:
        _delete(spark, path)
        _MADE.remove(path)


#: What clears the caches that operators keep in a Python worker, by operator.
CACHES: dict[str, Callable[[], None]] = {}


def keep_only(name: str) -> None:
    """Clear the worker's caches of other operators, as workers are used again by later stages."""
    for other, clear in CACHES.items():
        if other != name:
            clear()


#: Rows and bytes of an Arrow batch, since texts may be long.
BATCH_ROWS, BATCH_BYTES = 500, "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds. The same for all operators, as plans are lazy and share the session; a session
    that asks for fewer rows keeps its own figure."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "0")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Rows that a Parquet reader decodes at once where each holds a whole text or its media.
READ_ROWS = 256


def short_reads(spark: SparkSession) -> None:
    """Bound the rows that a Parquet reader holds decoded: Spark's 4096, whatever their bytes, are one array on the heap for
    each task. A session that asks for fewer keeps its own figure."""
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(rows, "4096")) > READ_ROWS:
        spark.conf.set(rows, str(READ_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Keys that are broadcast as hot: those with over this part of all rows, so never more than its inverse.
HOT_PART = 1 / 512


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """`rows` joined with `keyed`, which has a row for each key and in `weight` how many of the `total` rows it has. Hot
    keys are broadcast, so that their rows stay where they are; all others are shuffled."""
    hot = F.col(weight) > total * HOT_PART
    few = F.broadcast(keyed.where(hot))
    cold = rows.join(few.select(key), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(few, key).unionByName(cold)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
