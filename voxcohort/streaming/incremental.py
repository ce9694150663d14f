"""Resumable incremental work: keys that a log has are skipped, new records are appended.

As a batch it is an anti join with the done set. As a stream, new JSON files are merged into a table, the last record of
a key winning; parts of the table are swapped whole, so a failed batch leaves each at its old version or at its new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import first_of
from ..sources.sinks import files_of, recover, swap

#: Column that numbers the parts of a merged table.
PART = "key_part"


def todo(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items without a record."""
    return items.join(done.select(*keys), keys, "left_anti")


def merge_latest(base: DataFrame | None, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The record with the largest `order` for each key."""
    both = changes if base is None else base.unionByName(changes, allowMissingColumns=True)
    return first_of(both, keys, [F.col(order)], largest=True)


def parted(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """`df` with the part that a row's key falls in."""
    return df.withColumn(PART, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(parts)).cast("int"))


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """What `follow` has merged so far: all parts but their number. A part that a swap was cut off from is put back."""
    listed, at = files_of(spark, target)
    for f in listed.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/{PART}=*.retired-*")) or []:
        recover(spark, f.getPath().toString().rpartition(".retired-")[0])
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(*[f.getPath().toString() for f in listed.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{at.toString().rstrip('/')}/{PART}=*")) if _part(f.getPath().getName()) is not None])


def _part(name: str) -> int | None:
    number = name.removeprefix(f"{PART}=")
    return int(number) if number.isdigit() else None


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], order: str, parts: int = 64) -> StreamingQuery:
    """Follow a folder of JSON-lines files; `target` always holds the last record of each key (see `read_latest`). Stops
    when caught up.

    The target has `parts` parts by a hash of the key. A batch rewrites only the parts that it has keys of, each swapped
    in whole; the merge gives the same again, so a batch that failed halfway is just run again.
    """
    stream = spark.readStream.schema(schema).json(source)

    def merge(batch: DataFrame, number: int) -> None:
        rows = parted(batch, keys, parts).persist()
        try:
            touched = [r[0] for r in rows.select(PART).distinct().collect()]  # at most `parts` numbers
            if not touched:
                return
            places = {k: f"{target.rstrip('/')}/{PART}={k}" for k in touched}
            for path in places.values():
                recover(spark, path)
            fs, _ = files_of(spark, target)
            there = [p for p in places.values() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
            base = parted(spark.read.parquet(*there), keys, parts) if there else None
            staged = f"{target.rstrip('/')}.staging-{number}"
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
            merged = merge_latest(base, rows, [*keys, PART], order)
            merged.repartition(PART).write.partitionBy(PART).parquet(staged)
            fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(target))
            for k, path in places.items():
                swap(spark, f"{staged}/{PART}={k}", path)
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
