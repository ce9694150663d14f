"""Files opened where the tasks run, and listings.

`opened` gives a seekable file of any store that Arrow knows, so that headers and archive members are read without the
rest. Listings go through Spark's binaryFile source, without its content column: only names and lengths are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings that a volume's name loses to become its case.
SUFFIXES = (".nii.gz", ".nii", ".nrrd")


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def opened(path: str):
    store, at = located(path)
    return store.open_input_file(at)


def put(path: str, data: bytes) -> None:
    """Write a whole file, then move it in place: a task that is run again replaces its own file."""
    store, at = located(path)
    staged = f"{at}.staging-{uuid.uuid4().hex}"
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(staged) as out:
        out.write(data)
    store.move(staged, at)


def case_of(path: Column) -> Column:
    """A file's name without the endings of volumes."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.nii\.gz|\.nii|\.nrrd)$", "")


def case_name(path: str) -> str:
    name = path.rpartition("/")[2]
    return next((name.removesuffix(s) for s in SUFFIXES if name.endswith(s)), name)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, path, length) of the files that `path` (which may have wildcards) names, sorted by case."""
    return spark.read.format("binaryFile").load(path).select(case_of(F.col("path")).alias("case_id"), "path", "length").orderBy("case_id", "path")


def folders(spark: SparkSession, parent: str, marker: str = "case.json") -> DataFrame:
    """(case_id, path) of the folders below `parent` that have a file named `marker`."""
    found = spark.read.format("binaryFile").load(f"{parent.rstrip('/')}/*/{marker}").select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("case_id"), "path").orderBy("case_id")


def paths_of(batches: Iterator, column: str = "path") -> Iterator[str]:
    for batch in batches:
        yield from batch.column(column).to_pylist()
