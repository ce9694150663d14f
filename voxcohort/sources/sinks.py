"""Sinks: tables and files that are swapped in whole, documents, append-only logs, transforms, reports.

Renames go through Hadoop's file system interface, so that they work in any store that Spark writes to. A swap keeps what
was there until the new version is in place: the old one is renamed aside, the new one in, and the old one is put back if
that fails.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EmptyTable(ValueError):
    """Refused: there was nothing to write."""


def files_of(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def swap(spark: SparkSession, staged: str, path: str, rename: Callable[[Any, Any, Any], bool] | None = None) -> None:
    """Put `staged` in the place of `path`. Whatever fails, one whole version stays at `path`, or beside it as
    `path`.retired-*, from where the next swap takes it back."""
    rename = rename or (lambda fs, a, b: fs.rename(a, b))
    fs, target = files_of(spark, path)
    source = spark._jvm.org.apache.hadoop.fs.Path(staged)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.retired-{uuid.uuid4().hex}")
    there = fs.exists(target)
    if there and not rename(fs, target, old):
        raise OSError(f"could not retire {path}")
    done = False
    try:
        done = rename(fs, source, target)
    finally:
        if not done and there and not fs.exists(target):
            rename(fs, old, target)
    if not done:
        raise OSError(f"could not publish {path}")
    if there:
        fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> bool:
    """If a swap was cut off between its two renames, put the retired version back."""
    fs, target = files_of(spark, path)
    if fs.exists(target):
        return False
    held = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.retired-*")) or []
    held = sorted(held, key=lambda f: f.getModificationTime())
    return bool(held) and fs.rename(held[-1].getPath(), target)


def publish(df: DataFrame, path: str, kind: str = "parquet", refuse_empty: bool = False, partition_by: list[str] | None = None, **options) -> None:
    """Write beside `path` and swap: readers see the old table or the new one, never a part of either."""
    if refuse_empty and df.isEmpty():
        raise EmptyTable(path)
    spark, staged = df.sparkSession, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    fs, source = files_of(spark, staged)
    recover(spark, path)
    try:
        writer = df.write.options(**options).format(kind)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(staged)
        swap(spark, staged, path)
    finally:
        fs.delete(source, True)


def export_file(df: DataFrame, path: str, kind: str = "csv", refuse_empty: bool = True) -> None:
    """One file for a small table, such as a manifest: a header and the rows in the order of `df`."""
    if refuse_empty and df.isEmpty():
        raise EmptyTable(path)
    spark, staged = df.sparkSession, f"{path}.staging-{uuid.uuid4().hex}"
    fs, source = files_of(spark, staged)
    recover(spark, path)
    try:
        df.coalesce(1).write.option("header", True).format(kind).save(staged)
        part = next(f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-"))
        swap(spark, part.toString(), path)
    finally:
        fs.delete(source, True)


def plain(value: Any) -> Any:
    """`value` as JSON has it: keys as text, tuples as lists, scalars of NumPy as Python's, paths and others as text."""
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, list | tuple | set | frozenset):
        return [plain(v) for v in (sorted(value) if isinstance(value, set | frozenset) else value)]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return str(value)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A document, as UTF-8; written beside `path` and swapped."""
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    fs, source = files_of(spark, staged)
    recover(spark, path)
    try:
        out = fs.create(source, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        swap(spark, staged, path)
    finally:
        fs.delete(source, True)


def write_document(spark: SparkSession, path: str, value: Any) -> None:
    """One JSON document."""
    write_text(spark, path, json.dumps(plain(value), indent=2, ensure_ascii=False) + "\n")


def append_log(df: DataFrame, path: str) -> None:
    """One JSON record a line, added to what is there; failures are records with `error`."""
    df.write.mode("append").json(path)


def spelled(df: DataFrame) -> DataFrame:
    """Manifest spelling: flags as 0 and 1, lists joined, structs as JSON."""
    out = []
    for c, t in df.dtypes:
        value = F.col(c)
        if t == "boolean":
            value = value.cast("int")
        elif t.startswith("array<string"):
            value = F.array_join(c, "+")
        elif t.startswith(("array", "struct", "map")):
            value = F.to_json(c)
        out.append(value.alias(c))
    return df.select(*out)


#: What a stored transform maps.
SEMANTICS = "maps points of the {reference} grid to points of {phase}, both in mm; resampling reads {phase} there"


def transforms(chosen: DataFrame, reference: str) -> DataFrame:
    """The transforms table, a row for each registered phase: `chosen` (case_id, phase, method, dice, usable, and the
    parameters as an array of doubles) with the reference, what the parameters mean, and the name that files have."""
    names = F.concat(F.lit(f"resampling_transform_{reference.lower()}_to_"), F.lower("phase"))
    meaning = F.replace(F.lit(SEMANTICS.replace("{reference}", reference)), F.lit("{phase}"), F.col("phase"))
    return chosen.where(F.col("phase") != reference).select("case_id", F.lit(reference).alias("reference"), "phase", names.alias("transform"), "method", "parameters", "dice", "usable", meaning.alias("semantics"))


def report(df: DataFrame, title: str = "", most: int = 20) -> str:
    """The first rows as text: aligned columns under a title, and how many rows were left out."""
    rows = df.limit(most + 1).collect()
    cells = [df.columns, *[["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(plain(v)) for v in r] for r in rows[:most]]]
    width = [max(map(len, column)) for column in zip(*cells, strict=True)]
    lines = ["  ".join(c.ljust(w) for c, w in zip(row, width, strict=True)).rstrip() for row in cells]
    return os.linesep.join(([title] if title else []) + lines + (["..."] if len(rows) > most else []))
