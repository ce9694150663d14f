"""Volumes as tables: headers without voxels, voxel relations, pairs of image and mask, and a writer.

Files are listed by Spark and opened in tasks (see stores.py); a header reads the first bytes of its file only. Volumes
are read with one channel and with their axes next to the world's (LPS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import MissingRows
from . import formats
from .stores import case_name, opened, paths_of, put

AXES = ("z", "y", "x")
HEADER = "case_id string, path string, size array<int>, spacing_mm array<double>, origin_mm array<double>, direction array<double>, channels int, dtype string"
_HEADER = pa.schema([("case_id", pa.string()), ("path", pa.string()), ("size", pa.list_(pa.int32())), ("spacing_mm", pa.list_(pa.float64())), ("origin_mm", pa.list_(pa.float64())), ("direction", pa.list_(pa.float64())), ("channels", pa.int32()), ("dtype", pa.string())])
VOXELS = "case_id string, z int, y int, x int, value double"
#: Voxels of a batch.
ROWS = 100_000


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path")


def headers(spark: SparkSession, path: str, native: bool = False) -> DataFrame:
    """Grids of the files that `path` names, as they are read (LPS), or as the files have them with `native`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in paths_of(batches):
            with opened(name) as f:
                h = formats.header(f.read(formats.HEAD))
            h = h if native else formats.oriented(h, np.broadcast_to(False, h["size"][::-1]))[0]
            yield pa.RecordBatch.from_pylist([{"case_id": case_name(name), "path": name, **{k: h[k] for k in ("size", "spacing_mm", "origin_mm", "direction", "channels", "dtype")}}], _HEADER)

    return _files(spark, path).mapInArrow(read, HEADER)


def scalar(content: bytes) -> tuple[dict, np.ndarray, str | None]:
    """Header, array and what was done about channels, of a file's bytes."""
    h, array = formats.volume(content)
    array, fix = formats.collapsed(array)
    return *formats.oriented(h, array), fix


def voxels(spark: SparkSession, path: str, foreground: bool = True, label: float | None = None) -> DataFrame:
    """(case_id, z, y, x, value): voxels above 0, those that equal `label`, or all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in paths_of(batches):
            with opened(name) as f:
                _, volume, _ = scalar(f.read())
            mask = volume == label if label is not None else volume > 0 if foreground else np.ones(volume.shape, bool)
            z, y, x = (a.astype(np.int32) for a in np.nonzero(mask))
            for a in range(0, len(z), ROWS):
                s = slice(a, a + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([case_name(name)] * len(z[s])), pa.array(z[s]), pa.array(y[s]), pa.array(x[s]), pa.array(volume[z[s], y[s], x[s]].astype(np.float64))], names=["case_id", *AXES, "value"])

    return _files(spark, path).mapInArrow(read, VOXELS)


def near(a: Column, b: Column, tolerance: float) -> Column:
    """Whether all values of two arrays are within the tolerance."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda p, q: F.abs(p - q) <= tolerance), lambda ok: ok)


def same_grid(a: DataFrame, b: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(case_id, same): sizes are equal; spacings, origins and directions are within the tolerance."""
    both = a.alias("a").join(b.alias("b"), F.col("a.case_id") == F.col("b.case_id"))
    parts = [near(F.col(f"a.{n}"), F.col(f"b.{n}"), tolerance) for n in ("spacing_mm", "origin_mm", "direction")]
    return both.select("a.case_id", ((F.col("a.size") == F.col("b.size")) & parts[0] & parts[1] & parts[2]).alias("same"))


def phase_pairs(images: DataFrame, masks: DataFrame, keys: tuple[str, ...] = ("case_id", "phase")) -> DataFrame:
    """Headers of images with the path of their mask; a mask takes its image's grid, so their sizes must be equal.
    An image without a mask, or with one of another size, raises."""
    other = masks.select(*keys, F.col("path").alias("mask_path"), F.col("size").alias("mask_size"))
    both = images.join(other, list(keys), "left")
    if bad := both.where("mask_path is null or mask_size <> size").select(*keys, "size", "mask_size").limit(5).collect():
        raise MissingRows(f"no mask of the image's size: {[tuple(r) for r in bad]}")
    return both.drop("mask_size")


def write(voxels: DataFrame, grids: DataFrame, folder: str, kind: str = "u1", fill: float = 0) -> DataFrame:
    """Write a zipped NIfTI-1 file for each case of `grids` (size, spacing_mm, origin_mm, direction, in x, y, z order) from
    its voxels; the rest of the grid has `fill`. Returns (case_id, path, voxels, bytes) of what was written.

    A volume is built in one task, as it is bounded by its grid. A file is moved in place when it is whole, so a task
    that is run again does no harm.
    """

    def build(key: tuple, grid: pa.Table, rows: pa.Table) -> pa.Table:
        case, g = str(key[0].as_py()), grid.select(["size", "spacing_mm", "origin_mm", "direction"]).to_pylist()[0]
        volume = np.full(g["size"][::-1], fill, dtype=np.float64)
        volume[tuple(rows.column(a).to_numpy() for a in AXES)] = rows.column("value").to_numpy()
        if np.dtype(kind).kind in "iu":
            volume = np.clip(np.rint(volume), np.iinfo(kind).min, np.iinfo(kind).max)
        data, path = formats.nifti(volume.astype(kind), g["spacing_mm"], g["origin_mm"], g["direction"]), f"{folder.rstrip('/')}/{case}.nii.gz"
        put(path, data)
        return pa.table({"case_id": [case], "path": [path], "voxels": pa.array([rows.num_rows], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    rows = voxels.join(grids.select("case_id"), "case_id", "left_semi").select("case_id", *AXES, F.col("value").cast("double").alias("value"))
    done = grids.groupBy("case_id").cogroup(rows.groupBy("case_id")).applyInArrow(build, "case_id string, path string, voxels bigint, bytes bigint")
    return voxels.sparkSession.createDataFrame(done.collect(), done.schema)  # a row for each file; it is written once
