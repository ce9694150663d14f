"""Connected components of voxel relations with 26 neighbours.

A component is named by its smallest voxel id. `label_components` sends each volume's foreground to one task, as a volume
is bounded by its grid; `label_components_joined` joins neighbours instead, for volumes too large for a worker.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
#: One of each pair of opposite neighbour offsets.
OFFSETS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]


def label(coordinates: np.ndarray) -> np.ndarray:
    """For each voxel (rows of z, y, x) the smallest row number of its component."""
    n = len(coordinates)
    if not n:
        return np.zeros(0, np.int64)
    span = coordinates.max(axis=0) - coordinates.min(axis=0) + 3
    at = coordinates - coordinates.min(axis=0) + 1
    keys = (at[:, 0] * span[1] + at[:, 1]) * span[2] + at[:, 2]
    order = np.argsort(keys, kind="stable")
    known = keys[order]
    pairs = []
    for a, b, c in OFFSETS:
        wanted = keys + (a * span[1] + b) * span[2] + c
        found = np.minimum(np.searchsorted(known, wanted), n - 1)
        hit = known[found] == wanted
        pairs.append(np.stack([np.flatnonzero(hit), order[found[hit]]]))
    left, right = np.concatenate(pairs, axis=1)
    names = np.arange(n)
    while len(left):
        low = np.minimum(names[left], names[right])
        new = names.copy()
        np.minimum.at(new, names[left], low)
        np.minimum.at(new, names[right], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[names]
        if (new == names).all():
            break
        names = new
    return names


def label_components(voxels: DataFrame, keys: tuple[str, ...] = ("case_id",), voxel_id: str = "voxel_id") -> DataFrame:
    """`voxels` (keys, z, y, x, voxel_id) with `component`."""
    kinds = dict(voxels.dtypes)
    rows = voxels.select(*keys, *AXES, voxel_id)

    def solve(table: pa.Table) -> pa.Table:
        at = np.stack([table.column(c).to_numpy() for c in AXES], axis=1).astype(np.int64)
        ids = table.column(voxel_id).to_numpy()
        order = np.argsort(ids, kind="stable")
        names = np.empty(len(ids), dtype=ids.dtype)
        names[order] = ids[order][label(at[order])]
        return table.append_column("component", pa.array(names))

    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + f", component {kinds[voxel_id]}"
    return rows.groupBy(*keys).applyInArrow(solve, schema)


def label_components_joined(voxels: DataFrame, keys: tuple[str, ...] = ("case_id",), voxel_id: str = "voxel_id") -> DataFrame:
    """The same by joins alone: links to neighbours, then the smallest name within reach, doubling the reach."""
    rows = voxels.select(*keys, *AXES, F.col(voxel_id).alias("id"))
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip(AXES, o, strict=True)]) for o in OFFSETS])).alias("s")
    moved = rows.select(*keys, *AXES, "id", steps).select(*keys, *[(F.col(a) + F.col(f"s.d{a}")).alias(a) for a in AXES], F.col("id").alias("from"))
    links = moved.join(rows, [*keys, *AXES]).select(F.col("from").alias("u"), F.col("id").alias("v"))
    links = links.union(links.select("v", "u")).union(rows.select("id", "id"))
    names = rows.select("id", F.col("id").alias("component"))
    folder = voxels.sparkSession.conf.get("spark.checkpoint.dir", None)
    before, held = None, None
    while True:
        least = links.join(names, links.v == names.id).groupBy("u").agg(F.min("component").alias("component"))
        jump = least.select(F.col("u").alias("id"), F.col("component").alias("mid"))
        far = jump.join(least.select(F.col("u").alias("mid"), F.col("component").alias("component")), "mid").select("id", "component")
        if folder:
            path = f"{folder.rstrip('/')}/components-{uuid.uuid4().hex}"
            far.write.parquet(path)
            names = voxels.sparkSession.read.schema(far.schema).parquet(path)
        else:
            names = far.persist()
        mark = names.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if held is not None:
            held.unpersist()  # nothing reads the round before any more
        held = None if folder else names
        if mark == before:
            break
        before = mark
    return rows.join(names, "id").select(*keys, *AXES, F.col("id").alias(voxel_id), "component")


def numbered(components: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """`components` with `label`: 1, 2, ... within each volume, in the order of the components' names. After a filter the
    numbers are without gaps again. Only names are ranked, not voxels."""
    names = components.select(*keys, "component").distinct()
    places = names.withColumn("label", F.row_number().over(Window.partitionBy(*keys).orderBy("component")))
    return components.join(places, [*keys, "component"])


def drop_small(components: DataFrame, least: int, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Voxels of components with at least `least` voxels; names stay, as whole components go."""
    if least <= 1:
        return components
    large = components.groupBy(*keys, "component").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return components.join(large, [*keys, "component"], "left_semi")


def contingency(voxels: DataFrame, found: str = "pred", thresholds: tuple[int, ...] = (), least: int = 0) -> DataFrame:
    """Shared voxels of true and found components, from one pass over each volume.

    `voxels` has case_id, z, y, x, voxel_id, gt and the column `found`: a boolean, or numbers that are compared with each
    of `thresholds`. A row (case_id, threshold, lesion, piece, n) counts the voxels of a lesion that lie in a piece; lesion
    or piece is null for voxels outside of one. The truth is labelled once for all thresholds. Found components under
    `least` voxels are dropped. Rows are dealt by case, so what is computed from them needs no further shuffle.
    """
    levels = thresholds or (None,)
    kinds = dict(voxels.dtypes)
    hit = F.col(found) if not thresholds else F.col(found) >= min(thresholds)
    rows = voxels.where(F.col("gt") | hit).select("case_id", *AXES, "voxel_id", "gt", F.col(found).cast("int").alias("found"))

    def names(at: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), -1, dtype=np.int64)
        inside = np.flatnonzero(mask)
        out[inside] = inside[label(at[inside])]
        return out

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("voxel_id")
        at, ids = np.stack([table.column(c).to_numpy() for c in AXES], axis=1).astype(np.int64), table.column("voxel_id").to_numpy()
        gt, value = table.column("gt").to_numpy(zero_copy_only=False), table.column("found").to_numpy()
        lesion, out = names(at, ids, gt), []
        for t in levels:
            piece = names(at, ids, value > 0 if t is None else value >= t)
            if least > 1 and (piece >= 0).any():
                sizes = np.bincount(piece[piece >= 0], minlength=len(ids))
                piece[(piece >= 0) & (sizes[piece] < least)] = -1
            pairs, n = np.unique(np.stack([lesion, piece], axis=1)[(lesion >= 0) | (piece >= 0)], axis=0, return_counts=True)
            named = [pa.array(ids[np.maximum(pairs[:, i], 0)], mask=pairs[:, i] < 0) for i in (0, 1)]
            case = pa.array([table.column("case_id")[0].as_py()] * len(n), table.schema.field("case_id").type)
            out.append(pa.table({"case_id": case, "threshold": pa.array([t or 0] * len(n), pa.int32()), "lesion": named[0], "piece": named[1], "n": pa.array(n, pa.int64())}))
        return pa.concat_tables(out)

    schema = f"case_id {kinds['case_id']}, threshold int, lesion {kinds['voxel_id']}, piece {kinds['voxel_id']}, n bigint"
    return rows.groupBy("case_id").applyInArrow(solve, schema).repartition("case_id")
