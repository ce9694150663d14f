"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

1. Equal vectors of a label are one class, kept as their smallest vec_id.
2. Centres are fitted on a sample of at most `fit_rows` classes; every class is then assigned to its nearest centre.
3. A class is also a guest in each cell whose boundary is at most half of the link distance away. Of two linked classes
   in different cells, the one that is nearer to the boundary between them is a guest of the other's cell, so cells find
   every link: recall is exact for any centres.
4. Within a cell, blocks of at most BLOCK classes are compared by products in double precision. A block gives counts of
   links and a tree of them, never a list of pairs. A pair that meets in two cells counts in the smaller one.
5. Trees make components; the smallest vec_id of each is kept.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label or
vec_id, link with nothing and are kept; vectors of different lengths do not link; rows with one vec_id count as one
vector; an empty table gives an empty table; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches
from .graph import components

#: Classes of a block, and of those the rows that are multiplied at once.
BLOCK, STRIP = 4096, 512
#: Classes of a label for each cell, and the most cells.
CELL_ROWS, MOST_CELLS = 2000, 1024
ROUNDS = 8


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very small and very large vectors keep their direction
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres_of(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of unit rows."""
    rng = np.random.default_rng(7)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        sizes = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(sizes > 0, sums / np.where(sizes > 0, sizes, 1), c)
    return c


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists without nulls, and where each list starts."""
    return column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()


def _assign(shared, threshold: float):
    reach = (2 - 2 * threshold) ** 0.5 / 2 + 1e-9

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {size: np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T))) for size, c in shared.value.items()}  # centres are unit
        for batch in batches:
            values, starts = flat(batch.column("embedding"))
            sizes = np.diff(starts)
            homes, guests = np.zeros(len(sizes), dtype=np.int32), [[]] * len(sizes)
            for size in np.unique(sizes).tolist():
                if (c := shared.value.get(size)) is None:
                    continue  # one cell
                at = np.flatnonzero(sizes == size)
                sims = unit(values[starts[at][:, None] + np.arange(size)]) @ c.T
                home = np.argmax(sims, axis=1)
                close = sims[np.arange(len(at)), home][:, None] - sims <= reach * apart[size][home]
                close[np.arange(len(at)), home] = False
                homes[at] = home
                for i, row in zip(at, close, strict=True):
                    guests[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("id", "label", "n", "embedding")], pa.array(sizes.astype(np.int32)), pa.array(homes), pa.array(guests, pa.list_(pa.int32()))],
                names=["id", "label", "n", "embedding", "dim", "home", "guests"],
            )

    return assign


def merged(labels: np.ndarray, hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """`labels` after joining left[i] with all right[j] where hits[i, j]."""
    for i in np.flatnonzero(hits.any(axis=1)):
        met = labels[right[hits[i]]]
        if (met != labels[left[i]]).any():
            met = np.unique(np.append(met, labels[left[i]]))
            labels[np.isin(labels, met)] = met[0]
    return labels


KEYS = ("label", "dim", "cell", "bi", "bj")


def _compare(threshold: float):
    def compare(cell: int, same: bool, parts: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, weight, x, home, side, role = (np.concatenate([p[k] for p in parts]) for k in ("id", "n", "x", "home", "side", "role"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = left if same else right
        links, labels = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        if len(left) and len(right):
            x = unit(x)
            # A pair of a home and a guest meets in the guest's own cell as well if the home is a guest there.
            width = int(home.max()) + 1
            back = np.zeros((len(ids), width), dtype=bool) if (role[right] == 1).any() else None
            if back is not None:
                own, at = np.concatenate([p["guests"] for p in parts]), np.repeat(np.arange(len(ids)), np.concatenate([p["n_guests"] for p in parts]))
                back[at[own < width], own[own < width]] = True
                earlier = (role[right] == 1) & (home[right] < cell)
            for a in range(0, len(left), STRIP):
                own = left[a : a + STRIP]
                hits = x[own] @ x[right].T >= threshold
                if same:
                    hits[np.arange(len(own)), a + np.arange(len(own))] = False
                if back is not None:
                    hits &= ~(back[own][:, home[right]] & earlier[None, :])
                links[own] += hits @ weight[right]
                if not same:
                    links[right] += hits.T @ weight[own]
                labels = merged(labels, hits, own, right)
        touched = np.flatnonzero(links)
        return ids[touched], links[touched], ids[labels[touched]]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def done() -> pa.RecordBatch:
            found = compare(name[2], name[3] == name[4], held)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "links", "root"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in KEYS], axis=1)
            if not len(keys):
                continue
            plain = {k: batch.column(k).to_numpy() for k in ("id", "n", "home", "side", "role")}
            values, starts = flat(batch.column("embedding"))
            guests, first = flat(batch.column("guests"))
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                own = tuple(keys[a].tolist())
                if own != name:
                    if held:
                        yield done()
                    name, held = own, []
                part = {k: v[a:b] for k, v in plain.items()}
                held.append(part | {"x": values[starts[a] : starts[b]].reshape(b - a, own[1]), "guests": guests[first[a] : first[b]], "n_guests": np.diff(first[a : b + 1])})
        if held:
            yield done()

    return blocks


def _centres(classes: DataFrame, fit_rows: int) -> dict[int, np.ndarray]:
    """Centres by vector length; none where one cell will do."""
    sizes = classes.groupBy(F.size("embedding").alias("dim"), "label").agg(F.count("*").alias("rows")).groupBy("dim").agg(F.max("rows").alias("most"), F.sum("rows").alias("rows"))
    out = {}
    for dim, most, rows in sizes.orderBy(F.desc("rows")).limit(64).collect():
        k = min(MOST_CELLS, -(-most // CELL_ROWS))
        if k < 2:
            continue
        draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(5)), 11) / F.lit(float(1 << 53))
        sample = classes.where((F.size("embedding") == dim) & (draw < fit_rows / rows)).select("id", "embedding").orderBy("id").limit(fit_rows).collect()
        out[dim] = centres_of(unit(np.array([r.embedding for r in sample])), k)
    return out


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93, fit_rows: int = 10_000) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors`."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("bigint").alias("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    linked = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))
    rows = rows.withColumn("vector", F.when(linked, F.col("embedding")))
    valid = rows.where("vector is not null").select("vec_id", "label", F.col("vector").alias("embedding"))
    classes = durable(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("n")), "vector-classes")
    shared = spark.sparkContext.broadcast(_centres(classes, fit_rows))  # at most MOST_CELLS vectors a length
    placed = classes.select("id", "label", "n", "embedding").mapInArrow(_assign(shared, threshold), "id bigint, label bigint, n bigint, embedding array<double>, dim int, home int, guests array<int>")
    placed = durable(placed, "vector-cells")
    here = placed.withColumn("cell", F.col("home")).withColumn("role", F.lit(0)).unionByName(placed.withColumn("cell", F.explode("guests")).withColumn("role", F.lit(1)))
    counts = here.groupBy("label", "dim", "cell").agg(F.ceil(F.sum(1 - F.col("role")) / BLOCK).cast("int").alias("nh"), F.ceil(F.sum("role") / BLOCK).cast("int").alias("ng")).where("nh > 0")
    here = here.join(counts, ["label", "dim", "cell"])
    block = F.pmod(F.xxhash64("id"), F.when(F.col("role") == 0, F.col("nh")).otherwise(F.col("ng"))).cast("int")
    here = here.withColumn("b", F.when(F.col("role") == 0, block).otherwise(F.col("nh") + block))
    left = here.where("role = 0").withColumn("bi", F.col("b")).withColumn("bj", F.explode(F.sequence(F.col("b"), F.col("nh") + F.col("ng") - 1))).withColumn("side", F.lit(0))
    right = here.where("b > 0").withColumn("bj", F.col("b")).withColumn("bi", F.explode(F.sequence(F.lit(0), F.least(F.col("b"), F.col("nh")) - 1))).withColumn("side", F.lit(1))
    asked = left.unionByName(right).repartition("label", "dim", "cell", "bi", "bj").sortWithinPartitions("label", "dim", "cell", "bi", "bj")
    asked = asked.select("label", "dim", "cell", "bi", "bj", "id", "n", "embedding", "home", "guests", "side", "role")
    found = durable(asked.mapInArrow(_compare(threshold), "id bigint, links bigint, root bigint"), "vector-links")
    labels = components(found, "id", "root")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.join(links, "id", "left").join(labels, "id", "left")
    known = known.select(F.col("label").alias("__l"), F.col("embedding").alias("__e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(known, (F.col("vector") == F.col("__e")) & (F.col("label") == F.col("__l")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
