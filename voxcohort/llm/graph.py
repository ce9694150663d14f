"""Connected components of a table of links, by alternating large and small stars.

Links are first contracted task by task: a part of them becomes a forest of stars with the same components, so chains
within a part cost no round. Each round is then a pre-aggregated minimum and a join that Spark may split; a round's links
are a table in the shared folder. The number of rounds grows with the logarithm of the longest path between parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable

#: Links that a task contracts at once.
HELD = 1 << 18


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least) for all but the least of each component of the links."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    least = np.arange(len(names))
    while True:
        now = least.copy()
        np.minimum.at(now, a, least[b])
        np.minimum.at(now, b, least[a])
        np.minimum.at(now, least, now)  # what a member has learned, its star learns
        now = now[now]
        if (now == least).all():
            break
        least = now
    away = np.flatnonzero(least != np.arange(len(names)))
    return names[away], names[least[away]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def done() -> pa.RecordBatch:
        u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        n += len(held[-1][0])
        if n > HELD:
            yield done()
            held, n = [], 0
    if n:
        yield done()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in `links`; component is the smallest id that it reaches."""
    now = links.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where("u <> v")
    now = durable(now.mapInArrow(_contract, "u bigint, v bigint").distinct(), "links")
    before = _mark(now)
    while before[0]:
        # Large star: neighbours larger than u go to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        after = durable(small, "links")
        mark = _mark(after)
        discard(now)
        now = after
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
