"""Sharding by sampled splitters: near equal bytes, DataFrame operations only.

Rows are ordered by (60 bits of the text's SHA-256, doc_id, a row number), so that equal texts stand together.
1. A size-weighted sample of keys is drawn by hash; its quantiles are the boundaries of fine ranges.
2. Ranges that still hold over `overfull` times the mean are subdivided at exact quantiles of their own rows.
3. Sums over ranges, then within ranges, give each row its offset in the whole order. A shard is an equal share of all
   bytes, and has the rows whose middle lies in it; a group of equal texts that a cut would part goes whole where its own
   middle lies if it has at most `whole_group` of a shard's bytes, else it is parted. So shards differ from their share
   by half a row at each end, or half of such a group.

There is a range for `range_rows` rows, 1024 at least and MOST_RANGES at most. The sample (`per_range` keys a range
expected) and the table of ranges alone reach the driver. Size is the UTF-8 bytes of the text plus 1.

Defined cases: a null text has size 1 and stands with empty texts; a null doc_id comes first within its group;
repeated rows are rows of their own; an empty table gives an empty table; other columns are not returned.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_or_empty

LAW = "bytes"
LEAST_RANGES, MOST_RANGES = 1024, 1 << 15


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that the values fix."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _at_most(key: Column, bounds: list[tuple]) -> Column:
    """How many of `bounds` are at most `key`: a search of two levels over constant arrays."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    literal = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), kind)  # noqa: E731  folded to a constant once
    named = lambda rows: [dict(zip("kdr", x, strict=True)) for x in rows]
    kind = "array<struct<k:bigint,d:bigint,r:bigint>>"
    first = F.size(F.filter(literal(named([g[0] for g in groups]), kind), lambda b: b <= key))
    return F.when(first == 0, 0).otherwise((first - 1) * step + F.size(F.filter(F.element_at(literal([named(g) for g in groups], f"array<{kind}>"), F.greatest(first, F.lit(1))), lambda b: b <= key)))


def shard(docs: DataFrame, shards: int = 16, ranges: int | None = None, range_rows: int = 1 << 20, per_range: int = 8, overfull: int = 4, whole_group: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of `docs`."""
    text = F.encode(text_or_empty(), "utf-8")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint").alias("k"),
        F.monotonically_increasing_id().alias("r"),
    )
    rows = durable(rows.withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63)))), "shard-keys")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, n // range_rows))
    key = F.struct("k", "d", "r")
    sampled = rows.where(uniform(F.col("k"), F.col("d"), F.col("r")) < F.col("size") * F.lit(ranges * per_range / max(total, 1)))
    sample = sorted((x.k, x.d, x.r) for x in sampled.select("k", "d", "r").collect())  # ranges x per_range rows expected
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    rows = rows.withColumn("range", _at_most(key, bounds).cast("int")).withColumn("key", key)
    # Overfull ranges: rows there are ranked again by a finer, equal-sized bucket of their own key span.
    sums = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    full = [x for x in sums.where((F.col("rows") > overfull * n / ranges) | (F.col("bytes") > overfull * total / ranges)).collect()]  # at most 2 x ranges / overfull
    bounds += _finer(rows, full, n, total, ranges, overfull)
    rows = rows.drop("range").withColumn("range", _at_most(key, sorted(set(bounds))).cast("int"))
    sums = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))  # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_bytes"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_rows"))
    inner = Window.partitionBy("range").orderBy("k", "d", "r")
    placed = rows.join(F.broadcast(base), "range").select(
        "doc_id", "size", "text_crc32", "k",
        (F.col("base_bytes") + F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("base_rows") + F.row_number().over(inner) - 1).alias("ordinal"),
    )
    placed = durable(placed, "shard-offsets")
    # Twice the middle, so that it is a whole number.
    slice_of = lambda twice: F.least(F.floor(twice * shards / F.lit(2 * max(total, 1))), F.lit(shards - 1)).cast("int")
    row = 2 * F.col("start") + F.col("size")
    # At most shards - 1 groups hold a cut.
    parted = placed.groupBy("k").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.min("start").alias("from"), F.sum("size").alias("group_bytes"))
    parted = parted.where((slice_of(F.col("first")) != slice_of(F.col("last"))) & (F.col("group_bytes") * shards <= F.lit(whole_group * total)))
    parted = parted.select("k", (2 * F.col("from") + F.col("group_bytes")).alias("group"))
    dealt = placed.join(F.broadcast(parted), "k", "left").withColumn("shard", slice_of(F.coalesce(F.col("group"), row)))
    first = dealt.groupBy("shard").agg(F.min("ordinal").alias("first"))  # a row for each shard
    return dealt.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("ordinal") - F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _finer(rows: DataFrame, full: list, n: int, total: int, ranges: int, overfull: int) -> list[tuple]:
    """New boundaries within overfull ranges: a denser size-weighted sample of those ranges alone."""
    if not full:
        return []
    inside = rows.where(F.col("range").isin([x.range for x in full]))
    weight = F.col("size") * F.lit(16.0 * ranges / max(total, 1)) + F.lit(16.0 * ranges / max(n, 1))
    sample = sorted((x.range, x.k, x.d, x.r) for x in inside.where(uniform(F.col("r"), F.col("k"), F.col("d")) < weight).select("range", "k", "d", "r").collect())  # 32 x ranges rows expected
    out = []
    for x in full:
        own = [s[1:] for s in sample if s[0] == x.range]
        pieces = max(2, int(max(x.rows * ranges / n, x.bytes * ranges / total)))
        out += [own[len(own) * i // pieces] for i in range(1, pieces)] if own else []
    return out
