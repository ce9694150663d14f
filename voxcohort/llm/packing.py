"""Cost-balanced packing of token ids into sequences.

Documents are dealt by hash into shards of about `shard_bytes` of text; a shard is packed on its own, so memory is
bounded by a shard (or one document) and shards run in parallel. In a shard, whole `capacity`-token pieces fill
sequences of their own. The rest, at most capacity - 1 tokens a document, is taken in descending order of attention
cost, linear * n + quadratic * n^2, and each piece goes to the sequence with the lowest cost so far that has room for
it. There are only as many sequences as the tokens need; a piece that fits nowhere whole is cut, its head filling the
lowest-cost sequence with any room. So a shard has less than one sequence of padding.

Defined cases: a null text is empty; an empty document still has its end id; a null doc_id stays null; repeated rows are
packed as often as they occur; an empty table gives no pieces; other columns are not returned. Which shard a document
is dealt to follows its place in the input, so that many rows of one doc_id are spread; sequence ids thus depend on how
the input is split, while pieces and fill do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty
from .tokens import encoder

#: Shards that a task packs, one after the other, and the most tasks.
TASK_SHARDS, MOST_TASKS = 16, 100_000
#: Pieces of an Arrow batch, 2 MB with their ids at most.
PIECES = 500
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 512) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items with under `capacity` tokens."""
    bins = -(-sum(lengths) // capacity)
    cost, room, out = np.zeros(bins), np.full(bins, capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: (-(linear * lengths[i] + quadratic * lengths[i] ** 2), i)):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            at = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, math.inf)))
            n = min(left, int(room[at]))
            out.append((item, start, n, at, capacity - int(room[at])))
            room[at] -= n
            cost[at] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def _encode(path: str, kind: str, end: int):
    tail = end.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, kind)
        for batch in batches:
            ids = [np.frombuffer(x + tail, "<u4") for x in own.encode(batch.column("text").to_pylist())]
            # Two bytes an id where all fit, else four; the first byte says which.
            packed = [b"\2" + x.astype("<u2").tobytes() if x.max() < 65536 else b"\4" + x.tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("r"), batch.column("doc_id"), pa.array(packed, pa.binary())], names=["shard", "r", "doc_id", "ids"])

    return encode


def _pack_shard(shard: int, docs: list[tuple], capacity: int, linear: float, quadratic: float) -> Iterator[pa.RecordBatch]:
    ids = [np.frombuffer(x, "<u2" if x[0] == 2 else "<u4", offset=1) if x[0] == 2 else np.frombuffer(x[1:], "<u4") for _, x in docs]
    rows, sequence = [], 0
    for i, x in enumerate(ids):
        for start in range(0, len(x) - capacity + 1, capacity):
            rows.append((i, start, capacity, sequence, 0))
            sequence += 1
    rests = [i for i, x in enumerate(ids) if len(x) % capacity]
    for at, start, n, own, offset in assign([len(ids[i]) % capacity for i in rests], capacity, linear, quadratic):
        i = rests[at]
        rows.append((i, len(ids[i]) - len(ids[i]) % capacity + start, n, sequence + own, offset))
    for a in range(0, len(rows), PIECES):
        part = rows[a : a + PIECES]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([docs[r[0]][0] for r in part], pa.int64()),
                "start": pa.array([r[1] for r in part], pa.int64()),
                "length": pa.array([r[2] for r in part], pa.int64()),
                "ids": pa.array([ids[r[0]][r[1] : r[1] + r[2]].astype("<u4").tobytes() for r in part], pa.binary()),
                "doc_tokens": pa.array([len(ids[r[0]]) for r in part], pa.int64()),
                "sequence_id": pa.array([(shard << 32) + r[3] for r in part], pa.int64()),
                "offset": pa.array([r[4] for r in part], pa.int64()),
            }
        )


def _pack(capacity: int, linear: float, quadratic: float):
    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, docs = None, []
        for batch in batches:  # sorted by shard
            for name, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if name != shard:
                    if docs:
                        yield from _pack_shard(shard, docs, capacity, linear, quadratic)
                    shard, docs = name, []
                docs.append((doc, ids))
        if docs:
            yield from _pack_shard(shard, docs, capacity, linear, quadratic)

    return pack_rows


def pack(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, capacity: int = 1024, shard_bytes: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 512) -> DataFrame:
    """Pieces of all documents, with their ids (little-endian unsigned 32-bit) and places."""
    small_batches(docs.sparkSession)
    total = docs.select(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("r"))
    rows = rows.select(F.pmod(F.xxhash64("r", "doc_id"), F.lit(shards)).alias("shard"), "r", "doc_id", "text")
    ids = rows.mapInArrow(_encode(tokenizer, kind, end_id), "shard bigint, r bigint, doc_id bigint, ids binary")
    tasks = min(MOST_TASKS, -(-shards // TASK_SHARDS))
    return ids.repartition(tasks, "shard").sortWithinPartitions("shard", "r").mapInArrow(_pack(capacity, linear, quadratic), SCHEMA)
