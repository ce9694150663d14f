"""Token files with directly addressable codes.

Each id is split into 8-bit chunks, lowest first. Level 0 has one byte for each token; level k has a byte for each
token with more than k chunks. A bitmap for each level tells which of its tokens continue on the next, and a rank
directory has the number of set bits before every RANK bits. So token i is found by one byte and one rank a level,
without decoding a block, and so is a run of tokens: at each level it is one slice, between the ranks of its ends. All
reading goes through these ranks; the files are not compressed, so that nothing has to be inflated first.

A file is a part of a Parquet table, one for each range of doc_ids; its rows are blocks of whole documents:
(shard, block, shard_start, doc_ids, lengths, codes), `codes` being the bytes below. Blocks are in ascending doc_id order.

    magic "DAC1" | tokens u64 | levels u32 | for each level: bytes u64, bitmap bytes u64, directory entries u64 |
    for each level: chunk bytes, bitmap (bit i of byte i // 8, lowest first), directory (u32)

Defined cases: a null text is empty; an empty document has its end id alone; null doc_ids come first; rows with one
doc_id all are written, in the order of the input; an empty table gives files with no blocks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty
from .tokens import encoder

MAGIC, RANK = b"DAC1", 512
#: Files whose bases are broadcast, 16 bytes each; beyond that Spark plans the join itself.
MOST_SENT = 100_000
#: Tokens of a block, unless one document has more.
BLOCK = 1 << 20
#: Tokens of neighbouring documents that are read as one run.
RUN = 1 << 14
SCHEMA = "shard int, block int, shard_start bigint, doc_ids array<bigint>, lengths array<bigint>, codes binary"


def encode_codes(ids: np.ndarray) -> bytes:
    head, body, rest = [], [], ids.astype("<u4")
    while True:
        more = rest > 255
        chunks, bitmap = (rest & 255).astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes()
        padded = np.zeros(-(-len(rest) // RANK) * RANK, dtype=np.uint32)
        padded[: len(rest)] = more
        ranks = np.concatenate([[0], padded.reshape(-1, RANK).sum(axis=1).cumsum()]).astype("<u4")
        head.append(struct.pack("<QQQ", len(chunks), len(bitmap), len(ranks)))
        body += [chunks, bitmap, ranks.tobytes()]
        if not more.any():
            break
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<QI", len(ids), len(head)) + b"".join(head) + b"".join(body)


class Codes:
    """Reads the bytes of `encode_codes`: `get(i)` for one token, `run(a, b)` for those from a to b (excluded)."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        self.n, levels = struct.unpack_from("<QI", data, 4)
        at, self.levels = 16 + 24 * levels, []
        for k in range(levels):
            sizes = struct.unpack_from("<QQQ", data, 16 + 24 * k)
            chunks = np.frombuffer(data, np.uint8, sizes[0], at)
            bitmap = np.frombuffer(data, np.uint8, sizes[1], at + sizes[0])
            ranks = np.frombuffer(data, "<u4", sizes[2], at + sizes[0] + sizes[1])
            self.levels.append((chunks, bitmap, ranks))
            at += sizes[0] + sizes[1] + 4 * sizes[2]

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i: the directory's entry, and the bits between it and i."""
        from_, to = i // RANK * (RANK // 8), i >> 3
        rest = int(bitmap[to]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(ranks[i // RANK]) + int(np.bitwise_count(bitmap[from_:to]).sum()) + rest.bit_count()

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bitmap, ranks, i)
        return value

    def run(self, a: int, b: int) -> np.ndarray:
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        slices = []
        for chunks, bitmap, ranks in self.levels:
            more = np.unpackbits(bitmap[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].view(bool)
            slices.append((chunks[a:b], more))
            n = int(np.count_nonzero(more))
            if not n:
                break
            a = self._rank(bitmap, ranks, a)
            b = a + n
        value = np.zeros(0, np.uint32)
        for chunks, more in reversed(slices):
            own = chunks.astype(np.uint32)
            own[more] |= value << 8
            value = own
        return value


def _write(path: str, kind: str, end: int):
    tail = end.to_bytes(4, "little")

    def block(shard: int, k: int, start: int, docs: list, ids: list[bytes]) -> pa.RecordBatch:
        values = [[shard], [k], [start], [docs], [[len(x) // 4 for x in ids]], [encode_codes(np.frombuffer(b"".join(ids), "<u4"))]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["shard", "block", "shard_start", "doc_ids", "lengths", "codes"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(path, kind), TaskContext.get().partitionId()
        k, start, docs, ids, held = 0, 0, [], [], 0
        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text").to_pylist()), strict=True):
                if held and held + len(x) // 4 + 1 > BLOCK:
                    yield block(shard, k, start, docs, ids)
                    k, start, docs, ids, held = k + 1, start + held, [], [], 0
                docs.append(doc)
                ids.append(x + tail)
                held += len(x) // 4 + 1
        if docs:
            yield block(shard, k, start, docs, ids)

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str = "word", end_id: int = 2, file_bytes: int = 16 << 20) -> None:
    """Write the ids of all documents below `path`, in ascending doc_id order over files and within them."""
    small_batches(docs.sparkSession)
    total = docs.select(F.sum(F.octet_length(text_or_empty()) + 1)).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("r"))
    ranged = rows.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id", "r").sortWithinPartitions("doc_id", "r").select("doc_id", "text")
    ranged.mapInArrow(_write(tokenizer, kind, end_id), SCHEMA).write.option("compression", "none").parquet(path)


def runs_of(ends: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) numbers of neighbouring documents, last excluded, that are read as one run: RUN tokens or more, but
    for the last run. `ends` are the documents' ends."""
    cuts = np.unique(np.searchsorted(ends, np.arange(RUN, (ends[-1] if len(ends) else 0) + RUN, RUN)) + 1).clip(max=len(ends))
    cuts = np.unique(np.concatenate([[0], cuts]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes, ends = Codes(row["codes"]), np.cumsum(row["lengths"])
            starts, ids = ends - row["lengths"], []
            for a, b in runs_of(ends):
                data, at = codes.run(int(starts[a]), int(ends[b - 1])).astype("<u4", copy=False).tobytes(), (4 * (ends[a:b] - starts[a])).tolist()
                ids += [data[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["shard_start"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(ids, pa.binary())],
                names=["shard", "doc_id", "shard_start", "n_tokens", "ids"],
            )


def _tokens_in(lengths: str = "lengths"):
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _bases(blocks: DataFrame) -> tuple[DataFrame, bool]:
    """(shard, base): tokens of all files before each; and whether these are few enough to be broadcast."""
    sums = blocks.groupBy("shard").agg(F.sum(_tokens_in()).alias("n"))  # a row for each file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return bases, blocks.select("shard").distinct().limit(MOST_SENT + 1).count() <= MOST_SENT


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; ids are little-endian unsigned 32-bit.
    Documents are read as the runs of tokens that they are, short ones together with their neighbours."""
    small_batches(spark)
    blocks = spark.read.schema(SCHEMA).parquet(path)
    bases, few = _bases(blocks)
    rows = blocks.mapInArrow(_read, "shard int, doc_id bigint, shard_start bigint, n_tokens bigint, ids binary")
    return rows.join(F.broadcast(bases) if few else bases, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def _get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by block, its codes before the positions that are asked of it."""
    codes = None
    for batch in batches:
        asked, found = [], []
        for data, position, at in zip(*(batch.column(c).to_pylist() for c in ("codes", "position", "at")), strict=True):
            if data is not None:
                codes = Codes(data)
            else:
                asked.append(position)
                found.append(codes.get(at))
        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(found, pa.int64())], names=["position", "token"])


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) for each row of `positions` (column `position`, counted over all files) that the files have;
    only blocks that are asked of are shuffled, and of those only the tokens asked for are decoded."""
    small_batches(spark)
    blocks = spark.read.schema(SCHEMA).parquet(path)
    bases, few = _bases(blocks)
    index = blocks.select("shard", "block", "shard_start", _tokens_in().alias("n")).join(F.broadcast(bases) if few else bases, "shard")
    index = index.select("shard", "block", (F.col("base") + F.col("shard_start")).alias("first"), "n")
    spans = index.select("*", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("n") - 1) / BLOCK))).alias("part"))
    wanted = positions.select(F.col("position").cast("bigint").alias("position")).withColumn("part", F.floor(F.col("position") / BLOCK))
    asked = wanted.join(spans, "part").where((F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n")))
    asked = asked.select("shard", "block", F.lit(None).cast("binary").alias("codes"), "position", (F.col("position") - F.col("first")).alias("at"))
    held = blocks.join(asked.select("shard", "block").distinct(), ["shard", "block"], "left_semi").select("shard", "block", "codes", F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("bigint").alias("at"))
    dealt = held.unionByName(asked).repartition("shard", "block").sortWithinPartitions("shard", "block", F.col("position").asc_nulls_first())
    return dealt.select("codes", "position", "at").mapInArrow(_get, "position bigint, token bigint")
