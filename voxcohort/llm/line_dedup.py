"""Line dedup: two Bloom filters find suspected repeats, an exact count confirms them.

1. Each task hashes the keys of its lines and sets bits in two filters: `once` has every key, `twice` every key that
   the task met in more than one document. A filter is cut into segments, and segments of all tasks are merged as
   a stream: twice |= other.twice | (once & other.once). No key that is in two documents can be missing from `twice`.
2. Only keys that `twice` has are shuffled, as (SHA-256 of the key, doc_id), and counted exactly.
3. A key found in at least `min_docs` documents keeps its lines in one document, and loses them elsewhere.

Both filters have `bits_per_key` bits for each line of the corpus, `max_filter_bits` at most: this bounds what is
broadcast. A fuller filter suspects more keys; results are the same, as counts are exact.

Defined cases: a null or empty text is one empty line; rows with one doc_id are one document, and null is an id of its
own that sorts before all others; a key that is repeated within a document counts once; an empty table gives an empty
table; other columns pass through, but columns named n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, durable, free_name, join_hot, keep_only, small_batches, text_or_empty

#: Bits of a segment, and bits set for a key, all within one segment.
SEGMENT = 1 << 19
PROBES = 3


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line its key, or None where the key is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(BLANK).lower()  # bytes.lower() changes A-Z only
        short = len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars
        out.append(None if short else key)
    return out


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash, and its PROBES bits within the segment."""
    width = min(bits, SEGMENT)
    segment = (hashes >> np.uint64(44)) % np.uint64(bits // width)
    low, step = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return segment.astype(np.int64), np.stack([(low + step * np.uint64(i)) % np.uint64(width) for i in range(PROBES)], axis=1).astype(np.int64)


def packed(segment: np.ndarray, probes: np.ndarray, width: int) -> dict[int, bytes]:
    order = np.argsort(segment, kind="stable")
    segment, probes = segment[order], probes[order]
    out = {}
    names, starts = np.unique(segment, return_index=True)
    for name, a, b in zip(names, starts, [*starts[1:], len(segment)][: len(names)], strict=True):
        bits = np.zeros(width, dtype=bool)
        bits[probes[a:b].ravel()] = True
        out[int(name)] = np.packbits(bits).tobytes()
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _fill(bits: int, min_chars: int):
    width = min(bits, SEGMENT)

    def emit(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, times = np.unique(np.concatenate(found), return_counts=True)
        segment, probes = places(keys, bits)
        once, twice = packed(segment, probes, width), packed(segment[times > 1], probes[times > 1], width)
        for name, value in once.items():
            again = zlib.compress(twice[name], 1) if name in twice else None
            yield pa.RecordBatch.from_pydict({"segment": pa.array([name], pa.int32()), "once": pa.array([zlib.compress(value, 1)], pa.binary()), "twice": pa.array([again], pa.binary())})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("lines")
        found, held = [], 0
        for batch in batches:
            for text in _texts(batch):
                if keys := {k for k in line_keys(text, min_chars) if k is not None}:
                    found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                    held += len(keys)
            if held > 4_000_000:
                yield from emit(found)
                found, held = [], 0
        if found:
            yield from emit(found)

    return fill


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by segment, so that one segment is held at a time."""
    name, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_pydict({"segment": pa.array([name], pa.int32()), "twice": [zlib.compress(twice.tobytes(), 1)]})

    for batch in batches:
        for row in batch.to_pylist():
            a = np.frombuffer(zlib.decompress(row["once"]), np.uint8)
            b = np.frombuffer(zlib.decompress(row["twice"]), np.uint8) if row["twice"] else np.zeros_like(a)
            if row["segment"] != name:
                if name is not None:
                    yield done()
                name, once, twice = row["segment"], a, b
            else:
                twice = twice | b | (once & a)
                once = once | a
    if name is not None:
        yield done()


def repeat_filter(docs: DataFrame, bits: int, min_chars: int) -> dict[int, bytes]:
    """Segments of the `twice` filter; at most `bits` bits, compressed."""
    texts = docs.select(text_or_empty().alias("text"))
    parts = texts.mapInArrow(_fill(bits, min_chars), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, twice binary")
    return {r.segment: r.twice for r in merged.collect()}  # bounded by max_filter_bits


def _suspect(shared, bits: int, min_chars: int):
    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = {k: np.frombuffer(zlib.decompress(v), np.uint8) for k, v in shared.value.items()}
        names = np.array(sorted(filled), dtype=np.int64)
        table = np.stack([filled[k] for k in names]) if len(names) else np.zeros((0, 1), np.uint8)
        for batch in batches:
            ids, digests = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                keys = list({k for k in line_keys(text, min_chars) if k is not None})
                if not keys or not len(names):
                    continue
                segment, probes = places(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)
                at = np.minimum(np.searchsorted(names, segment), len(names) - 1)
                hit = names[at] == segment
                for i in range(PROBES):
                    hit &= (table[at, probes[:, i] >> 3] >> (7 - (probes[:, i] & 7))) & 1 == 1
                for i in np.flatnonzero(hit):
                    ids.append(doc)
                    digests.append(hashlib.sha256(keys[i]).digest())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "key": pa.array(digests, pa.binary())})

    return suspect


def _cut(min_chars: int):
    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    @F.arrow_udf("struct<text string, n_lines bigint, n_dropped bigint>")
    def cut(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for text, drop in zip(texts.cast(pa.binary()).to_pylist(), drops.to_pylist(), strict=True):
            n = (text or b"").count(b"\n") + 1
            if drop and text:
                gone = set(drop)
                keep = [line for line, key in zip(text.split(b"\n"), line_keys(text, min_chars), strict=True) if key is None or hashlib.sha256(key).digest() not in gone]
                out.append({"text": b"\n".join(keep).decode(), "n_lines": n, "n_dropped": n - len(keep)})
            else:
                out.append({"text": None if text is None else text.decode(), "n_lines": n, "n_dropped": 0})
        return pa.array(out, kind)

    return cut


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, bits_per_key: int = 12, max_filter_bits: int = 1 << 28) -> DataFrame:
    """`docs` with the repeated lines taken out of `text`, and n_lines (before) and n_dropped."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    n = docs.select(F.sum(F.length(text_or_empty()) - F.length(F.replace(text_or_empty(), F.lit("\n"))) + 1)).first()[0] or 0
    bits = min(max_filter_bits, max(1 << 16, 1 << (bits_per_key * n).bit_length()))
    shared = spark.sparkContext.broadcast(repeat_filter(docs, bits, min_chars))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    suspects = durable(texts.mapInArrow(_suspect(shared, bits, min_chars), "doc_id bigint, key binary"), "line-suspects")
    # A null id is its own document, before all others. A key is in `suspects` once for each row that holds it.
    seen = suspects.groupBy("key", "doc_id").agg(F.count("*").alias("rows"))
    verdicts = seen.groupBy("key").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper", "rows")
    verdicts = durable(verdicts, "line-verdicts")
    own, keys, out = (free_name(docs, x) for x in ("own_id", "own_keys", "own_cut"))
    marked = join_hot(suspects, verdicts, "key", "rows", suspects.count()).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = marked.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("key").alias(keys))
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col(own)), "left").withColumn(out, _cut(min_chars)(F.col("text"), F.col(keys)))
    kept = [F.col(out)["text"].alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*kept, F.col(out)["n_lines"].alias("n_lines"), F.col(out)["n_dropped"].alias("n_dropped"))
