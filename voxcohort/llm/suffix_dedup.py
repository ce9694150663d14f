"""Suffix-array dedup: bytes covered by a string of `length` bytes that starts more than once.

1. Strings are grouped by anchor (see anchors.py): a text falls into runs of starts with one anchor. Two Bloom filters,
   as in line dedup, tell which anchors can occur twice; only their runs go on, each with the bytes that its strings
   span (a context). Equal contexts are counted, not repeated.
2. A context met twice is repeated throughout. For the others of an anchor, a suffix array is built by two-stage sorting:
   suffixes smaller than their successors are sorted directly, the rest is induced from them by one scan over the
   buckets; adjacent common prefixes of at least `length` bytes tell which starts repeat. Suffixes that no start's
   order depends on are left out.
3. An anchor with more than HOT contexts is dealt over several blocks; strings that a block found once, and one of each
   that it found more often, are then counted over all blocks by a 128-bit hash.
4. Repeated starts go back to the texts as spans, merged where they touch.

Defined cases: a null or empty text, and one shorter than `length`, has nothing removed; matches never cross texts; equal
rows repeat each other whole; very long texts are cut into anchors piece by piece; an empty table gives an empty table;
other columns pass through, those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, LENGTH, runs
from .common import durable, free_name, join_hot, keep_only, small_batches, text_or_empty
from .line_dedup import _merge, packed, places

#: Contexts of an anchor in one block, and bytes of contexts sorted at once.
HOT, BLOCK_BYTES = 4096, 1 << 18
#: Bytes of contexts that a task holds before it hands them on.
FLUSH_BYTES = 4 << 20
OUT = ("kept", "spans", "n_bytes", "n_removed", "n_spans")
SEGMENT = 1 << 19


def suffix_order(data: bytes, needed: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `needed` (a mask) by their suffixes, up to `depth` bytes; ties in any order."""
    n = len(data)
    text = np.zeros(n + 1, dtype=np.int16)
    text[:n] = np.frombuffer(data, np.uint8)
    text[:n] += 1  # the end is smaller than any byte
    # Smaller than the successor: decided at the next change of symbol.
    step = np.sign(np.diff(text))
    at = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n + 1, dtype=bool)
    small[:n] = step[np.minimum(nearest, n - 1)] > 0
    # Each needed suffix depends on those up to the next small one.
    stop = np.minimum.accumulate(np.where(small, np.arange(n + 1), n)[::-1])[::-1]
    starts = np.flatnonzero(needed)
    marks = np.zeros(n + 2, dtype=np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, stop[starts] + 1, -1)
    wanted = np.cumsum(marks)[: n + 1] > 0
    direct = np.flatnonzero(wanted & small)
    direct = direct[np.argsort(text[direct], kind="stable")]
    ends = np.searchsorted(text[direct], np.arange(258))
    for a, b in zip(ends, ends[1:], strict=False):  # bucket by bucket, so that few keys are held at a time
        if b - a > 1:
            direct[a:b] = sorted(direct[a:b].tolist(), key=lambda p: data[p : p + depth])
    induced = wanted & ~small
    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for c in range(257):
        wave = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        large = []
        while len(wave):
            large.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & induced[before]]
        bucket = np.concatenate([*large, direct[ends[c] : ends[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        for d in np.unique(text[before]):
            pending[d].append(before[text[before] == d])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[needed[np.minimum(order, n - 1)] & (order < n)]


def common_at_least(data: bytes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a[i] and b[i] share a prefix of `length` bytes, eight bytes at a time."""
    padded = np.frombuffer(data + bytes(length + 8), np.uint8)
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    alive = np.arange(len(a))
    for k in steps:
        if not len(alive):
            break
        alive = alive[words[a[alive] + k] == words[b[alive] + k]]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its strings of `length` bytes (at least 8) occur again in these contexts."""
    data = b"".join(contexts)
    counts = np.array([len(c) - length + 1 for c in contexts])
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in contexts])[:-1]])
    needed = np.zeros(len(data), dtype=bool)
    for o, k in zip(offsets, counts, strict=True):
        needed[o : o + k] = True
    order = suffix_order(data, needed, length)
    same = common_at_least(data, order[:-1], order[1:], length)
    again = np.zeros(len(data), dtype=bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    return [again[o : o + k] for o, k in zip(offsets, counts, strict=True)]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _fill(bits: int, length: int, gram: int):
    width = min(bits, SEGMENT)

    def emit(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        import zlib

        keys, times = np.unique(np.concatenate(found), return_counts=True)
        segment, probes = places(keys, bits)
        once, twice = packed(segment, probes, width), packed(segment[times > 1], probes[times > 1], width)
        for name, value in once.items():
            again = zlib.compress(twice[name], 1) if name in twice else None
            yield pa.RecordBatch.from_pydict({"segment": pa.array([name], pa.int32()), "once": pa.array([zlib.compress(value, 1)], pa.binary()), "twice": pa.array([again], pa.binary())})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("suffix")
        found, held = [], 0
        for batch in batches:
            for text in _texts(batch):
                hashes, _, _ = runs(text, length, gram)
                found.append(hashes)
                held += len(hashes)
            if held > 4_000_000:
                yield from emit(found)
                found, held = [], 0
        if held:
            yield from emit(found)

    return fill


def _contexts(shared, bits: int, length: int, gram: int):
    """Rows of two kinds: contexts (anchor, digest, context, n), and places (text_hash, start, digest)."""
    names = ("anchor", "digest", "context", "n", "text_hash", "start")
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64())

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        filled = {k: np.frombuffer(zlib.decompress(v), np.uint8) for k, v in shared.value.items()}
        segments = np.array(sorted(filled), dtype=np.int64)
        table = np.stack([filled[k] for k in segments]) if len(segments) else None
        met: dict[bytes, list] = {}
        out: list[list] = [[] for _ in names]
        hashes_of: dict[bytes, list[bytes]] = {}

        def flush() -> pa.RecordBatch:
            for digest, (anchor, context, n) in met.items():
                for column, value in zip(out, (anchor, digest, context, n, None, None), strict=True):
                    column.append(value)
            rows = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=list(names))
            met.clear()
            hashes_of.clear()
            for column in out:
                column.clear()
            return rows

        held = 0
        for text in chain.from_iterable(_texts(batch) for batch in batches):
            if len(text) < length or table is None:
                continue
            name = hashlib.md5(text).digest()
            if name in hashes_of:  # the same text again: its contexts count, its places are known
                for digest in hashes_of[name]:
                    met[digest][2] += 1
                continue
            hashes, first, end = runs(text, length, gram)
            segment, probes = places(hashes, bits)
            at = np.minimum(np.searchsorted(segments, segment), len(segments) - 1)
            hit = segments[at] == segment
            for i in range(probes.shape[1]):
                hit &= (table[at, probes[:, i] >> 3] >> (7 - (probes[:, i] & 7))) & 1 == 1
            own = hashes_of[name] = []
            for i in np.flatnonzero(hit):
                context = text[first[i] : end[i] + length - 1]
                digest = hashlib.md5(context).digest()
                own.append(digest)
                met.setdefault(digest, [int(hashes[i].view(np.int64)), context, 0])[2] += 1
                held += len(context)
                for column, value in zip(out, (None, digest, None, None, name, int(first[i])), strict=True):
                    column.append(value)
            if held > FLUSH_BYTES:
                yield flush()
                held = 0
        yield flush()

    return contexts


def ranges_of(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [{"a": int(a), "b": int(b)} for a, b in edges.reshape(-1, 2)]


def _find(length: int):
    """Rows are sorted by (anchor, salt). Spans of repeated starts of each context; for anchors dealt over several
    blocks also a row for each distinct string (see the module's text)."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def solve(groups: list[tuple[bool, dict]]) -> tuple[list, list, list, list]:
        out: tuple[list, list, list, list] = ([], [], [], [])
        open_ = [c for _, g in groups if len(g) > 1 for c, n in g.values()]
        found = iter(repeated_starts(open_, length) if open_ else [])
        for parted, group in groups:
            seen = set()
            for digest, (context, n) in group.items():
                again = next(found) if len(group) > 1 else np.zeros(len(context) - length + 1, dtype=bool)
                whole = np.ones_like(again) if n > 1 else again
                if whole.any():
                    for column, value in zip(out, (digest, ranges_of(whole), None, None), strict=True):
                        column.append(value)
                if parted:
                    for j in range(len(again)):
                        name = xxhash.xxh3_128_digest(context[j : j + length])
                        if not whole[j] or name not in seen:
                            seen.add(name)
                            for column, value in zip(out, (None if whole[j] else digest, None, name, j), strict=True):
                                column.append(value)
        return out

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, groups, held = None, [], 0
        for batch in chain(batches, [None]):
            rows = [(None,) * 6] if batch is None else zip(*(batch.column(c).to_pylist() for c in ("anchor", "salt", "salts", "digest", "context", "n")), strict=True)
            for anchor, salt, salts, digest, context, n in rows:
                if (anchor, salt) != name or batch is None:
                    if groups and (held > BLOCK_BYTES or batch is None):
                        out = solve(groups)
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], kind), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64())], names=["digest", "starts", "string", "at"])
                        groups, held = [], 0
                    if batch is None:
                        break
                    name = (anchor, salt)
                    groups.append((salts > 1, {}))
                group = groups[-1][1]
                if digest in group:
                    group[digest] = (group[digest][0], group[digest][1] + n)
                else:
                    group[digest] = (context, n)
                    held += len(context)

    return find


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, bits_per_key: int = 12, max_filter_bits: int = 1 << 28) -> DataFrame:
    """(text_hash, spans) of the texts in column `text` that hold repeated strings; text_hash is their MD5."""
    spark = texts.sparkSession
    total = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = 2 * total // (length - gram + 1) + 1
    bits = min(max_filter_bits, max(1 << 16, 1 << int(bits_per_key * anchors).bit_length()))
    parts = texts.mapInArrow(_fill(bits, length, gram), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, twice binary")
    shared = spark.sparkContext.broadcast({r.segment: r.twice for r in merged.collect()})  # bounded by max_filter_bits
    found = durable(texts.mapInArrow(_contexts(shared, bits, length, gram), "anchor bigint, digest binary, context binary, n bigint, text_hash binary, start bigint"), "contexts")
    contexts = found.where("context is not null").select("anchor", "digest", "context", "n")
    counts = contexts.groupBy("anchor").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts"), F.count("*").alias("rows"), F.sum("n").alias("times")).where("times > 1").select("anchor", "salts", "rows")
    counts = durable(counts, "anchors")
    dealt = join_hot(contexts, counts, "anchor", "rows", contexts.count()).withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts")).cast("int"))
    dealt = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "digest")
    solved = durable(dealt.select("anchor", "salt", "salts", "digest", "context", "n").mapInArrow(_find(length), "digest binary, starts array<struct<a:bigint,b:bigint>>, string binary, at bigint"), "repeated-starts")
    strings = solved.where("string is not null")
    again = strings.groupBy("string").agg(F.count("*").alias("blocks")).where("blocks > 1").select("string")
    more = strings.where("digest is not null").join(again, "string").select("digest", F.array(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("starts"))
    starts = solved.where("starts is not null").select("digest", "starts").unionByName(more)
    spots = found.where("context is null").select("text_hash", "start", "digest").join(starts, "digest")
    spans = spots.select("text_hash", F.explode("starts").alias("s"), "start").select("text_hash", F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b") + length - 1).alias("b")).alias("span"))
    return spans.groupBy("text_hash").agg(F.array_sort(F.collect_set("span")).alias("spans"))


KIND = pa.struct([("kept", pa.binary()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])


def cut(text: bytes, spans: list[dict] | None) -> dict:
    """The text without its spans, and the spans merged where they overlap or touch."""
    merged: list[list[int]] = []
    for s in spans or []:
        if merged and s["a"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["b"])
        else:
            merged.append([s["a"], s["b"]])
    edges = [0, *chain.from_iterable(merged), len(text)]
    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return {"kept": kept, "spans": [{"a": a, "b": b} for a, b in merged], "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(merged)}


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`docs` with kept (bytes that remain), spans (removed, ends excluded), n_bytes, n_removed and n_spans."""
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs.select(text_or_empty().alias("text")), length, gram)
    own = docs.select(*[c for c in docs.columns if c not in OUT])
    key, name, at, cuts = (free_name(own, x) for x in ("own_key", "text_hash", "text_spans", "own_cut"))
    spans = spans.select(F.col("text_hash").alias(name), F.col("spans").alias(at))
    joined = own.withColumn(key, F.unhex(F.md5(F.encode(text_or_empty(), "utf-8")))).join(spans, F.col(key) == F.col(name), "left")

    @F.arrow_udf("struct<kept:binary,spans:array<struct<a:bigint,b:bigint>>,n_bytes:bigint,n_removed:bigint,n_spans:bigint>")
    def removed(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([cut(t or b"", s) for t, s in zip(texts.cast(pa.binary()).to_pylist(), found.to_pylist(), strict=True)], KIND)

    out = joined.withColumn(cuts, removed(F.col("text"), F.col(at)))
    return out.select(*own.columns, *[F.col(cuts)[c].alias(c) for c in OUT])
