"""MinHash near-dedup with odd sketches.

1. Each text becomes the set of its word shingles (64-bit hashes). Texts with equal sets are one class, kept as its
   smallest doc_id: copies are collapsed before anything else is shuffled.
2. A class has BANDS x ROWS MinHash samples. Samples are folded into a parity bitmap, the odd sketch: the XOR of two
   sketches has about as many bits as the sample sets differ in, which tells high similarities apart precisely.
3. Classes that agree on a band share a bucket. In a bucket each class is paired with the smallest one, its head, and the
   sketches are compared. Alike pairs are compared on their full sets, a head's set being held while its members pass.
   Classes far from the head are compared among themselves, sketch by sketch, block against block. Near and far
   overlap by the distance that a link can span, so linked classes meet in a family.
4. Links make components, near pairs make families. Where a family holds several components, all classes outside its
   first component are compared with the whole family, block against block, on full sets. Pairs within a component need
   no comparison, as they could not change the result. No list of pairs is made of a group: a block gives at most a
   tree of links.

At the threshold a pair misses all buckets with probability (1 - 0.8^ROWS)^BANDS = 3e-6.

Defined cases: a text without words (or null) has an empty set and links with nothing; with fewer words than a shingle
the whole sequence is the one shingle; a row with a null doc_id links with nothing, has a null component and is kept;
rows with one doc_id are one document, which links by each of its texts; ties go to the smallest doc_id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, durable, keep_only, small_batches, text_or_empty
from .graph import components

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: Members that pass one copy of their head, and classes of a block.
HEAD_ROWS, BLOCK = 500, 256
#: Sketches of a block.
FAR_BLOCK = 1024
#: Ids that are broadcast, 8 bytes each.
MOST_SENT = 1_000_000
#: Parts in which classes are numbered.
DEALT = 256
#: Vocabulary columns of a block product.
COLUMNS = 4096

_seed = np.random.default_rng(20240607)
_XOR = _seed.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_MUL = _seed.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_BAND_MUL = _seed.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND_ADD = _seed.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_SKETCH_MUL = _seed.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_SKETCH_ADD = _seed.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_JOIN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()
CACHES["near_dup"] = _WORDS.clear


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles; A-Z is lower-cased, words end at [\\x20\\x09-\\x0D]."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    own = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    m = len(words) - n + 1
    acc = own[:m]
    for j in range(1, n):
        acc = mixed(acc * _JOIN + own[j : j + m])
    return np.unique(acc)


def samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that is not empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(low), 512):
        np.minimum(best, ((low[a : a + 512][None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=best)
    return best


def band_keys(sample: np.ndarray) -> np.ndarray:
    keys = (sample.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_MUL).sum(axis=1, dtype=np.uint64) + _BAND_ADD
    return mixed(keys).view(np.int64)


def odd_sketch(sample: np.ndarray) -> bytes:
    bits = mixed(sample.astype(np.uint64) * _SKETCH_MUL + _SKETCH_ADD) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).view(np.int64)


def bits_at(similarity: float, deviations: float = 0) -> int:
    """Bits that sketches of sets of this similarity differ in; with `deviations`, no more than that but for so many
    standard deviations of the samples and of the sketch."""
    differing = SAMPLES * (1 - similarity) + deviations * (SAMPLES * similarity * (1 - similarity)) ** 0.5
    p = (1 - (1 - 2 / SKETCH_BITS) ** (2 * differing)) / 2
    return int(SKETCH_BITS * p + deviations * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def _describe(n: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dup")
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingles(text, n)
                sample = samples(hashes) if len(hashes) else None
                for column, value in zip(out, (len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), None if sample is None else band_keys(sample), None if sample is None else odd_sketch(sample)), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], names=["doc_id", "text_key", "n_shingles", "set_hash", "bands", "sketch"])

    return describe


def _verify(n: int, threshold: int):
    """Rows are sorted by (head, salt, member), the head's own row first; one head's set is held at a time."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for name, member, text in zip(*(batch.column(c).to_pylist() for c in ("head", "member", "text")), strict=True):
                if member is None:
                    head, own = name, shingles(text.encode(), n)
                    continue
                if name != head:
                    raise ValueError("a member came without its head")
                other = shingles(text.encode(), n)
                if threshold * max(len(own), len(other)) <= 100 * min(len(own), len(other)):
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= threshold * (len(own) + len(other) - both):
                        a.append(name)
                        b.append(member)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return verify


def _links(pairs: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """Those of `pairs` (member, head) that reach the threshold on their full sets."""
    counted = pairs.groupBy("head").agg(F.count("*").alias("members"))
    salts = counted.select("head", F.ceil(F.col("members") / HEAD_ROWS).cast("int").alias("salts"))
    members = pairs.join(salts, "head").select("head", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), "member")
    heads = salts.select("head", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("member"))
    asked = members.withColumn("id", F.col("member")).unionByName(heads.withColumn("id", F.col("head")))
    rows = asked.join(texts, "id").select("head", "salt", "member", "text")
    dealt = rows.repartition("head", "salt").sortWithinPartitions("head", "salt", F.col("member").asc_nulls_first())
    return dealt.select("head", "member", "text").mapInArrow(_verify(n, threshold), "a bigint, b bigint")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, all of `left` by all of `right`."""
    a, b = np.concatenate(left), np.concatenate(right)
    rows_a, rows_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    common = np.intersect1d(a, b)
    if not len(common):
        return np.zeros((len(left), len(right)))
    at_a, at_b = np.minimum(np.searchsorted(common, a), len(common) - 1), np.minimum(np.searchsorted(common, b), len(common) - 1)
    in_a, in_b = common[at_a] == a, common[at_b] == b
    at_a, rows_a, at_b, rows_b = at_a[in_a], rows_a[in_a], at_b[in_b], rows_b[in_b]
    out = np.zeros((len(left), len(right)))
    for c in range(0, len(common), COLUMNS):
        own_a, own_b = (at_a >= c) & (at_a < c + COLUMNS), (at_b >= c) & (at_b < c + COLUMNS)
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        x[rows_a[own_a], at_a[own_a] - c] = 1
        y[rows_b[own_b], at_b[own_b] - c] = 1
        out += x @ y.T
    return out


def tree(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those pairs that join what the ones before have not joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs:
        if (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _blocks(n: int, threshold: int):
    """Rows are sorted by block pair; one pair of blocks is held at a time."""

    def compare(rows: list[dict]) -> list[tuple[int, int]]:
        sets = [shingles(r["text"].encode(), n) for r in rows]
        left = [i for i, r in enumerate(rows) if r["side"] == 0]
        right = [i for i, r in enumerate(rows) if r["side"] == 1]
        if not left or not right:
            return []
        both = overlaps([sets[i] for i in left], [sets[i] for i in right])
        sizes = np.array([len(x) for x in sets], dtype=np.float64)
        near = 100 * both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both)
        parts = np.array([r["component"] for r in rows])
        near &= parts[left][:, None] != parts[right][None, :]
        found = [(left[i], right[j]) for i, j in zip(*np.nonzero(near), strict=True)]
        joined = tree([(int(parts[i]), int(parts[j])) for i, j in found])
        return joined  # components stand for their classes here

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = (row["family"], row["bi"], row["bj"])
                if own != name:
                    out += compare(held) if held else []
                    name, held = own, []
                held.append(row)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
        out = compare(held) if held else []
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return blocks


def _far_pairs(most: int):
    """Rows are sorted by block pair; trees of the pairs whose sketches differ in at most `most` bits."""

    def compare(ids: list[int], sides: list[int], sketches: list) -> list[tuple[int, int]]:
        values, side = np.array(sketches, dtype=np.int64), np.array(sides)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right if len(right) else left
        bits = np.zeros((len(left), len(right)), dtype=np.int32)
        for i in range(values.shape[1]):
            bits += np.bitwise_count(values[left, i][:, None] ^ values[right, i][None, :])
        return tree([(ids[left[i]], ids[right[j]]) for i, j in zip(*np.nonzero(bits <= most), strict=True) if ids[left[i]] != ids[right[j]]])

    def far_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, ([], [], [])
        for batch in chain(batches, [None]):
            out = []
            columns = [batch.column(c).to_pylist() for c in ("key", "bi", "bj", "id", "side", "sketch")] if batch is not None else [[None], [None], [None], [None], [None], [None]]
            for key, bi, bj, *row in zip(*columns, strict=True):
                if (key, bi, bj) != name:
                    out += compare(*held) if held[0] else []
                    name, held = (key, bi, bj), ([], [], [])
                for column, value in zip(held, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict({"member": pa.array([x for x, _ in out], pa.int64()), "head": pa.array([x for _, x in out], pa.int64())})

    return far_pairs


def _families(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (member, head, bits) that meet in a bucket and have near sketches, and pairs that join those far from
    their head among themselves."""
    sketches = classes.select("id", "sketch")
    near, settled = bits_at(max(0.05, threshold - 0.45)), bits_at(max(0.25, threshold - 0.25))
    banded = classes.select("id", F.explode("bands").alias("key"))
    heads = banded.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where(F.col("head") != F.col("last")).select("key", "head")
    met = durable(banded.join(heads, "key").where("id <> head").select("key", F.col("id").alias("member"), "head"), "band-buckets")
    a = sketches.select(F.col("id").alias("member"), F.col("sketch").alias("s"))
    b = sketches.select(F.col("id").alias("head"), F.col("sketch").alias("t"))
    both = met.select("member", "head").distinct().join(a, "member").join(b, "head")
    differ = sum((F.bit_count(F.get("s", F.lit(i)).bitwiseXOR(F.get("t", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    pairs = durable(both.select("member", "head", differ.alias("bits")), "head-pairs")
    far = met.join(pairs.where(F.col("bits") > settled), ["member", "head"], "left_semi").select("key", F.col("member").alias("id"))
    counts = far.groupBy("key").agg(F.ceil(F.count("*") / FAR_BLOCK).cast("int").alias("n"), F.count("*").alias("rows")).where("rows > 1").select("key", "n")
    placed = far.join(counts, "key").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    left = placed.select("key", "id", F.col("b").alias("bi"), F.explode(F.sequence(F.col("b"), F.col("n") - 1)).alias("bj"), F.lit(0).alias("side"))
    right = placed.where("b > 0").select("key", "id", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("bi"), F.col("b").alias("bj"), F.lit(1).alias("side"))
    asked = left.unionByName(right).join(sketches, "id").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    joined = asked.select("key", "bi", "bj", "id", "side", "sketch").mapInArrow(_far_pairs(bits_at(threshold, 6)), "member bigint, head bigint")
    return pairs.where(F.col("bits") <= near), durable(joined, "far-pairs")


def _residue(families: DataFrame, labels: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """Links (a, b) between components of one family that head pairs did not find."""
    held = families.withColumnRenamed("component", "family").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    held = durable(held.select("id", "family", "component"), "family-components")
    counts = held.groupBy("family", "component").agg(F.count("*").alias("n"))
    first = counts.groupBy("family").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    first = first.select("family", "main", F.ceil(F.col("n") / BLOCK).cast("int").alias("nj"), F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("ni"))
    rows = held.join(first, "family")
    block = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    outside = rows.where("component <> main").select("id", "component", "family", block("ni").alias("bi"), every("nj").alias("bj"), F.lit(0).alias("side"))
    whole = rows.select("id", "component", "family", every("ni").alias("bi"), block("nj").alias("bj"), F.lit(1).alias("side"))
    asked = outside.unionByName(whole).join(_texts_with(rows.select("id").distinct(), texts), "id")
    dealt = asked.repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj", "side", "id")
    return dealt.select("family", "bi", "bj", "side", "component", "text").mapInArrow(_blocks(n, threshold), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`; links have Jaccard similarity of at least
    `threshold` hundredths."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_key", F.xxhash64("text"))
    known = durable(rows.mapInArrow(_describe(words), "doc_id bigint, text_key bigint, n_shingles bigint, set_hash binary, bands array<bigint>, sketch array<bigint>"), "shingle-sets")
    full = known.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # One class for each set; its smallest doc_id stands for it, with that row's text.
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    classes = full.groupBy("set_hash").agg(first, F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    classes = durable(classes.select("set_hash", F.col("first.doc_id").alias("id"), F.col("first.*"), "bands", "sketch"), "shingle-classes")
    texts, same = rows.select(F.col("doc_id").alias("id"), "text"), None
    sets = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("b"))
    several = durable(sets.where("a <> b").select("doc_id"), "ids-of-several-sets")
    if not several.isEmpty():
        classes = durable(_apart(classes), "classes-apart")
        texts = _own_texts(rows, classes, several)
        same = durable(_same_document(_named(known, classes).join(several, "doc_id", "left_semi")), "same-documents")
    near, far = _families(classes, threshold / 100)
    pairs = durable(near.where(F.col("bits") <= bits_at(threshold / 100, 6)).select("member", "head"), "candidates")
    links = durable(_links(pairs, _texts_of(pairs, texts), words, threshold), "near-links")
    links = links if same is None else links.unionByName(same)
    labels = durable(components(links), "near-components")
    families = durable(components(near.select("member", "head").unionByName(far), "member", "head"), "near-families")
    more = durable(_residue(families, labels, texts, words, threshold), "family-links")
    if not more.isEmpty():
        labels = durable(components(links.unionByName(more)), "near-components")
    out = _named(known, classes).join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    component = F.coalesce(F.col("component"), F.col("class_id"), F.col("doc_id"))
    if same is not None:  # a row without words goes with the others of its document
        whole = out.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.coalesce("component", "class_id")).alias("whole"))
        out = out.join(whole, "doc_id", "left")
        component = F.coalesce(F.col("whole"), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _apart(classes: DataFrame) -> DataFrame:
    """`classes` with an id for each: of those with one smallest doc_id all but one get numbers above all doc_ids."""
    shared = classes.groupBy("id").agg(F.count("*").alias("n"), F.min("set_hash").alias("owner")).where("n > 1").select("id", "owner")
    rest = durable(classes.join(shared, "id").where("set_hash <> owner").select("set_hash", F.pmod(F.xxhash64("set_hash"), F.lit(DEALT)).alias("part")), "further-classes")
    most = classes.agg(F.max("id")).first()[0]
    number = F.row_number().over(Window.partitionBy("part").orderBy("set_hash")).cast("bigint")
    numbered = rest.select("set_hash", (F.lit(most) + number * DEALT + F.col("part")).alias("other"))
    return classes.join(numbered, "set_hash", "left").withColumn("id", F.coalesce("other", "id")).drop("other")


def _own_texts(rows: DataFrame, classes: DataFrame, several: DataFrame) -> DataFrame:
    """(id, text), where ids of several sets have the text of their class."""
    owners = classes.join(several, "doc_id", "left_semi").select("id", "doc_id", "text_key")
    own = rows.join(owners, ["doc_id", "text_key"]).select("id", "text")
    return rows.join(several, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "text").unionByName(own)


def _same_document(named: DataFrame) -> DataFrame:
    """Links (a, b) from each document's smallest class to its others."""
    held = durable(named.where("class_id is not null").select("doc_id", "class_id").distinct(), "sets-of-documents")
    least = held.groupBy("doc_id").agg(F.min("class_id").alias("a"))
    return held.join(least, "doc_id").where("class_id <> a").select("a", F.col("class_id").alias("b"))


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """One text for each id that `pairs` name."""
    return _texts_with(pairs.select(F.col("member").alias("id")).unionByName(pairs.select(F.col("head").alias("id"))).distinct(), texts)


def _texts_with(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """One text for each of `ids`; these are sent to all tasks if they are few, else Spark plans the join itself."""
    ids = durable(ids, "ids")
    found = texts.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "id", "left_semi")
    return found.dropDuplicates(["id"])


def _named(known: DataFrame, classes: DataFrame) -> DataFrame:
    """`known` with class_id; null for empty sets and null ids."""
    named = known.join(classes.select("set_hash", F.col("id").alias("class_id")), "set_hash", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("class_id")).alias("class_id"))
