"""Queries over a small table, row for row against plain versions of what they must return."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from voxcohort.llm import common, language, media, suffix_dedup
from voxcohort.llm.embedding_dedup import embedding_duplicates
from voxcohort.llm.queries import QUERIES
from voxcohort.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghéß") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(120)[:450]
    out = [prose(rng.randint(1, 400)) for _ in range(50)] + [f"{prose(40)} {passage[i:]} {prose(30)}" for i in range(0, 60, 5)]
    out += [prose(200_000) + passage, None, "", " ", "one", out[3], out[3], "ab" * 900, "x" * 401]  # over 1 MiB, copies, runs
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).withColumns({"media": F.lit(1), "stream": F.lit("s"), "ids": F.lit(2), "kept": F.lit(3)}).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def crc(ids):
    return zlib.crc32(ids)


def test_pack(spark, folder):
    tokenizer = Encoder(public_tokenizers.path("byte_bpe_50k.json"), "none")
    want = {i: tokenizer.whole([t or ""])[0] + bytes(4) for i, t in enumerate(texts())}
    rows = QUERIES["op2_pack"](spark, folder).collect()
    met, sequences = {i: [] for i in want}, {}
    for r in rows:
        assert r.ids_crc32 == crc(want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(want[r.doc_id]) // 4
        met[r.doc_id].append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, size in [*((v, len(want[k]) // 4) for k, v in met.items()), *((v, None) for v in sequences.values())]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
        assert at == size if size is not None else at <= 1024


def test_token_files(spark, folder):
    tokenizer = Encoder(public_tokenizers.path("word_bpe_49k.json"), "none")
    at, want = 0, {}
    for i, t in enumerate(texts()):
        ids = tokenizer.whole([t or ""])[0] + (2).to_bytes(4, "little")
        want[i] = (at, len(ids) // 4, crc(ids))
        at += len(ids) // 4
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_files"](spark, folder).collect()} == want


def plain_feature(stored):
    """The feature by a walk over single packets."""
    packets = [stored[i : i + 188] for i in range(0, len(stored), 188)]
    stamps, access, tables = [], [], 0
    for k, p in enumerate(packets):
        pid = (p[1] & 31) << 8 | p[2]
        tables += pid in (media.PAT_PID, media.PMT_PID)
        if pid == media.MEDIA_PID and p[1] & 0x40:
            body = p[5 + p[4] :] if p[3] & 0x20 else p[4:]
            a, b, c, d, e = body[9:14]
            stamps.append((a >> 1 & 7) << 30 | b << 22 | (c >> 1) << 15 | d << 7 | e >> 1)
            if p[3] & 0x20 and p[4] and p[5] & 0x40:
                access.append(f"{stamps[-1]}@{k}")
    return f"packets={len(packets)} tables={tables} units={len(stamps)} errors=0 pts={min(stamps)}..{max(stamps)} access={','.join(access)}"


def test_media(spark, folder):
    got = {r.doc_id: r for r in QUERIES["op6_media"](spark, folder).collect()}
    for i, t in enumerate(texts()):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        stored, r = media.mux(payload), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (crc(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == plain_feature(stored)
    assert len(got) == len(texts())


def test_media_of_odd_tables(spark):
    none = spark.createDataFrame([], "media int, stream string, p binary")
    assert media.read(media.store(none, F.col("p")), F.col("media")).count() == 0
    twice = spark.createDataFrame([(1, "s", b"x"), (1, "s", b"x")], "media int, stream string, p binary")
    rows = media.read(media.store(twice, F.col("p")), F.col("media")).collect()
    assert len(rows) == 2 and all(bytes(r.stream.payload) == b"x" and bytes(r.media) == media.mux(b"x") for r in rows)


def batches_read(df):
    """Batches that the Parquet readers of a collected table handed on."""
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "ColumnarToRow":
            n += node.metrics().apply("numInputBatches").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_media_reads_few_rows_at_once(spark, tmp_path):
    rows, name = 513, "spark.sql.parquet.columnarReaderBatchSize"
    spark.range(rows).select(F.encode(F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")), "utf-8").alias("p")).coalesce(1).write.parquet(f"{tmp_path}/p")
    spark.conf.unset(name)
    try:
        for make in (lambda df: media.store(df, F.col("p")), lambda df: media.read(df, F.col("p"))):
            df = make(spark.read.parquet(f"{tmp_path}/p"))
            assert len(df.collect()) == rows and batches_read(df) == 3
            spark.conf.unset(name)
        spark.conf.set(name, "64")
        common.short_reads(spark)
        assert spark.conf.get(name) == "64"
    finally:
        spark.conf.unset(name)


def plain_removal(rows, length):
    names = [[xxhash.xxh3_64_intdigest(t[i : i + length]) for i in range(len(t) - length + 1)] for t in rows]
    seen = Counter(n for own in names for n in own)
    out = []
    for t, own in zip(rows, names, strict=True):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in [i for i, n in enumerate(own) if seen[n] > 1]:
            gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        edges = np.diff(np.concatenate([[0], gone[:-1].astype(int), [0]]))
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, folder, monkeypatch, small):
    if small:  # many blocks, flushes and segments
        monkeypatch.setattr(suffix_dedup, "HOT", 3)
        monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 5000)
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
        monkeypatch.setattr(common, "HOT_PART", 1 / 50)
    want = dict(enumerate(plain_removal([(t or "").encode() for t in texts()], 400)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_dedup"](spark, folder).collect()} == want


def test_planted_passages_go_by_bytes(spark, tmp_path):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    prose = lambda n: " ".join(word(6) for _ in range(n))
    # 60 words and a last one that makes up the bytes; other letters stand before and after each copy
    passages = {size: (p := " ".join(word(5) for _ in range(60))) + " " + word(size - len(p) - 1) for size in (390, 399, 400, 401, 500)}
    planted = [(f"{prose(80)} {a}{p}{b} {prose(80)}", size) for size, p in passages.items() for a, b in ("AB", "CD", "EF")]
    rows = [(i, t) for i, (t, _) in enumerate(planted)] + [(100 + i, prose(200)) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in QUERIES["op7_suffix_dedup"](spark, str(tmp_path)).collect()}
    want = {i: (size, 1) if size >= 400 else (0, 0) for i, (_, size) in enumerate(planted)}
    assert got == want | {100 + i: (0, 0) for i in range(20)}


def plain_phrases(model, sample, text, chars):
    """How many longest matches a text falls into, by plain search."""
    spell = lambda t, n=None: model.spelled(language.symbols(t, model.classes)[:n]).tolist()
    whole = "".join(chr(c) for t in sample for c in [*spell(t, chars), language.GAP])
    n, phrase = 1, ""
    for c in map(chr, spell(text)):
        known = ord(c) != language.OTHER
        if known and phrase + c in whole:
            phrase += c
        else:
            n, phrase = n + 1, c if known and c in whole else ""
    return n


@pytest.mark.parametrize("sweeps", [language.SWEEPS, 0])
def test_phrases_are_those_of_one_parse(monkeypatch, sweeps):
    monkeypatch.setattr(language, "SWEEPS", sweeps)
    rng = random.Random(3)
    for case in range(12):
        symbols = "abc" if case % 2 else "abcdefgh éö1中ж "
        some = lambda n: "".join(rng.choice(symbols) for _ in range(n))  # noqa: E731, B023
        samples = {k: [some(rng.randint(1, 300)) for _ in range(3)] for k in ("x", "y")}
        model = language.Model(samples, 200, 10**6)
        given = [some(n) + "z" for n in (1, 5, 126, 127, 128, 1000, 3000)] + ["a" * 2000, samples["x"][0] * 7, "ab" * 700]
        got = model.phrases([model.spelled(language.symbols(t, model.classes)) for t in given])
        assert got.tolist() == [[plain_phrases(model, samples[k], t, 200) for k in model.languages] for t in given]


def test_language_of_odd_rows(spark):
    rows = [(None, "ja wohl das ist", "de"), (1, "ja wohl das ist gut", "de"), (2, "yes", "en"), (3, "xq", "zz"), (4, None, "en"), (5, "12", "en"), (1, "ja wohl das ist gut", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("found", F.lit(1))
    model = language.fit(df, F.col("doc_id").isNotNull())
    assert model.languages == ["de", "en", "zz"]  # short texts are learned from
    got = [(r.doc_id, r.lang_pred, r.found) for r in language.identify(df, model).collect()]
    assert sorted(got, key=repr) == sorted([(None, "de", 1), (1, "de", 1), (2, "en", 1), (3, "zz", 1), (4, "und", 1), (5, "und", 1), (1, "de", 1)], key=repr)


def test_embeddings_with_clashing_names(spark):
    three = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]
    rows = [(i, three[i % 3], 0, "c", 1.5) for i in range(9)] + [(0, [1.0, 0.0], 0, "c", 1.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component string, n double").withColumns({"id": F.lit(4), "cell": F.lit(1), "kept": F.lit("k")})
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_duplicates(df).collect()}
    assert got == {(i, 2, i % 3, i < 3) for i in range(9)}


def test_tables_are_released(spark):
    mark = common.written()
    a, b = (common.durable(spark.range(5), x) for x in "ab")
    common.release(spark, mark, b)
    assert common.written() == mark + 1 and b.count() == 5
    with pytest.raises(Exception, match="(?i)exist|found"):
        a.count()
    common.discard(b)
    assert common.written() == mark


def test_hot_keys_join_as_others(spark):
    rows = spark.createDataFrame([(k, i) for i in range(400) for k in ([7] if i % 2 else [i + 1, None])], "k int, i int")
    keyed = rows.where("k % 2 = 1").groupBy("k").agg(F.count("*").alias("n"))
    want = Counter(tuple(r) for r in rows.join(keyed, "k").collect())
    assert len(want) > 200 and Counter(tuple(r) for r in common.join_hot(rows, keyed, "k", "n", rows.count()).collect()) == want
