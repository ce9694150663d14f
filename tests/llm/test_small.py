"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from voxcohort.llm import anchors, language, line_dedup, media, mixing, near_dup, packing, sharding, suffix_dedup, token_files, tokens
from voxcohort.llm.embedding_dedup import embedding_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LINE = "This line is found in many documents"


def corpus(seed=0, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), len(text)))
    base = " ".join(rng.choice(words) for _ in range(200))
    rows += [(100, base, "en", "a", 0), (101, base, "en", "a", 0), (102, base + " tail", "en", "b", 0), (103, "x " + base.upper(), "en", "b", 0)]
    rows += [(110 + i, f"own {i}\n  {LINE} \n{LINE.upper()}\nend {i}", "de", "b", 0) for i in range(4)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t", None, "a", 0), (203, "word", "en", "a", 0), (204, "word", "en", "a", 0), (205, "long " * 30_000, "en", "a", 0), (206, "12 34 !!", "en", "a", 0), (None, "no id at all", "en", "a", 0), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + rows[:3], DOCS)  # three rows are repeated
    return df.repartition(3).withColumns({"n_lines": F.lit(7), "kept": F.lit("x"), "key": F.lit(1), "selected": F.lit("s"), "shard": F.lit(9), "id": F.lit(3)}).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_mix(docs, none):
    out = mixing.mix(docs, fraction=0.5).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.n_tokens == len((r.text or "").encode().split()) and 0 <= r.probability <= 1 and r.selected in (True, False)
    total = sum(r.n_tokens for r in out)
    assert abs(sum(r.n_tokens * r.probability for r in out) / total - 0.5) < 0.02
    assert mixing.mix(none).count() == 0


def test_raking_meets_the_targets(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(s, g, t, rng.randint(1, 1000)) for s in "ab" for g in "xyz" for t in "pq"], "source string, lang string, topic string, tokens long")
    goals = {m: mixing.targets(cells, m, 0.5, None) for m in mixing.MARGINS}
    out = mixing.rake(cells, goals).collect()
    whole = sum(r.tokens * r.weight for r in out)
    for m in mixing.MARGINS:
        for g in goals[m].collect():
            assert abs(sum(r.tokens * r.weight for r in out if r[m] == g[m]) / whole - g.share) < 1e-4
    given = mixing.targets(cells, "lang", 1.0, {"x": 1.0}).collect()
    assert {r.lang: r.share for r in given} == {"x": 1.0, "y": 0.0, "z": 0.0}


def test_one_row_computes_as_windows(spark):
    rng = random.Random(5)
    for n in (1, 40):
        rows = [(rng.choice(["a", "b", "", None]), rng.choice(["x", None]), rng.choice("pqr"), rng.choice([0, 1, 7, 100, 5000])) for _ in range(n)]
        cells = spark.createDataFrame([(*k, v) for k, v in {r[:3]: r[3] for r in rows}.items()], "source string, lang string, topic string, tokens long")
        goals = {m: mixing.targets(cells, m, 0.6, {"x": 0.5} if m == "lang" else None) for m in mixing.MARGINS}
        budget = 0.7 * (cells.agg(F.sum("tokens")).first()[0] or 0)
        a, b = (sorted((tuple(r) for r in out.select(*mixing.MARGINS, F.round("weight", 9), F.round("probability", 9)).collect()), key=repr) for out in (mixing.in_one_row(cells, goals, budget, 3), mixing.calibrate(mixing.rake(cells, goals, 3), budget)))
        assert a == b


def test_pack(docs, none):
    t = tokens.Encoder(BYTE, "none")
    rows = packing.pack(docs, BYTE, shard_bytes=4000).collect()
    want = Counter((r.doc_id, t.whole([r.text or ""])[0] + bytes(4)) for r in docs.select("doc_id", "text").collect())
    sequences, total = {}, 0
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and r.length > 0
        total += r.length
    for v in sequences.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 1024
    assert total == sum(len(k[1]) // 4 * n for k, n in want.items())
    for (doc, ids), n in want.items():
        own = [r for r in rows if r.doc_id == doc and r.doc_tokens == len(ids) // 4 and ids[4 * r.start : 4 * (r.start + r.length)] == r.ids]
        assert sum(r.length for r in own) >= n * len(ids) // 4
    assert packing.pack(none, BYTE).count() == 0


def test_assign_is_tight_and_balanced():
    rng = random.Random(4)
    lengths = [rng.randint(1, 1023) for _ in range(500)]
    pieces = packing.assign(lengths, 1024)
    filled = Counter()
    for item, start, n, at, offset in pieces:
        assert offset == filled[at]
        filled[at] += n
    assert len(filled) == -(-sum(lengths) // 1024) and max(filled.values()) <= 1024
    assert all(sum(p[2] for p in pieces if p[0] == i) == n for i, n in enumerate(lengths))


def test_token_files(spark, docs, none, tmp_path):
    t = tokens.Encoder(WORD, "none")
    token_files.write_tokens(docs, str(tmp_path / "t"), WORD, file_bytes=3000)
    rows = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count()
    at, ids = 0, [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert Counter((r.doc_id, r.ids) for r in rows) == Counter((r.doc_id, t.whole([r.text or ""])[0] + (2).to_bytes(4, "little")) for r in docs.select("doc_id", "text").collect())
    whole = np.frombuffer(b"".join(r.ids for r in rows), "<u4")
    wanted = [*range(0, len(whole), 97), len(whole) - 1, len(whole), -1, None, 5, 5]
    found = token_files.tokens_at(spark, str(tmp_path / "t"), spark.createDataFrame([(w,) for w in wanted], "position long")).collect()
    assert Counter((r.position, r.token) for r in found) == Counter((w, int(whole[w])) for w in wanted if w is not None and 0 <= w < len(whole))
    token_files.write_tokens(none, str(tmp_path / "n"), WORD)
    assert token_files.tokens_at(spark, str(tmp_path / "n"), spark.createDataFrame([(0,)], "position long")).count() == 0
    assert token_files.read_tokens(spark, str(tmp_path / "n")).count() == 0


def test_codes_give_any_token():
    rng = np.random.default_rng(1)
    for values in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], rng.integers(0, 70_000, 3000), rng.integers(0, 255, 1500)):
        v = np.array(values, dtype=np.uint32)
        c = token_files.Codes(token_files.encode_codes(v))
        assert (c.run(0, len(v)) == v).all() and [c.get(i) for i in range(len(v))] == v.tolist()
        for _ in range(200):
            a, b = sorted(rng.integers(0, len(v) + 1, 2).tolist())
            assert (c.run(a, b) == v[a:b]).all()
        with pytest.raises(IndexError):
            c.run(0, len(v) + 1)
        with pytest.raises(IndexError):
            c.get(len(v))


def test_runs_cover_all_documents(monkeypatch):
    monkeypatch.setattr(token_files, "RUN", 10)
    rng = random.Random(2)
    for _ in range(100):
        ends = np.cumsum([rng.choice([1, 2, 3, 25]) for _ in range(rng.randint(0, 30))])
        runs = token_files.runs_of(ends)
        assert [i for a, b in runs for i in range(a, b)] == list(range(len(ends)))
        assert all(ends[b - 1] - (ends[a - 1] if a else 0) < 10 + 25 for a, b in runs)


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_cached_encoding_equals_the_tokenizer(path, kind):
    rng = random.Random(3)
    symbols = [*"abXſÀªß²-!' \n\t,é1", "  ", " \n", "\x1c", "\xa0", "\x85", "<|endoftext|>", "'s", "'S", "'lL", "́", "İ", "Σ", "中", " ", "ǅ"]
    texts = ["".join(rng.choice(symbols[: rng.choice((18, len(symbols)))]) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["x" * 5000, "", "a " * 900]
    e = tokens.Encoder(path, kind)
    assert e.encode(texts) == e.whole(texts) and e.encode(texts[:50]) == e.whole(texts[:50])


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_new_words_are_cut_once(path, kind):
    """Words that the patterns have cut go to the model as they are; the tokenizer does not cut them a second time."""
    e, asked = tokens.Encoder(path, kind), []
    whole = e.whole
    e.whole = lambda texts: asked.extend(texts) or whole(texts)
    texts = ["The Öre, 12 \xb2ï 'twas\n\n it's  porosllosmente\t!!", "Ça ŵ\n", ""]
    assert e.encode(texts) == whole(texts) and not asked


@pytest.mark.parametrize(("path", "kind"), [(BYTE, "byte"), (WORD, "word")])
def test_letters_whose_lower_case_is_of_another_block(path, kind):
    e = tokens.Encoder(path, kind)
    texts = [f"{a}{c}{b}" for c in map(chr, range(0x250)) for a, b in (("a", "b"), ("", "a c"), ("x ", " y"))]
    assert e.encode(texts) == e.whole(texts)


def test_a_tokenizer_that_changes_words_is_asked_itself(tmp_path):
    from tokenizers import Tokenizer
    from tokenizers.normalizers import Lowercase

    t = Tokenizer.from_file(BYTE)
    t.normalizer = Lowercase()
    t.save(str(tmp_path / "lower.json"))
    e = tokens.Encoder(str(tmp_path / "lower.json"), "byte")
    texts = ["One TWO three", "TWO"]
    assert e.encode(texts) == e.whole(texts)


def brute_lines(rows, min_docs=3, min_chars=20):
    keep, held = {}, {}
    key = lambda line: line.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(doc)
    for k, ids in held.items():
        if len(k) >= min_chars and len(ids) >= min_docs:
            keep[k] = max(ids, key=lambda i: (i is not None, i))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in keep or keep[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return Counter(out)


def test_line_dedup(docs, none):
    for min_docs in (2, 3):
        got = line_dedup.line_dedup(docs, min_docs=min_docs).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got) == brute_lines([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], min_docs)
    assert line_dedup.line_dedup(none).count() == 0
    tight = line_dedup.line_dedup(docs, max_filter_bits=1 << 16)
    assert Counter(r.text for r in tight.collect()) == Counter(r.text for r in line_dedup.line_dedup(docs).collect())


def test_filter_has_every_repeat(docs):
    bits = 1 << 16
    texts = [r.text for r in docs.where("text is not null").collect()]
    held = Counter(k for t in texts for k in {k for k in line_dedup.line_keys(t.encode(), 5) if k})
    shared = type("B", (), {"value": line_dedup.repeat_filter(docs, bits, 5)})()
    assert shared.value and max(held.values()) > 1


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        base = rng.normal(size=(12, 8))
        for i in range(240):
            rows.append([len(rows), (base[i % 12] + rng.normal(size=8) * rng.choice([0.02, 0.3, 1.0])).tolist(), label])
    rows += [[len(rows) + i, rows[3][1], 0] for i in range(40)]
    n = len(rows)
    rows += [[n, None, 0], [n + 1, [0.0] * 8, 0], [n + 2, [float("nan")] * 8, 0], [n + 3, [1.0, None] + [0.0] * 6, 0], [n + 4, rows[3][1], None], [n + 5, [float("inf")] * 8, 0], [n + 6, [], 0], [n + 7, [1e-300] * 8, 1], [n + 8, [1e300] * 8, 1], [n + 9, [3.0, 4.0], 1], [n + 10, [6.0, 8.0], 1], [None, rows[3][1], 0]]
    return rows


def test_embedding_duplicates(spark, monkeypatch):
    from voxcohort.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rows = vectors()
    df = spark.createDataFrame(rows + rows[:2], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_duplicates(df, 0.93, fit_rows=200).collect() if r.vec_id is not None}
    sound = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {r[0]: set() for r in rows if r[0] is not None}
    unit = {r[0]: np.array(r[1]) / max(map(abs, r[1])) for r in sound}
    unit = {k: v / np.sqrt(v @ v) for k, v in unit.items()}
    for a in sound:
        for b in sound:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and unit[a[0]] @ unit[b[0]] >= 0.93:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    names = {}
    for v in sorted(links):
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in names:
                names[x] = v
                todo += links[x]
    assert got == {v: (len(links[v]), names[v], names[v] == v) for v in links}
    assert embedding_duplicates(df.limit(0)).count() == 0


def test_media(spark):
    rng = random.Random(1)
    for n in [*range(0, 400), 576, 4607, 4608, 4609, 100_000]:
        p = rng.randbytes(n)
        s = media.demux(media.mux(p))
        assert s.payload == p and s.errors == 0
    m = bytearray(media.mux(rng.randbytes(50_000)))
    del m[188 * 5 : 188 * 6]
    assert media.demux(bytes(m)).errors > 0
    m = bytearray(media.mux(b"abc"))
    m[20] ^= 255
    assert media.demux(bytes(m)).errors > 0 and media.demux(b"").payload == b"" and media.demux(b"junk" * 100).errors > 0
    s = media.demux(media.mux(bytes(media.UNIT_BYTES * 20)))
    assert s.timestamps == [i * media.UNIT_TICKS for i in range(20)] and [a for a, _ in s.access] == [0, 8 * media.UNIT_TICKS, 16 * media.UNIT_TICKS]
    df = spark.createDataFrame([(1, b"x"), (2, None), (3, b"")], "i int, p binary")
    rows = {r.i: r.stream for r in media.read(media.store(df, F.col("p")), F.col("media")).collect()}
    assert bytes(rows[1].payload) == b"x" and rows[2] is None and bytes(rows[3].payload) == b""


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((t, kept, int((np.diff(np.concatenate([[0], gone[:-1].astype(int), [0]])) == 1).sum())))
    return Counter(out)


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(spark, docs, none, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # small: anchors are dealt over several blocks
    rng = random.Random(9)
    passage = "".join(rng.choice("abc ") for _ in range(90))
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id <> 205 or doc_id is null").select("doc_id", "text").collect()]
    rows += [(1000 + i, f"{rng.random()}{passage[i:]}{rng.random()}") for i in range(12)] + [(2000, "ab" * 300), (2001, passage + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(3)
    got = suffix_dedup.suffix_dedup(df, length=40, gram=16).collect()
    assert Counter(((r.text or "").encode(), bytes(r.kept), r.n_spans) for r in got) == brute_repeats([(t or "").encode() for _, t in rows], 40)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_order_and_anchors():
    rng = random.Random(3)
    for k in range(60):
        alphabet = b"ab" if k % 2 else b"abcd\xff\x00"
        contexts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(8, 60))) for _ in range(rng.randint(1, 6))]
        seen = Counter(c[i : i + 8] for c in contexts for i in range(len(c) - 7))
        assert [g.tolist() for g in suffix_dedup.repeated_starts(contexts, 8)] == [[seen[c[i : i + 8]] > 1 for i in range(len(c) - 7)] for c in contexts]
    text = rng.randbytes(3000)
    names = {}
    for t in (text, b"other" + text[100:2000]):
        for h, a, b in zip(*anchors.runs(t, 64, 24), strict=True):
            for i in range(a, b):
                assert names.setdefault(t[i : i + 64], h) == h


def test_shard(docs, none):
    out = sharding.shard(docs, shards=4, ranges=16).collect()
    total = sum(r.size for r in out)
    assert len(out) == docs.count() and {r.law for r in out} == {"bytes"}
    for k in range(4):
        own = [r for r in out if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 4) <= max(r.size for r in out) + 0.01 * total
    sizes = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == sizes
    assert sharding.shard(none).count() == 0


def test_shard_parts_one_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("same text")).otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    sizes = Counter()
    for r in sharding.shard(df, shards=8, ranges=32).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8 + 20
    same = spark.range(500).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"))
    assert Counter(r.shard for r in sharding.shard(same, shards=5, ranges=8).collect()) == dict.fromkeys(range(5), 100)


def test_language(spark, docs, none):
    rng = random.Random(6)
    sound = {"aa": ["ba", "lo", "mi", "na"], "bb": ["sch", "ung", "tz", "ei"]}
    text = lambda g: " ".join("".join(rng.choice(sound[g]) for _ in range(3)) for _ in range(30))
    rows = [(i, text(g), g) for i, g in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    apart = language.held_out(F.col("doc_id"))
    model = language.fit(df, ~apart)
    got = language.identify(df.withColumn("score", F.lit("clash")), model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs.where("doc_id is not null"), model).collect()}
    assert odd[200] == odd[201] == odd[202] == odd[206] == ("und", 0.0) and odd[205][0] in ("aa", "bb")
    empty = language.fit(none, F.lit(True))
    assert language.identify(df, empty).first().lang_pred == "und" and language.identify(none, model).count() == 0
    folds = {r.doc_id: r.h for r in df.select("doc_id", apart.alias("h")).collect()}
    assert folds == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in folds}


def test_automaton_has_every_substring():
    rng = random.Random(8)
    s = [rng.randint(3, 5) for _ in range(60)]
    go = language.automaton(np.array(s))
    subs = {tuple(s[a:b]) for a in range(60) for b in range(a + 1, min(61, a + 7))}
    for _ in range(2000):
        w = tuple(rng.randint(3, 5) for _ in range(rng.randint(1, 6)))
        state = 0
        for c in w:
            state = go[state].get(c)
            if state is None:
                break
        assert (state is not None) == (w in subs)


def brute_near(rows, n, threshold=80):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        own = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
        sets[doc] = own
    ids = sorted(d for d in sets if d is not None)
    links = {d: set() for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                links[a].add(b)
                links[b].add(a)
    names = {}
    for d in ids:
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in names:
                names[x] = d
                todo += links[x]
    return {d: (len(sets[d]), names[d], names[d] == d) for d in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, none, n, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "FAR_BLOCK", 4)
    monkeypatch.setattr(near_dup, "HEAD_ROWS", 3)
    rng = random.Random(n)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for i in range(60):  # a family around one base, some links on both sides of the threshold
        own = list(base)
        for _ in range(rng.randint(0, 14 if n == 2 else 6)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(0)).repartition(3)
    out = near_dup.near_duplicates(df, words=n).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None} == brute_near(rows, n)
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    assert near_dup.near_duplicates(none).count() == 0


def test_filters_where_only_some_segments_repeat(spark):
    """Tasks whose filters have many segments, few of them with repeated keys."""
    rows = [(i, f"line number {i} of this table\nline number {i % 50} again and again", "en", "a", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = line_dedup.line_dedup(df, bits_per_key=600).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines([(d, t) for d, t, *_ in rows])
