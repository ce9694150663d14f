"""Corpus operators where they once did a part: scripts beyond the common letters, short texts, margins, shared ids."""

import random

from pyspark.sql import functions as F

from voxcohort.llm import language, near_dup

SCRIPTS = {"el": (0x3B1, 24), "en": (0x61, 26), "hy": (0x561, 38), "ka": (0x10D0, 33), "ru": (0x430, 32), "ja": (0x3041, 80), "ko": (0xAC00, 600), "zh": (0x4E00, 600)}


def written(rng, lang, n):
    at, size = SCRIPTS[lang]
    return " ".join("".join(chr(at + rng.randrange(size)) for _ in range(4)) for _ in range(n))


def test_every_script_is_learned(spark):
    rng = random.Random(1)
    rows = [(i, written(rng, g, 150 if i < 5 * len(SCRIPTS) else 30), g) for i, g in enumerate(list(SCRIPTS) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.col("doc_id") % 5 != 0)
    letters = {c for _, t, _ in rows for c in t if c != " "}
    assert len(letters) > 1000 and model.width < 256
    got = language.identify(df.where("doc_id % 5 = 0"), model).collect()
    assert len(got) > 90 and all(r.lang_pred == r.lang for r in got)


def test_rare_letters_are_told_apart():
    texts = ["".join(map(chr, range(0x4E00, 0x4E00 + n))) for n in (300, 5000)]
    for t in texts:
        model = language.Model({"zh": [t]}, 10_000, 24_000_000)
        spelled = [tuple(model.spelled(language.symbols(c, model.classes)).tolist()) for c in t]
        assert len(set(spelled)) == len(t) and all(language.FIRST <= x < model.width for s in spelled for x in s)


def test_labels_of_short_texts_are_learned(spark):
    rng = random.Random(2)
    rows = [(i, written(rng, "en", 40), "en") for i in range(40)] + [(100 + i, "αβγ δεζ", "el") for i in range(3)] + [(200, "12 34", "no")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True))
    assert model.languages == ["el", "en"]
    assert all(r.lang_pred == r.lang for r in language.identify(df.where("lang <> 'no'"), model).collect())


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(3)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    changed = lambda words, i: " ".join([*words[:i], "changed", *words[i + 1 :]])
    rows, want = [], {}
    for k in range(0, 400, 10):  # one id on three texts; each has a near copy, and a far id stands alone
        texts = [text() for _ in range(3)]
        rows += [(k, " ".join(t)) for t in texts] + [(k + 1 + i, changed(t, 40)) for i, t in enumerate(texts)]
        rows += [(k + 5, changed(texts[0], 20)), (k + 5, ""), (k + 9, " ".join(text()))]
        want |= {k + i: k for i in (0, 1, 2, 3, 5)} | {k + 9: k + 9}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = near_dup.near_duplicates(df).collect()
    assert len(out) == len(rows) and {(r.doc_id, r.component_id, r.kept) for r in out} == {(d, c, d == c) for d, c in want.items()}
