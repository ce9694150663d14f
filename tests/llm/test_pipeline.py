"""The pipeline on a small table against plain versions of its stages."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_small import BYTE, brute_lines, brute_near, corpus
from voxcohort.llm.tokens import Encoder


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "mixture", "sequences"]
    rng = random.Random(1)
    rows = [r for r in corpus(3, 60) if r[0] is not None]
    rows = [(d, t, g or rng.choice(["en", "de"]), s, n) for d, t, g, s, n in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    docs, kept = df, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "unused")
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert out.columns == docs.columns
        kept.append(out)
        docs = out
    first = {r.doc_id: r.text for r in kept[0].collect()}
    assert set(first) == {d for d, t, *_ in rows if t and any(c.isalpha() for c in t)}
    second = {r.doc_id: r.text or "" for r in kept[1].collect()}
    assert second == {d: t for d, _, _, t in brute_lines(list(first.items()))}
    third = {r.doc_id for r in kept[2].collect()}
    assert third == {d for d, (_, _, k) in brute_near(list(second.items()), 5).items() if k}
    fourth = {r.doc_id: r.text or "" for r in kept[3].collect()}
    assert set(fourth) <= third and all(fourth[d] == second[d] for d in fourth)
    e = Encoder(BYTE, "none")
    pieces = kept[4].collect()
    for d, text in fourth.items():
        own = sorted((r.start, bytes(r.ids)) for r in pieces if r.doc_id == d)
        assert b"".join(x for _, x in own) == e.whole([text])[0] + bytes(4)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() == 0
