import pytest

from tests.oracle import check
from voxcohort.llm.oracles import ORACLES
from voxcohort.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    check(spark, SF, QUERIES[name], ORACLES[name])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op9_language"](spark, d).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
