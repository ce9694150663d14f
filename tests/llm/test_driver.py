"""What the driver holds and starts for the corpus operators."""

import os
import pickle

from pyspark.sql import functions as F

from voxcohort.llm import common, language


def texts() -> dict[str, list[str]]:
    words = {"en": "the house and the garden of this old town", "de": "das haus und der garten dieser alten stadt"}
    return {k: [" ".join(w.split()[i % 7 :] + [w] * 3 + [chr(97 + i)]) for i in range(30)] for k, w in words.items()}


def test_model_is_sent_without_its_table():
    model = language.Model(texts(), 600, 10**6)
    asked = ["the garden of the town", "der garten der stadt", None, "12"]
    found = model.predict(asked)
    sent = pickle.dumps(model)
    assert len(sent) < len(model.classes) * model.classes.itemsize + model.table.nbytes / 4
    there = pickle.loads(sent)
    assert there.predict(asked) == found and [k for k, _ in found] == ["en", "de", "und", "und"]
    assert (there.table == model.table).all()


def test_sample_takes_few_tasks(spark):
    df = spark.createDataFrame([(i, k, t) for k, own in texts().items() for i, t in enumerate(own)], "doc_id long, lang string, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    tracker = spark.sparkContext.statusTracker()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "97")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.sparkContext.setJobGroup("fit", "fit")
        model = language.fit(df, F.lit(True))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup("fit") for s in tracker.getJobInfo(j).stageIds}
    assert stages and max(i.numTasks for s in stages if (i := tracker.getStageInfo(s))) <= language.GATHERED
    assert model.languages == ["de", "en"]


def test_tables_have_no_mark_of_success(spark):
    made = common.durable(spark.range(10), "unmarked")
    folder = made.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert not [f for f in os.listdir(folder) if "_SUCCESS" in f] and made.count() == 10
