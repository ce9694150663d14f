"""Hierarchical labels of diagnoses, as a dimension that is joined, not code that branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import required

# Diagnosis, presence, behaviour, origin, coarse class and ids; -1 where a level does not apply.
COLUMNS = "diagnosis string, lesion_presence string, lesion_presence_id int, behavior string, behavior_id int, origin string, origin_id int, diagnosis_coarse string, diagnosis_coarse_id int, diagnosis_fine string, diagnosis_fine_id int"
DIAGNOSES = (
    ("CN", "absent", 0, "none", -1, "none", -1, "control", 0, "CN", 0),
    ("HH", "present", 1, "benign", 0, "primary_hepatic", 0, "HH", 1, "HH", 1),
    ("HCC", "present", 1, "malignant", 1, "primary_hepatic", 0, "HCC", 2, "HCC", 2),
    ("ICC", "present", 1, "malignant", 1, "primary_hepatic", 0, "ICC", 3, "ICC", 3),
    ("cHCC-CCA", "present", 1, "malignant", 1, "primary_hepatic", 0, "cHCC-CCA", 4, "cHCC-CCA", 4),
    ("CHCC", "present", 1, "malignant", 1, "primary_hepatic", 0, "cHCC-CCA", 4, "cHCC-CCA", 4),
    ("CRLM", "present", 1, "malignant", 1, "extrahepatic_metastatic", 1, "metastasis", 5, "CRLM", 5),
    ("BCLM", "present", 1, "malignant", 1, "extrahepatic_metastatic", 1, "metastasis", 5, "BCLM", 6),
)


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIAGNOSES), COLUMNS)


def labelled(cases: DataFrame) -> DataFrame:
    """`cases` with the columns of their diagnosis; an unknown one raises."""
    rows = cases.withColumn("diagnosis", F.coalesce("diagnosis", F.lit("")))
    return required(rows, F.broadcast(dimension(cases.sparkSession)), ["diagnosis"])


def schema() -> dict:
    """The document that goes with the labels: what each level's ids mean, how sizes are measured and binned."""
    ids = lambda at: {row[at]: row[at + 1] for row in DIAGNOSES}
    absent = lambda levels: {"not_applicable": -1} | {k: v for k, v in levels.items() if v >= 0}
    return {
        "schema_version": "hierarchical_liver_lesion_labels_v1_2026-09-13",  # fixed value
        "segmentation_target": {"file": "tumor_mask.nii.gz", "values": {"0": "background", "1": "liver_lesion"}},  # fixed values
        "hierarchies": {
            "lesion_presence": ids(1),
            "behavior": absent(ids(3)),
            "origin": absent(ids(5)),
            "diagnosis_coarse": ids(7),
            "diagnosis_fine": ids(9),
        },
        "diagnosis_mapping": {row[0]: row[9] for row in DIAGNOSES},
        "not_applicable": -1,
        "size_bins_mm": {"0-5": [0, 5], "5-10": [5, 10], "10-15": [10, 15], ">15": [15, None]},  # lower bounds open, upper bounds closed
        "instances": "components of the binary mask with 26 neighbours, none left out for its size; diameter of the sphere with a component's volume",
    }
